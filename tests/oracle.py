"""Compare queries with their SQL run by DuckDB, as the driver does: ``python tests/oracle.py SF_DIR [NAME...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def plain(value: object) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9))
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        return plain(value.tolist())
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    names = sorted(frame.columns)
    return sorted(zip(*[[plain(x) for x in frame[name].astype(object)] for name in names])) if len(frame) else []


def differences(spark, sf_dir: str, name: str, query, sql: str) -> str:
    """Empty if the query and its SQL give the same rows and columns."""
    got = query(spark, sf_dir).toPandas()
    want = connect(sf_dir).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: columns {sorted(got.columns)} against {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return ""
    extra, missing = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{name}: {len(a)} rows against {len(b)}; only here {extra}; only in SQL {missing}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from spanloom.session import local_session

    session = local_session(8)
    queries, sqls = entry.queries(), entry.oracle_sql()
    for key in sys.argv[2:] or queries:
        began = time.time()
        try:
            if key in sqls:
                said = differences(session, sys.argv[1], key, queries[key], sqls[key]) or "equal"
            else:
                said = f"{queries[key](session, sys.argv[1]).count()} rows, no SQL"
        except Exception as error:
            said = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"{key}: {said} ({time.time() - began:.1f} s)", flush=True)
