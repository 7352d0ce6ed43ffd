"""Several values packed in one field: one row per value, its position kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.packed import packed_items


def explode_packed(df: DataFrame, key: Column | str, packed: Column | str, row_name: str = "row_id") -> DataFrame:
    """``(row_name, pos, item)`` of every value packed in a column, ``pos`` counting from 1.

    A narrow projection: no shuffle, no Python, only the two columns are read. Rows with a null, blank or empty
    field give no rows; a null key stays null; repeated rows and values all stay; other columns do not take part, so
    their names cannot clash. Splitting follows :func:`spanloom.functions.packed.packed_items`.
    """
    key = F.col(key) if isinstance(key, str) else key
    packed = F.col(packed) if isinstance(packed, str) else packed
    found = df.select(key.alias(row_name), F.posexplode(packed_items(packed)).alias("pos", "item"))
    return found.select(row_name, (F.col("pos") + 1).alias("pos"), "item")
