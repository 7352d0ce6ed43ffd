"""Compaction of tables that lie in very many tiny files."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from spanloom.session import remove, stored
from spanloom.sources.files import locate

NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
#: A file of a table, its size, and the value of the partition it lies in.
FILES = "data_file string, bytes bigint, plan_partition string"


class ConflictError(RuntimeError):
    """Another writer changed the table after its snapshot was taken."""


@dataclass(frozen=True)
class Policy:
    """A file under ``small_bytes`` is small; a partition with more than ``max_small_files`` of them is rewritten
    into files of about ``target_bytes``."""

    small_bytes: int = 16 << 20
    max_small_files: int = 8
    target_bytes: int = 128 << 20


class Snapshots:
    """Numbered snapshots of a table of Parquet files, as files ``_snapshots/vN.json`` below it.

    A snapshot names two lists, tables themselves: ``live``, files below ``_data`` that belong to the table, and ``retired``,
    other files below the table that do not any more. All other files below the table belong to it, so writers that know
    nothing of snapshots can add some. A snapshot is written aside and renamed to its number, which fails if there is
    one already, as the log of a stream does it; so it is there whole or not at all, and of two writers one wins.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = f"{self.path}/_snapshots"
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def latest(self) -> int:
        """The number of the newest snapshot, 0 if there is none."""
        if not self._fs.exists(self._path(self.folder)):
            return 0
        names = [status.getPath().getName() for status in self._fs.listStatus(self._path(self.folder))]
        return max((int(name[1:-5]) for name in names if name.startswith("v") and name.endswith(".json")), default=0)

    def check(self, base: int) -> None:
        if self.latest() != base:
            raise ConflictError(f"snapshot {self.latest()} was committed after {base}")

    def _manifest(self, version: int) -> dict:
        if not version:
            return {}
        source = self._fs.open(self._path(f"{self.folder}/v{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def files(self, version: int, kind: str) -> DataFrame | None:
        """``(data_file, bytes, plan_partition)`` of the ``live`` or ``retired`` files of a snapshot."""
        folder = self._manifest(version).get(kind)
        return self.spark.read.schema(FILES).parquet(folder) if folder else None

    def commit(self, base: int, live: DataFrame | None = None, retired: DataFrame | None = None, **facts: object) -> int:
        """Make the snapshot after ``base``; :class:`ConflictError` if somebody else did so first."""
        self.check(base)
        manifest: dict[str, object] = {"version": base + 1, **facts}
        for kind, files in (("live", live), ("retired", retired)):
            if files is not None:
                manifest[kind] = f"{self.folder}/{kind}-{uuid.uuid4().hex}"
                files.write.parquet(manifest[kind])
        aside, target = (self._path(f"{self.folder}/{name}") for name in (f".{uuid.uuid4().hex}", f"v{base + 1}.json"))
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(target), no_overwrite)
        except Exception as error:  # the number is taken
            self._fs.delete(aside, False)
            raise ConflictError(f"snapshot {base + 1} was committed by another writer") from error
        return base + 1

    def _below(self, folder: str = "") -> DataFrame | None:
        """The rows of the files that lie below the table now, and of no others that may come; None if there is none."""
        where = self._path(f"{self.path}{folder}")
        if not self._fs.exists(where) or not any(not s.getPath().getName().startswith(("_", ".")) for s in self._fs.listStatus(where)):
            return None
        self.spark.catalog.refreshByPath(f"{self.path}{folder}")
        try:
            return self.spark.read.parquet(f"{self.path}{folder}")
        except AnalysisException as error:
            if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # folders that hold no file any more
                return None
            raise

    def listed(self, folder: str = "", partition: str | None = None) -> DataFrame:
        """``(data_file, bytes, plan_partition)`` of the Parquet files that lie below the table now."""
        return self._measured(self._below(folder), partition)

    def _measured(self, rows: DataFrame | None, partition: str | None) -> DataFrame:
        """The files that ``rows`` read. Their names come from the planner's own listing, their sizes are asked by the executors;
        the partition's value is that in the path as the column has it."""
        if rows is None:
            return self.spark.createDataFrame([], FILES)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, values = [], []
                for file in batch.column(0).to_pylist():
                    system, inner = locate(file)
                    sizes.append(system.get_file_info(inner).size)
                    found = re.findall(rf"/{re.escape(partition)}=([^/]*)/", unquote(file)) if partition else []
                    values.append(unquote(found[-1]) if found and found[-1] != NULL_FOLDER else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(values, pa.string())], names=["data_file", "bytes", "plan_partition"])

        names = self.spark.createDataFrame([(name,) for name in rows.inputFiles()], "data_file string")
        kind = rows.schema[partition].dataType.simpleString() if partition else "string"
        return names.mapInArrow(measure, FILES).withColumn("plan_partition", F.col("plan_partition").cast(kind).cast("string"))

    def table(self, version: int | None = None) -> DataFrame | None:
        """The table as a snapshot has it (the newest unless told), None if no file belongs to it."""
        version = self.latest() if version is None else version
        parts = [part for part in (self.others(version)[0], self.read(self.files(version, "live"))) if part is not None]
        return reduce(lambda a, b: a.unionByName(b.select(*[F.col(c).cast(t) for c, t in a.dtypes])), parts) if parts else None

    def others(self, version: int, partition: str | None = None) -> tuple[DataFrame | None, DataFrame]:
        """The rows of the files that are not below ``_data`` and belong to the table, and these files. The rows stay those of the
        files listed here, whatever comes later."""
        rows, retired = self._below(), self.files(version, "retired")
        files = self._measured(rows, partition)
        if retired is None or rows is None:
            return rows, stored(files, "listed-files")
        files = stored(files.join(retired.select("data_file"), "data_file", "left_anti"), "listed-files")
        return self.read(files, self.path), files

    def read(self, files: DataFrame | None, base: str | None = None) -> DataFrame | None:
        """The rows of some files, whose names are collected, as the planner of any scan does; None if there is none."""
        names = [self._plain(row[0]) for row in files.select("data_file").collect()] if files is not None else []
        if not names:
            return None
        rows = self.spark.read.option("basePath", base or f"{self.path}/_data").parquet(*names)
        return rows if base else rows.drop("gen")

    def _plain(self, file: str) -> str:
        """A file's name as readers take it: of the URI in ``_metadata.file_path`` the path itself, glob signs escaped."""
        name = self._jvm.org.apache.hadoop.fs.Path(self._jvm.java.net.URI(file)).toString()
        return re.sub(r"([\[\]{}*?\\])", r"\\\1", name)

    def vacuum(self) -> int:
        """Delete the files that the newest snapshot retired, and generations below ``_data`` of which it has no file, as a
        compaction that broke off leaves them. Files are deleted by the executors. Readers of older snapshots must be done,
        and no compaction may be running."""
        version = self.latest()
        retired, live = self.files(version, "retired"), self.files(version, "live")
        gone = self.listed("/_data") if live is None else self.listed("/_data").join(live, "data_file", "left_anti")
        gone = gone if retired is None else gone.unionByName(retired)

        def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file in batch.column(0).to_pylist():
                    system, inner = locate(file)
                    if system.get_file_info(inner).type.name == "File":
                        system.delete_file(inner)
                yield batch

        n = gone.select("data_file").mapInArrow(delete, "data_file string").count()
        self.spark.catalog.refreshByPath(self.path)
        if retired is not None:
            self.commit(version, live)
        return n


def small_file_partitions(records: DataFrame, policy: Policy, partition: str, file: str, size: str) -> DataFrame:
    """``(partition, n_files, n_small, n_bytes, n_out)`` of the partitions that hold too many small files.

    Two aggregations over three narrow columns, first by file and then by partition; both combine before they shuffle,
    so neither a huge file nor a partition with a third of all files meets in one task unaggregated.
    """
    files = records.groupBy(partition, file).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("file_bytes"))
    small = F.sum((F.col("file_bytes") < policy.small_bytes).cast("bigint"))
    return (
        files.groupBy(partition)
        .agg(F.count("*").alias("n_files"), small.alias("n_small"), F.sum("file_bytes").alias("n_bytes"))
        .where(F.col("n_small") > policy.max_small_files)
        .withColumn("n_out", F.greatest(F.ceil(F.col("n_bytes") / policy.target_bytes), F.lit(1)).cast("int"))
    )


def first_deliveries(records: DataFrame, same: list[Column], key: list[str]) -> DataFrame:
    """The smallest ``key`` of each set of records that are alike in ``same`` (null equals null).

    Long values take part as their SHA-256, so that no text is shuffled; a record delivered any number of times is
    combined before the shuffle.
    """
    digests = [F.sha2(value.cast("string"), 256).alias(f"same_{i}") for i, value in enumerate(same)]
    narrow = records.select(*digests, F.struct(*key).alias("key"))
    return narrow.groupBy(*[f"same_{i}" for i in range(len(same))]).agg(F.min("key").alias("key")).select("key.*")


def compact_records(
    records: DataFrame,
    target: str,
    partition: str,
    file: str,
    size: str,
    keep: DataFrame | None = None,
    key: tuple[str, ...] = (),
    policy: Policy = Policy(),
) -> DataFrame:
    """Write the overloaded partitions of ``records`` into few files below ``target`` and return all records.

    ``records`` are a table in which each row names its ``partition``, ``file`` and ``size``. Only partitions that
    :func:`small_file_partitions` finds are rewritten, by dynamic partition overwrite; the others are passed on as they
    lie. With ``keep`` (keys of the records to keep, unique) all other records are left out of either. A rewritten
    partition is spread over the files planned for it by a hash of the key, each of them another task's work, so one that holds a
    third of all rows is many tasks' work. Folders are named after a digest of the value (``null`` for null) and the value
    itself is stored in the files: a folder named after the value would be read back as null for an empty one. New files
    lie below ``_data`` and belong to the table once a snapshot says so; if another writer has made one since the start,
    :class:`ConflictError` is raised and nothing has changed. Null and empty partitions, files and sizes are values like
    others; an empty table gives an empty result; other columns are carried along.
    """
    spark = records.sparkSession
    snapshots = Snapshots(spark, target)
    base = snapshots.latest()
    plan = stored(small_file_partitions(records, policy, partition, file, size), "compaction-plan")
    planned = numbered(plan.select(F.col(partition).alias("plan_partition"), "n_out"))
    same = F.col(partition).eqNullSafe(F.col("plan_partition"))

    keys = stored(keep.select(*[F.col(name).alias(f"keep_{name}") for name in key]), "kept-keys") if keep is not None else None

    def kept(part: DataFrame) -> DataFrame:
        if keys is None:
            return part
        match = [F.col(name).eqNullSafe(F.col(f"keep_{name}")) for name in key]
        return part.join(keys, match, "left_semi")

    if not plan.limit(1).count():
        return kept(records)
    folder = F.coalesce(F.sha2(F.col(partition).cast("string"), 256), F.lit("null"))
    rewritten = kept(records.join(planned, same).drop("plan_partition").withColumn("plan_folder", folder))
    generation = write_generation(rewritten, target, "plan_folder", list(key or (file,)), plan, policy)
    new = stored(snapshots.listed(f"/_data/{generation.rpartition('/')[2]}", "plan_folder"), "new-files")
    older = snapshots.files(base, "live")
    live = new if older is None else new.unionByName(older.join(new.select("plan_partition").distinct(), "plan_partition", "left_anti"))
    try:
        snapshots.commit(base, live, policy=asdict(policy), partition=partition)
    except ConflictError:
        remove(spark, generation)
        raise
    fresh = spark.read.schema(records.schema).parquet(generation).select(*records.columns)
    return fresh.unionByName(kept(records.join(planned.select("plan_partition"), same, "left_anti")))


def numbered(plan: DataFrame) -> DataFrame:
    """``plan`` with ``before``, the files that the partitions in front of each have. One row a partition that is rewritten, which
    the listing of a table's folders holds as well, so the sum over all of them is one task's work."""
    return plan.withColumn("before", F.sum("n_out").over(Window.orderBy("plan_partition")) - F.col("n_out"))


def write_generation(rows: DataFrame, path: str, folder: str, spread: list[str], plan: DataFrame, policy: Policy) -> str:
    """Write ``rows`` (with ``n_out`` and ``before`` of their partition) below ``_data`` in a folder of their own and return that.

    A row's file in its partition is a hash of its ``spread`` columns. Files are numbered through, and the number tells the
    task: there are as many tasks as the largest partition has files, and as files of the target size there are in all,
    so no two files of a partition meet in a task and become one, and small partitions share tasks. Partitions are
    overwritten dynamically, so that a job run again after a failure leaves its files once.
    """
    generation = f"{path.rstrip('/')}/_data/gen={uuid.uuid4().hex}"
    total, most, size = plan.agg(F.sum("n_out"), F.max("n_out"), F.sum("n_bytes")).first()
    cores = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(most or 1, -(-(size or 0) // policy.target_bytes), min(total or 1, cores))
    number = F.col("before") + F.pmod(F.xxhash64(*[F.col(name) for name in spread]), F.col("n_out"))
    writer = rows.repartitionById(tasks, F.pmod(number, F.lit(tasks)).cast("int")).drop("n_out", "before").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(folder).parquet(generation)
    return generation


def compact_directory(spark: SparkSession, path: str, partition: str, policy: Policy = Policy()) -> dict:
    """Compact a Parquet directory partitioned by ``partition``; returns what was done, file sizes as measured afterwards.

    Finds partitions with too many small files from the files' own names and sizes, reads exactly the files listed, and
    writes their rows into new files below ``_data``, which nobody sees. Then one snapshot makes the new files live and
    retires the old ones, both at once: readers by :func:`read_table` see the table before or after it and nothing in
    between, a run that breaks off has changed nothing, files that others add meanwhile stay, and of two compactors one
    fails with :class:`ConflictError` and leaves no files. Old files are deleted by :func:`vacuum`. Other partitions are not
    touched. Rows, repeated ones too, stay as they are. With nothing to do no snapshot is made.
    """
    snapshots = Snapshots(spark, path)
    base = snapshots.latest()
    rows, files = snapshots.others(base, partition)
    live, retired = snapshots.files(base, "live"), snapshots.files(base, "retired")
    every = files if live is None else files.unionByName(live)
    plan = stored(small_file_partitions(every, policy, "plan_partition", "data_file", "bytes"), "compaction-plan")
    todo = plan.agg(F.count("*"), F.sum("n_files")).first()
    if not todo[0]:
        return {"version": base, "partitions": 0, "files_before": 0, "files_after": 0, "largest_bytes": 0}
    chosen = plan.select(F.col("plan_partition").alias("chosen"))
    of_plan = F.col("plan_partition").eqNullSafe(F.col("chosen"))
    replaced = stored(files.join(chosen, of_plan, "left_semi"), "compaction-files")
    lives = live.join(chosen, of_plan, "left_semi") if live is not None else None
    planned = numbered(plan.select("plan_partition", "n_out"))
    same = F.col(partition).cast("string").eqNullSafe(F.col("plan_partition"))
    parts = [part for part in (rows, snapshots.read(lives)) if part is not None]
    both = reduce(lambda a, b: a.unionByName(b.select(*[F.col(c).cast(t) for c, t in a.dtypes])), parts)
    generation = write_generation(both.join(planned, same).drop("plan_partition"), path, partition, both.columns, plan, policy)
    new = stored(snapshots.listed(f"/_data/{generation.rpartition('/')[2]}", partition), "new-files")
    kept = new if live is None else new.unionByName(live.join(chosen, of_plan, "left_anti"))
    gone = replaced if retired is None else replaced.unionByName(retired)
    try:
        if replaced.join(snapshots.listed("", partition), "data_file", "left_anti").limit(1).count():
            raise ConflictError(f"files below {path} were deleted during the compaction")
        version = snapshots.commit(base, kept, gone, policy=asdict(policy), partitions=todo[0])
    except ConflictError:
        remove(spark, generation)
        raise
    after = new.agg(F.count("*"), F.max("bytes")).first()
    return {"version": version, "partitions": todo[0], "files_before": todo[1], "files_after": after[0], "largest_bytes": after[1]}


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A table that :func:`compact_directory` looks after, as its newest snapshot or an earlier one has it."""
    return Snapshots(spark, path).table(version)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete files that no longer belong to a table; returns how many there were."""
    return Snapshots(spark, path).vacuum()
