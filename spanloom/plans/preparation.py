"""Queries over the preparation operators: damaged records, packed fields, small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import clean_text
from spanloom.operators.compact import Policy, compact_directory, compact_records, first_deliveries, read_table, small_file_partitions, vacuum
from spanloom.operators.packed import explode_packed
from spanloom.session import shared_path, table
from spanloom.sources.mmo import load_records, read_machine_output, record_id, rejected_records


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = rejected_records(table(spark, sf_dir, "mmo_records"))
    return rejected.select(F.col("record_key").alias("record_id"))


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected records with where they came from, the reason and how far reading came."""
    rejected = rejected_records(table(spark, sf_dir, "mmo_records"), keep=("source_file",))
    return rejected.select(F.col("record_key").alias("record_id"), "source_file", "record_offset", "reason", "reason_offset")


def p2_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records that p2_found leaves, as utterances; mappings that cannot be read are null, with the reason."""
    return load_records(table(spark, sf_dir, "mmo_records"), with_mappings=True)


def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheap id test of every raw record."""
    return table(spark, sf_dir, "mmo_records").select("record_id", record_id(F.col("rec_text")).alias("utt_id"))


def framed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records written to gzip'd text files and framed anew: how many end as they should, and how many are no UTF-8."""
    path = shared_path(spark, "machine-output")
    table(spark, sf_dir, "mmo_records").where("rec_text is not null").select("rec_text").write.text(path, compression="gzip")
    framed = read_machine_output(spark, f"{path}/*.gz")
    return framed.agg(F.count(F.when(F.col("problem").isNull(), 1)).alias("n"), F.count(F.when(F.col("problem") == "encoding", 1)).alias("broken"))


def packed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    utts = explode_packed(table(spark, sf_dir, "edges"), "edge_id", "utt_ids")
    types = explode_packed(table(spark, sf_dir, "vertices"), "vertex_id", "semtypes")
    return utts.select(F.lit("edge.uttIds").alias("field_name"), "*").unionByName(
        types.select(F.lit("vertex.semtypes").alias("field_name"), "*")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_values(spark, sf_dir)


def with_folder(records: DataFrame) -> DataFrame:
    return records.withColumn("folder", F.regexp_extract("file_path", r"^(.*)/", 1))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = with_folder(table(spark, sf_dir, "annotated_texts"))
    keep = first_deliveries(records, [F.col("id"), clean_text(F.col("text"))], ["file_path", "rec_no"])
    target = shared_path(spark, "annotated-texts")
    kept = compact_records(records, target, "folder", "file_path", "n_bytes", keep, ("file_path", "rec_no"))
    return kept.select("file_path", "rec_no")


def p5_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders with too many small files and the number of files they are to have."""
    records = with_folder(table(spark, sf_dir, "annotated_texts"))
    return small_file_partitions(records, Policy(), "folder", "file_path", "n_bytes")


def p5_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records, laid down in many small files by a part of the folder's digest and compacted in place."""
    records = with_folder(table(spark, sf_dir, "annotated_texts"))
    path = shared_path(spark, "annotated-texts")
    part = F.substring(F.sha2(F.coalesce("folder", F.lit("")), 256), 1, 1)
    records.withColumn("part", part).repartition(24, "file_path").write.partitionBy("part").parquet(path)
    compact_directory(spark, path, "part")
    vacuum(spark, path)
    return read_table(spark, path).select("file_path", "rec_no")


QUERIES = {
    "record_ids": record_ids,
    "framed_records": framed_records,
    "p2_found": p2_found,
    "p2_reasons": p2_reasons,
    "p2_utterances": p2_utterances,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_layout": p5_layout,
    "p5_in_place": p5_in_place,
}

ITEMS = r"""regexp_extract_all({0}, '"(?:[^"\\]|\\"|""|\\)*"|''[^'']*''|[\p{{L}}\p{{N}}._-]+')"""
PLAIN = r"""case when x[1] = '"' then regexp_replace(x[2:-2], '""|\\"', '"', 'g') when x[1] = '''' then x[2:-2] else x end"""
UNPACK = (
    "select {1} as row_id, unnest(range(1, len(l) + 1))::int as pos, unnest(l) as item from (select {1}, "
    f"list_filter(list_transform({ITEMS}, lambda x: {PLAIN}), lambda x: x <> '') as l from {{2}})"
)

SQL = {
    "record_ids": r"select record_id, regexp_extract(rec_text, 'utterance\(''([^'']+)'',', 1) as utt_id from mmo_records",
    "framed_records": "select coalesce(sum(len(list_filter(string_split(rec_text, chr(10)), lambda x: x = chr(39) || 'EOU' || chr(39) || '.'))), 0)::bigint as n, 0::bigint as broken from mmo_records",
    "p4_found": "select 'edge.uttIds' as field_name, * from (" + UNPACK.format("utt_ids", "edge_id", "edges") + ") union all "
    "select 'vertex.semtypes' as field_name, * from (" + UNPACK.format("semtypes", "vertex_id", "vertices") + ")",
    "p5_found": r"""select file_path, rec_no from (select file_path, rec_no, row_number() over (partition by id,
        regexp_replace(regexp_replace(replace(text, '’', ''''), '([^\s])(:)([^\s])', '\1 \2 \3', 'g'), ' {2,}', ' ', 'g')
        order by file_path, rec_no) as k from annotated_texts) where k = 1""",
    "p5_in_place": "select file_path, rec_no from annotated_texts",
    "p5_layout": r"""select folder, count(*) as n_files, sum((b < 16777216)::int)::bigint as n_small, sum(b)::bigint as n_bytes,
        greatest(ceil(sum(b) / 134217728), 1)::int as n_out from (select regexp_extract(file_path, '^(.*)/', 1) as folder,
        file_path, sum(coalesce(n_bytes, 0)) as b from annotated_texts group by 1, 2) group by 1
        having sum((b < 16777216)::int) > 8""",
}
