"""A graph on disk: the tables ``vertices`` and ``edges`` in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERTICES = "cui string, semtypes string"
EDGES = "src string, rel string, dst string, part int, utt_ids array<string>, edge_count long"


def _as(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(part.split()[0]).cast(part.split()[1]) for part in schema.split(", ")])


def write_graph(vertices: DataFrame, edges: DataFrame, path: str, override: bool = False) -> None:
    """Write a graph; with ``override`` in place of one that is there, else it must not exist."""
    mode = "overwrite" if override else "errorifexists"
    _as(vertices, VERTICES).write.mode(mode).parquet(f"{path}/vertices")
    edges = edges if "part" in edges.columns else edges.withColumn("part", F.lit(0))
    _as(edges, EDGES).write.mode(mode).parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(VERTICES).parquet(f"{path}/vertices"), spark.read.schema(EDGES).parquet(f"{path}/edges")


def read_shards(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of all graphs in a folder, each with its ``shard``: the name of its graph, by which they are in order."""
    shard = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/(?:vertices|edges)/[^/]+$", 1)
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/*/{name}").withColumn("shard", shard)
    return read("vertices", VERTICES), read("edges", EDGES)
