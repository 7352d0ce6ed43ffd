"""The property graph as tables: evidence, edges, vertices, loading, merging, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.constants import SELECTED_SEMTYPES
from spanloom.session import stored


#: Ids one row of an edge holds at most; an edge with more has several rows, its parts.
MOST_IDS = 100_000
EDGE = ["src", "rel", "dst"]


def _hubs(counts: DataFrame, most_ids: int) -> DataFrame:
    """``(src, rel, dst, total, parts)`` of edges with more ids than a row holds: at most one edge for every ``most_ids`` ids there are."""
    parts = F.ceil(F.col("total") / most_ids).cast("int")
    return counts.where(F.col("total") > most_ids).select(*EDGE, "total", parts.alias("parts"))


def upsert_edges(evidence: DataFrame, most_ids: int = MOST_IDS) -> DataFrame:
    """``(src, rel, dst, part, utt_ids, edge_count)`` from ``(src, rel, dst, utt_id)``: each utterance counts once for an edge.

    Evidence is made distinct first, which combines before the shuffle, so a hub's repeats never travel. An edge is one row,
    part 0, unless it has more than ``most_ids`` ids: then they are parted by their hash into rows of about ``most_ids``, so
    no task collects a hub's whole list. ``edge_count`` is the edge's whole count in each of them.
    """
    once = stored(evidence.select(*EDGE, "utt_id").distinct(), "evidence")
    hubs = _hubs(once.groupBy(*EDGE).agg(F.count("*").alias("total")), most_ids)
    part = F.coalesce(F.pmod(F.xxhash64("utt_id"), F.col("parts")), F.lit(0)).cast("int")
    rows = once.join(hubs, EDGE, "left").withColumn("part", part)
    ids = F.array_sort(F.collect_list("utt_id"))
    return rows.groupBy(*EDGE, "part").agg(ids.alias("utt_ids"), F.coalesce(F.first("total"), F.count("*")).alias("edge_count"))


def edge_counts(evidence: DataFrame) -> DataFrame:
    """Edges with their counts only, for hubs whose id lists are not wanted."""
    return evidence.select("src", "rel", "dst", "utt_id").distinct().groupBy("src", "rel", "dst").agg(F.count("utt_id").alias("edge_count"))


def first_vertices(vertices: DataFrame, order: list[str]) -> DataFrame:
    """One vertex per ``cui`` with the ``semtypes`` written first by ``order``; a null can be first."""
    first = F.min(F.struct(*order, F.col("semtypes").alias("value")))
    return vertices.groupBy("cui").agg(first.alias("first")).select("cui", F.col("first.value").alias("semtypes"))


def vertex_semtypes(semtypes, selected: list[str] | None = None):
    """The selected ones of an array of semantic types, sorted, as a comma list (may be empty)."""
    chosen = F.array(*[F.lit(s) for s in (SELECTED_SEMTYPES if selected is None else selected)])
    return F.array_join(F.array_sort(F.array_intersect(semtypes, chosen)), ",")


def load_relations(rows: DataFrame, whitelist: DataFrame | list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges and vertices of curated relations ``(cui1, cui2, rel)`` whose ``rel`` is in the whitelist.

    Every row is an edge of its own, of count 1 from ``umls``; vertices have no semantic types.
    """
    if isinstance(whitelist, list):
        kept = rows.where(F.col("rel").isin(whitelist))
    else:
        kept = rows.join(whitelist.select(F.col(whitelist.columns[0]).alias("rel")).distinct(), "rel", "left_semi")
    edges = kept.select(F.col("cui1").alias("src"), "rel", F.col("cui2").alias("dst"), F.array(F.lit("umls")).alias("utt_ids"), F.lit(1).alias("edge_count"))
    vertices = kept.select(F.explode(F.array("cui1", "cui2")).alias("cui")).distinct().select("cui", F.lit(None).cast("string").alias("semtypes"))
    return edges, vertices


def merge_edges(shards: DataFrame, most_ids: int = MOST_IDS) -> DataFrame:
    """Edges of many shards made one: counts added (null as 0), ids of all shards kept with repeats, loops left out.

    ``shards`` has ``src``, ``rel``, ``dst``, ``utt_ids`` (array) and ``edge_count``, and may have ``part``: an edge's count is that of
    its part 0. The result is parted like that of :func:`upsert_edges`: a shard's array is split by the ids' hash where it
    lies, and what a task puts together is a part.
    """
    apart = shards.where("src <> dst")
    count = F.coalesce("edge_count", F.lit(0))
    if "part" in shards.columns:
        count = F.when(F.coalesce("part", F.lit(0)) == 0, count).otherwise(0)
    rows = apart.select(*EDGE, "utt_ids", count.alias("edge_count"))
    hubs = _hubs(rows.groupBy(*EDGE).agg(F.sum(F.greatest(F.coalesce(F.size("utt_ids"), F.lit(0)), F.lit(0))).alias("total")), most_ids)
    of_part = lambda p: F.filter("utt_ids", lambda x: F.pmod(F.xxhash64(x), F.col("parts")) == p)
    split = F.when(F.col("parts").isNull(), F.array("utt_ids")).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), of_part))
    each = rows.join(hubs, EDGE, "left").select(*EDGE, "edge_count", F.posexplode(split).alias("part", "ids"))
    ids = F.array_sort(F.flatten(F.collect_list("ids")))
    return each.groupBy(*EDGE, "part").agg(F.sum("edge_count").alias("edge_count"), ids.alias("utt_ids"))


def processed_ids(edges: DataFrame) -> DataFrame:
    """The different ids in the edges' ``utt_ids`` arrays (with ``umls``, where curated edges are among them)."""
    return edges.select(F.explode("utt_ids").alias("utt_id")).distinct()


def unprocessed(utterances: DataFrame, processed: DataFrame, key: str = "utt_id") -> DataFrame:
    return utterances.join(processed.select(F.col(processed.columns[0]).alias(key)), key, "left_anti")


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """``rel`` of a file that lists relations, one a line; blank lines and repeats do not count."""
    lines = spark.read.text(path).select(F.trim("value").alias("rel"))
    return lines.where("rel <> ''").distinct()


def vertex(vertices: DataFrame, cui: str) -> DataFrame:
    return vertices.where(F.col("cui") == cui).limit(1)


def out_edges(edges: DataFrame, cui: str, rel: str | None = None) -> DataFrame:
    """Outgoing edges of a vertex, of one relation or all; a filter the scan takes over."""
    found = edges.where(F.col("src") == cui)
    return found if rel is None else found.where(F.col("rel") == rel)
