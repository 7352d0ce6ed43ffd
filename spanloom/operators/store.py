"""The annotation store: annotations of all types in one long table, each listed under its type and its supertypes.

Columns: ``doc_id``, ``ann_type`` (its own type), ``listed_under`` (types it is found by), ``seq`` (order of insertion in its
document), ``spans`` (array of ``begin, end``) and ``fields`` (its other values by name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.spans import all_within

STORE = "doc_id string, ann_type string, listed_under array<string>, seq bigint, spans array<struct<begin:int,end:int>>, fields map<string,string>"


def lineage(ann_type: str, parents: dict[str, str]) -> list[str]:
    """A type and its supertypes upwards; ``parents`` has the direct one of each type that has one."""
    found = [ann_type]
    while (above := parents.get(found[-1])) is not None:
        if above in found:
            raise ValueError(f"{above} is a supertype of itself")
        found.append(above)
    return found


def as_annotations(rows: DataFrame, ann_type: str, key: str, spans: Column, seq: str, fields: tuple[str, ...] = (), parents: dict[str, str] | None = None) -> DataFrame:
    """Rows as annotations of a type, listed under it and its supertypes. ``fields`` are kept as strings, nulls left out."""
    pairs = [F.struct(F.lit(name).alias("key"), F.col(name).cast("string").alias("value")) for name in fields]
    kept = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()) if pairs else F.expr("cast(array() as array<struct<key:string,value:string>>)")
    return rows.select(
        F.col(key).cast("string").alias("doc_id"), F.lit(ann_type).alias("ann_type"),
        F.array(*[F.lit(t) for t in lineage(ann_type, parents or {})]).alias("listed_under"), F.col(seq).cast("bigint").alias("seq"),
        spans.cast("array<struct<begin:int,end:int>>").alias("spans"), F.map_from_entries(kept).alias("fields"),
    )


def insert(store: DataFrame, annotations: DataFrame) -> DataFrame:
    """The store with annotations added; equal ones stay side by side."""
    return store.unionByName(annotations)


def of_type(store: DataFrame, ann_type: str) -> DataFrame:
    """Annotations of a type or a subtype of it; the scan takes over the filter on the type itself."""
    return store.where(F.array_contains("listed_under", ann_type))


def listings(store: DataFrame) -> DataFrame:
    """All annotations once for each type they are listed under, as ``listed_as``."""
    return store.withColumn("listed_as", F.explode("listed_under"))


def listings_between(store: DataFrame, low: Column | int, high: Column | int) -> DataFrame:
    """Listings whose annotation lies inside ``[low, high]`` of its document."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return listings(store.where((F.size("spans") > 0) & all_within(F.col("spans"), low, high)))


def remove_type(store: DataFrame, ann_type: str) -> DataFrame:
    """The store without the list of a type: an annotation that is listed under another type too stays there."""
    left = store.withColumn("listed_under", F.array_remove("listed_under", ann_type))
    return left.where(F.size("listed_under") > 0)


def remove_all(store: DataFrame) -> DataFrame:
    return store.limit(0)


def sentences_of_sections(sections: DataFrame, sentences: DataFrame, key: str = "doc_id", section: str = "sec_no", sentence: str = "sent_no") -> DataFrame:
    """``(key, section, sentence, begin, end)`` of the sentences that lie inside a section.

    One join by document. Sections and sentences follow each other in a text, so the containment left over in the join meets
    as many pairs as a document has of both.
    """
    s = sections.select(F.col(key), F.col(section), F.col("begin").alias("sec_begin"), F.col("end").alias("sec_end"))
    inside = (F.col("begin") >= F.col("sec_begin")) & (F.col("end") <= F.col("sec_end"))
    return s.join(sentences.select(key, sentence, "begin", "end"), key).where(inside).select(key, section, sentence, "begin", "end")


def by_layer(store: DataFrame, types: list[str]) -> DataFrame:
    """``(doc_id, <type>s ...)``: per document one array of annotations for each type, in order of insertion.

    The arrays are of a document's own annotations of that type, which the document itself bounds."""
    own = F.struct("seq", "spans", "fields")
    layers = [
        F.transform(F.array_sort(F.collect_list(F.when(F.array_contains("listed_under", t), own)), lambda a, b: (a["seq"] - b["seq"]).cast("int")), lambda x: F.struct(x["spans"].alias("spans"), x["fields"].alias("fields"))).alias(f"{t}s")
        for t in types
    ]
    return store.groupBy("doc_id").agg(*layers)
