"""Stand-off annotations: segmentation, containment, merging, duplicates, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.constants import ACRONYM, NOUN, whole
from spanloom.functions.spans import in_order, piece, split_spans


def sections(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, sec_no, begin, end)``: the non-empty lines of every text, numbered from 0."""
    spans = documents.select(F.col(key), F.posexplode(split_spans(F.col(text), r"[\n\r]")).alias("sec_no", "span"))
    return spans.select(key, "sec_no", "span.begin", "span.end")


def tokens(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, sent_no, position, begin, end, covered_text)``: the words between blanks of every line; each line counts
    as a sentence, positions count from 1. Narrow: offsets come from folds, not from windows."""
    lines = documents.select(F.col(key), F.col(text).alias("text"), F.posexplode(split_spans(F.col(text), r"[\n\r]")).alias("sent_no", "line"))
    line = piece(F.col("text"), F.col("line.begin"), F.col("line.end"))
    lines = lines.select(key, "sent_no", F.col("line.begin").alias("line_begin"), line.alias("line"))
    words = lines.select(key, "sent_no", "line_begin", "line", F.posexplode(split_spans(F.col("line"), " ")).alias("at", "word"))
    return words.select(
        key, "sent_no", (F.col("at") + 1).alias("position"), (F.col("line_begin") + F.col("word.begin")).alias("begin"),
        (F.col("line_begin") + F.col("word.end")).alias("end"), piece(F.col("line"), F.col("word.begin"), F.col("word.end")).alias("covered_text"),
    )


def is_acronym(word: Column) -> Column:
    return word.rlike(whole(ACRONYM))


def acronym_mentions(tokens: DataFrame, mentions: DataFrame | None = None, key: str = "doc_id", pos_tag: str | None = None) -> DataFrame:
    """Noun tokens that look like acronyms and lie in no mention, as concepts of the source ACRONYM.

    Without a ``pos_tag`` column every token counts as a noun. Mentions are matched by document, then by containment.
    """
    found = tokens.where(is_acronym(F.col("covered_text")))
    if pos_tag:
        found = found.where(F.col(pos_tag).rlike(whole(NOUN)))
    if mentions is not None:
        m = mentions.select(F.col(key).alias("m_key"), F.col("begin").alias("m_begin"), F.col("end").alias("m_end"))
        inside = (F.col(key) == F.col("m_key")) & (F.col("m_begin") <= F.col("begin")) & (F.col("m_end") >= F.col("end"))
        found = found.join(m, inside, "left_anti")
    name = F.upper("covered_text")
    return found.select(
        key, "begin", "end", "covered_text", F.lit("ACRONYM").alias("source"), name.alias("concept_id"),
        name.alias("preferred_label"), F.array(name).alias("synonyms"), F.lit(0.5).alias("score"),
    )


def tokens_of(mentions: DataFrame, tokens: DataFrame, key: list[str], mention: str) -> DataFrame:
    """``(key, mention, token begin, token end)``: the tokens inside a mention; if there are none, the tokens that contain it.

    ``mentions`` has ``key``, a unique ``mention``, ``begin`` and ``end``. One join by key decides both cases; which one holds
    for a mention is told by an aggregation over its matches, so no second join is needed.
    """
    t = tokens.select(*[F.col(k).alias(f"t_{k}") for k in key], F.col("begin").alias("t_begin"), F.col("end").alias("t_end"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"t_{k}") for k in key])
    inside = (F.col("t_begin") >= F.col("begin")) & (F.col("t_end") <= F.col("end"))
    around = (F.col("t_begin") <= F.col("begin")) & (F.col("t_end") >= F.col("end"))
    both = mentions.join(t, same & (inside | around)).select(*key, mention, "t_begin", "t_end", inside.alias("inside"))
    any_inside = F.max("inside").over(Window.partitionBy(mention))
    return both.withColumn("any_inside", any_inside).where(F.col("inside") | ~F.col("any_inside")).drop("inside", "any_inside")


def noun_gate(mentions: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """Mentions with a noun token wholly inside."""
    nouns = tokens.where(F.col("pos_tag").rlike(whole(NOUN))).select(F.col(key).alias("t_key"), F.col("begin").alias("t_begin"), F.col("end").alias("t_end"))
    inside = (F.col(key) == F.col("t_key")) & (F.col("t_begin") >= F.col("begin")) & (F.col("t_end") <= F.col("end"))
    return mentions.join(nouns, inside, "left_semi")


def drop_duplicates(annotations: DataFrame, same: list[str], order: str) -> DataFrame:
    """Of annotations alike in ``same`` the one last by ``order`` (unique)."""
    last = annotations.groupBy(*same).agg(F.max(order).alias(order))
    return annotations.join(last.select(order), order, "left_semi")


def merge_mentions(mentions: DataFrame, key: list[str], order: str) -> DataFrame:
    """One mention per ``key`` with the concept lists of all, in ``order``; repeats stay."""
    lists = F.array_sort(F.collect_list(F.struct(order, "concepts")))
    return mentions.groupBy(*key).agg(F.flatten(F.transform(lists, lambda x: x["concepts"])).alias("concepts"))


def merge_chunks(chunks: DataFrame, key: list[str]) -> DataFrame:
    """Runs of neighbouring chunks of one type (``begin``, ``end``, ``chunk_type``), whatever lies between, made one."""
    order = Window.partitionBy(*key).orderBy("begin")
    starts = (~F.col("chunk_type").eqNullSafe(F.lag("chunk_type").over(order)) | (F.row_number().over(order) == 1)).cast("int")
    numbered = chunks.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order))
    runs = numbered.groupBy(*key, "run").agg(F.min("begin").alias("begin"), F.max_by("end", "begin").alias("end"), F.first("chunk_type").alias("chunk_type"))
    return runs.drop("run")


def suppress_contained(mentions: DataFrame, key: str, order: str) -> DataFrame:
    """Mentions that lie in no longer one of their document, nor in an equal one first by ``order``; partial overlaps stay.

    Containment is transitive, so the greedy choice by length equals one anti join by document.
    """
    o = mentions.select(F.col(key).alias("o_key"), F.col("begin").alias("o_begin"), F.col("end").alias("o_end"), F.col(order).alias("o_order"))
    length, o_length = F.col("end") - F.col("begin"), F.col("o_end") - F.col("o_begin")
    inside = (F.col(key) == F.col("o_key")) & (F.col("o_begin") <= F.col("begin")) & (F.col("o_end") >= F.col("end"))
    return mentions.join(o, inside & ((o_length > length) | ((o_length == length) & (F.col("o_order") < F.col(order)))), "left_anti")


def select_concepts(mentions: DataFrame, threshold: float, source: str = "") -> DataFrame:
    """Concepts scored above ``threshold`` (with a ``source``, only its concepts are held to it); mentions left without
    a concept or with several spans are dropped."""
    keep = (lambda c: c["score"] > threshold) if not source else (lambda c: (c["source"] != source) | (c["score"] > threshold))
    kept = mentions.withColumn("concepts", F.filter("concepts", keep)).where(F.size("concepts") > 0)
    return kept.where(F.size("spans") == 1) if "spans" in mentions.columns else kept


def violations(annotations: DataFrame, spans: str = "spans", single: bool = False, word: str | None = None) -> DataFrame:
    """Annotations that break an invariant, with the reason: no spans, spans out of order, more than one span where
    one is due, a blank in a token."""
    reason = F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, "no spans").when(~in_order(F.col(spans)), "spans out of order")
    if single:
        reason = reason.when(F.size(spans) > 1, "more than one span")
    if word:
        reason = reason.when(F.contains(F.col(word), F.lit(" ")), "blank in token")
    return annotations.withColumn("reason", reason).where("reason is not null")
