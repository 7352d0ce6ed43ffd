"""Relation extraction: mentions and parsed sentences to evidence for graph edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.constants import NOUN, whole
from spanloom.functions.let import let
from spanloom.operators.graph import vertex_semtypes
from spanloom.operators.relations import clean_path, path_nodes, print_path
from spanloom.operators.trees import dependency_path, root_paths, shallowest


def placed(mentions: Column, tokens: Column, paths: Column) -> Column:
    """Of a sentence's ``mentions`` those with a noun inside, with the ``positions`` of their own tokens and their shallowest one, ``top``.

    Tokens inside the mention count, or if there are none the tokens around it.
    """
    def place(m: Column) -> Column:
        inside = F.filter(tokens, lambda t: (t["begin"] >= m["begin"]) & (t["end"] <= m["end"]))
        around = F.filter(tokens, lambda t: (t["begin"] <= m["begin"]) & (t["end"] >= m["end"]))

        def own(within: Column) -> Column:
            noun = F.exists(within, lambda t: t["pos_tag"].rlike(whole(NOUN)))
            chosen = F.transform(F.when(F.size(within) > 0, within).otherwise(around), lambda t: t["position"].cast("int"))
            known = lambda p: F.struct(m["begin"].alias("begin"), p.alias("positions"), shallowest(p, paths).alias("top"), m["concepts"].alias("concepts"))
            return F.when(noun, let(chosen, lambda p: F.when(F.size(p) > 0, known(p))))

        return let(inside, own)

    return F.filter(F.transform(mentions, place), lambda m: m.isNotNull())


def labelled_pairs(mentions: Column, tokens: Column, paths: Column) -> Column:
    """``(rel, one, two)`` of every two mentions, the first of which begins before the second, that a labelled path joins; ``one``
    and ``two`` are their concepts."""
    def label(one: Column, two: Column) -> Column:
        path = dependency_path(paths, one["top"], two["top"], one["positions"], two["positions"])
        nodes = let(path, lambda p: F.when(p.isNotNull(), path_nodes(tokens, paths, p)))
        return let(clean_path(nodes), lambda done: F.when(done.isNotNull(), print_path(done, tokens)))

    def pairs(known: Column) -> Column:
        behind = lambda one: F.filter(known, lambda two: one["begin"] < two["begin"])
        both = lambda one: F.transform(behind(one), lambda two: F.struct(label(one, two).alias("rel"), one["concepts"].alias("one"), two["concepts"].alias("two")))
        return F.filter(F.flatten(F.transform(known, both)), lambda x: x["rel"].isNotNull())

    return let(placed(mentions, tokens, paths), pairs)


def only(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Rows for which ``value`` is not null, with it as ``name``. By unfolding an array of none or one, as a filter would be
    moved in front of the projection and ``value`` worked out twice."""
    return df.withColumn(name, F.explode(F.filter(F.array(value), lambda x: x.isNotNull())))


def relation_evidence(mentions: DataFrame, sentences: DataFrame, key: str) -> DataFrame:
    """``(src, rel, dst, utt_id, src_semtypes, dst_semtypes)`` of every pair of concepts whose mentions a labelled path joins.

    ``sentences`` has ``key``, ``sent_no`` and ``tokens`` (position, begin, end, covered_text, lemma, pos_tag, dep_tag, depends_on). A
    document's mentions, which it bounds, meet its sentences in one join; pairs, paths and labels are worked out within the
    sentence's own row, root paths once for all its pairs, and only what is labelled is unfolded.
    """
    own = mentions.groupBy(key).agg(F.collect_list(F.struct("begin", "end", "concepts")).alias("mentions"))
    both = sentences.select(key, "sent_no", "tokens").join(own, key)
    found = let(root_paths(F.col("tokens")), lambda paths: labelled_pairs(F.col("mentions"), F.col("tokens"), paths))
    each = both.select(F.col(key).alias("utt_id"), F.explode(found).alias("x")).select("utt_id", "x.rel", F.explode("x.one").alias("c1"), "x.two")
    two = each.select("utt_id", "rel", "c1", F.explode("two").alias("c2"))
    return two.select(
        F.col("c1.concept_id").alias("src"), "rel", F.col("c2.concept_id").alias("dst"), "utt_id",
        vertex_semtypes(F.col("c1.semtypes")).alias("src_semtypes"), vertex_semtypes(F.col("c2.semtypes")).alias("dst_semtypes"),
    )
