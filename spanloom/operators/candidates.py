"""From parsed utterances to mentions: best candidates, overlaps, bounds, admission, relocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.constants import SELECTED_SEMTYPES
from spanloom.functions.let import let
from spanloom.functions.spans import piece, relocate, resolve_overlaps
from spanloom.functions.text import clean_text


def candidate_positions(utterances: DataFrame, key: str = "row_id") -> DataFrame:
    """``(key, phrase_no, cand_no, begin, size, score, cui, semtypes)``: one row per position of a candidate."""
    phrases = utterances.select(key, F.posexplode("phrases").alias("phrase_no", "phrase"))
    each = phrases.select(key, "phrase_no", F.posexplode("phrase.candidates").alias("cand_no", "c"))
    at = each.select(key, "phrase_no", "cand_no", "c.score", "c.cui", "c.semtypes", F.explode("c.positions").alias("p"))
    return at.select(key, "phrase_no", "cand_no", F.col("p.start_pos").alias("begin"), F.col("p.length").alias("size"), "score", "cui", "semtypes")


def best_in_phrase(positions: DataFrame, key: str = "row_id") -> DataFrame:
    """Per phrase and position all candidates of the lowest score."""
    place = Window.partitionBy(key, "phrase_no", "begin", "size")
    return positions.withColumn("best", F.min("score").over(place)).where("score = best").drop("best")


def last_phrase(best: DataFrame, key: str = "row_id") -> DataFrame:
    """Of positions that several phrases give, those of the last phrase."""
    place = Window.partitionBy(key, "begin", "size")
    return best.withColumn("last", F.max("phrase_no").over(place)).where("phrase_no = last").drop("last")


def allowed(semtypes: Column, text: Column, selected: list[str] | None = None) -> Column:
    """Whether a candidate may become a mention: a selected semantic type and two characters at least; a gene is no
    plain word and no ``II``, anything else does not start with ``level``."""
    selected = SELECTED_SEMTYPES if selected is None else selected
    gene = ~text.rlike("^(?:[A-Z]?[a-z]+)$") & (F.lower(text) != "ii")
    form = F.when(F.array_contains(semtypes, "gngm"), gene).otherwise(~F.startswith(text, F.lit("level")))
    chosen = F.arrays_overlap(semtypes, F.array(*[F.lit(s) for s in selected]))
    return F.coalesce(chosen & (F.length(text) >= 2) & form, F.lit(False))


def mention_text(text: Column) -> Column:
    """An utterance's text as it is annotated: doubled double quotes made one, a full stop behind it."""
    return F.concat(F.replace(text, F.lit('""'), F.lit('"')), F.lit("."))


def chosen_spans(phrases: Column, start: Column, length: Column) -> Column:
    """``(begin, end, candidates)`` of the spans chosen in an utterance, relative to its start, in order.

    Within a phrase the lowest score wins a position (ties stay), over phrases the last one, overlapping or adjacent
    positions are resolved, and a position has to lie inside the utterance and to end before its end. Candidates without a
    score do not count. An expression over the utterance's own arrays. Null phrases give null.
    """
    def of_phrase(p: Column, phrase_no: Column) -> Column:
        each = F.transform(p["candidates"], lambda c, cand_no: F.transform(c["positions"], lambda q: F.struct(
            q["start_pos"].alias("begin"), q["length"].alias("size"), phrase_no.alias("phrase_no"),
            F.struct(cand_no.alias("cand_no"), c["score"].alias("score"), c["cui"].alias("cui"), c["semtypes"].alias("semtypes")).alias("c"),
        )))
        return F.flatten(F.filter(each, lambda x: x.isNotNull()))

    def best(spots: Column) -> Column:
        last = F.array_max(F.transform(spots, lambda x: x["phrase_no"]))
        own = let(last, lambda at: F.filter(spots, lambda x: x["phrase_no"] == at))
        return let(own, lambda of: let(F.array_min(F.transform(of, lambda x: x["c"]["score"])), lambda least: F.transform(F.filter(of, lambda x: x["c"]["score"] == least), lambda x: x["c"])))

    def span(key: Column, spots: Column) -> Column:
        own = F.filter(spots, lambda x: (x["begin"] == key["begin"]) & (x["size"] == key["size"]))
        begin = key["begin"] - start
        return F.struct(begin.alias("begin"), (begin + key["size"]).alias("end"), F.array_sort(let(own, best)).alias("candidates"))

    def chosen(spots: Column) -> Column:
        keys = F.array_distinct(F.transform(spots, lambda x: F.struct(x["begin"].alias("begin"), x["size"].alias("size"))))
        spans = F.transform(resolve_overlaps(keys), lambda key: span(key, spots))
        return F.filter(spans, lambda s: (s["begin"] >= 0) & (s["end"] > s["begin"]) & (s["end"] < length))

    spots = F.flatten(F.filter(F.transform(phrases, of_phrase), lambda x: x.isNotNull()))
    return let(F.filter(spots, lambda x: x["c"]["score"].isNotNull() & x["begin"].isNotNull() & x["size"].isNotNull()), chosen)


def once(df: DataFrame, value: Column, name: str, keep: list[Column | str]) -> DataFrame:
    """``keep`` and ``value`` as ``name``, worked out once for each row: unfolded from an array of one, as the planner would put a
    projection into every place that uses it."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def with_chosen_spans(utterances: DataFrame, keep: list[Column | str]) -> DataFrame:
    """``keep`` and ``spans``, the chosen ones of every utterance (an empty array if there are none)."""
    none = F.expr("cast(array() as array<struct<begin:int,end:int,candidates:array<struct<cand_no:int,score:int,cui:string,semtypes:array<string>>>>>)")
    return once(utterances, F.coalesce(chosen_spans(F.col("phrases"), F.col("start_pos"), F.col("length")), none), "spans", keep)


def select_spans(utterances: DataFrame, key: str = "row_id") -> DataFrame:
    """``(key, begin, end, candidates)`` of :func:`chosen_spans`, a row each. Narrow: nothing is shuffled."""
    return with_chosen_spans(utterances, [key]).select(key, F.explode("spans").alias("s")).select(key, "s.*")


def pairs_within(spans: Column) -> Column:
    """``(one, two)`` of every two spans of an array the first of which begins before the second."""
    behind = lambda x: F.filter(spans, lambda y: x["begin"] < y["begin"])
    return F.flatten(F.transform(spans, lambda x: F.transform(behind(x), lambda y: F.struct(x.alias("one"), y.alias("two")))))


def mentions(utterances: DataFrame, key: str = "row_id", strict: bool = False, on_miss: str = "drop_utterance") -> DataFrame:
    """``(key, text, m_no, begin, end, covered_text, concepts)``: selected spans placed in the cleaned text.

    Utterances with one span only are left out. Spans are looked up in the cleaned text in order, each behind the start of
    the one before. A span stays if one of its candidates is allowed, with all its candidates (``strict``: with the allowed ones).
    If one is not found, its utterance is left out (``on_miss="drop_utterance"``) or only the span (``"drop_mention"``). Narrow:
    an utterance is worked out within its row.
    """
    raw = mention_text(F.col("text"))
    rows = with_chosen_spans(utterances, [key, raw.alias("raw")]).where(F.size("spans") > 1)
    rows = once(rows, F.struct(F.col("raw"), clean_text(F.col("raw")).alias("text"), F.col("spans")), "u", [key])
    wanted = F.transform("u.spans", lambda s: clean_text(piece(F.col("u.raw"), s["begin"], s["end"])))

    def placed(words: Column, places: Column) -> Column:
        def mention(s: Column, i: Column) -> Column:
            admitted = F.filter(s["candidates"], lambda c: allowed(c["semtypes"], F.get(words, i)))
            return F.struct(i.alias("m_no"), F.get(words, i).alias("wanted"), F.get(places, i).alias("place"), s["candidates"].alias("candidates"), admitted.alias("admitted"))

        found = F.filter(F.transform("u.spans", mention), lambda m: F.size(m["admitted"]) > 0)
        if on_miss == "drop_utterance":
            return let(found, lambda known: F.when(~F.exists(known, lambda m: m["place"] < 0), known))
        return F.filter(found, lambda m: m["place"] >= 0)

    both = let(wanted, lambda words: let(relocate(F.col("u.text"), words), lambda places: placed(words, places)))
    rows = rows.select(key, F.col("u.text").alias("text"), F.explode(both).alias("m"))
    concepts = F.transform("m.admitted" if strict else "m.candidates", lambda c: F.struct(
        F.lit("UMLS").alias("source"), c["cui"].alias("concept_id"), F.col("m.wanted").alias("preferred_label"),
        F.array(F.col("m.wanted")).alias("synonyms"), c["semtypes"].alias("semtypes"), c["score"].cast("double").alias("score"),
    ))
    begin = F.col("m.place")
    return rows.select(
        key, "text", "m.m_no", begin.alias("begin"), (begin + F.length("m.wanted")).alias("end"), F.col("m.wanted").alias("covered_text"), concepts.alias("concepts")
    )


def mention_pairs(mentions: DataFrame, key: str, order: str = "begin", columns: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of one document's mentions of which the first begins before the second: columns suffixed ``_1`` and ``_2``.

    A join by document with the order as residual; documents are sentences, so the pairs stay few.
    """
    columns = (order, *columns)
    one = mentions.select(key, *[F.col(c).alias(f"{c}_1") for c in columns])
    two = mentions.select(F.col(key).alias("key_2"), *[F.col(c).alias(f"{c}_2") for c in columns])
    return one.join(two, (F.col(key) == F.col("key_2")) & (F.col(f"{order}_1") < F.col(f"{order}_2"))).drop("key_2")


def concept_pairs(pairs: DataFrame, first: str = "concepts_1", second: str = "concepts_2") -> DataFrame:
    """Every concept of the first mention with every one of the second."""
    return pairs.withColumn("concept_1", F.explode(first)).withColumn("concept_2", F.explode(second)).drop(first, second)
