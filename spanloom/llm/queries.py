"""Queries over the operators for training data, and their SQL."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.heavy import frequent_items
from spanloom.llm.mixing import listed_sources, mixture, plan_mixture, plan_temperature, planned_shares, reached_shares, realised, stored_sizes, token_sizes
from spanloom.llm.seen import KeyStore, filter_errors, known_store, passed_keys, seen_before, trimmed
from spanloom.llm.sentences import sentences
from spanloom.llm.together import pairs_together
from spanloom.llm.toxicity import THRESHOLD, rates_by_source, score_documents
from spanloom.llm.tokenizer import encode_documents
from spanloom.operators.packed import explode_packed
from spanloom.session import stored, table


#: Of the nested phrases only the CUIs; the planner does not prune below two levels of arrays by itself.
CUIS_ONLY = "row_id bigint, utt_id string, phrases array<struct<candidates: array<struct<cui: string>>>>"


def utterances_with_cuis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(CUIS_ONLY).parquet(f"{sf_dir}/utterances.parquet")


def candidate_cuis(utterances: DataFrame, *keys) -> DataFrame:
    """``keys`` and ``cui`` of every candidate."""
    each = utterances.select(*keys, F.explode("phrases.candidates").alias("candidates"))
    names = each.columns[:-1]
    return each.select(*names, F.explode("candidates.cui").alias("cui"))


def edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_packed(table(spark, sf_dir, "edges"), "edge_id", "utt_ids")


def packed_and_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuis = candidate_cuis(utterances_with_cuis(spark, sf_dir)).select(F.lit("MMCandidate.cui").alias("field_name"), F.col("cui").alias("item"))
    utts = edge_ids(spark, sf_dir).select(F.lit("edge.uttIds").alias("field_name"), "item")
    return cuis.unionByName(utts)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_frequent(spark, sf_dir).select("field_name", "item")


def p1_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent values with their counts."""
    return frequent_items(packed_and_nested(spark, sf_dir)).select("field_name", "item", "n", "n_field")


def p1_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent values with exact and estimated counts, and how likely one was missed at most."""
    return frequent_items(packed_and_nested(spark, sf_dir))


def incoming_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "incoming_utterances")
    kinds = F.array(F.struct(F.lit("pmid").alias("kind"), trimmed(F.col("pmid")).alias("key")), F.struct(F.lit("utt").alias("kind"), trimmed(F.col("utt_id")).alias("key")))
    return rows.select("incoming_id", F.explode(kinds).alias("k")).select("incoming_id", "k.kind", "k.key")


def known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pmids = table(spark, sf_dir, "utterances").select(F.lit("pmid").alias("kind"), F.col("pmid").alias("key"))
    return pmids.unionByName(edge_ids(spark, sf_dir).select(F.lit("utt").alias("kind"), F.col("item").alias("key")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = seen_before(incoming_keys(spark, sf_dir), known_store(known_keys(spark, sf_dir)))
    return seen.select(F.col("kind").alias("key_kind"), "incoming_id")


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found with the incoming rows in three batches, each asked and then added to the store."""
    incoming = stored(incoming_keys(spark, sf_dir), "incoming")
    store = KeyStore(spark, room=2.0).append(known_keys(spark, sf_dir))
    lowest, highest = incoming.agg(F.min("incoming_id"), F.max("incoming_id")).first()
    bounds = [None, *((lowest or 0) + ((highest or 0) - (lowest or 0)) * i // 3 for i in (1, 2)), None]
    found = []
    for low, high in zip(bounds, bounds[1:]):
        batch = incoming if low is None else incoming.where(F.col("incoming_id") > low)
        batch = batch if high is None else batch.where(F.col("incoming_id") <= high)
        found.append(stored(seen_before(batch, store), "seen"))
        store.append(batch)
    seen = found[0].unionByName(found[1]).unionByName(found[2])
    return seen.select(F.col("kind").alias("key_kind"), "incoming_id")


def p3_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_errors(incoming_keys(spark, sf_dir), known_store(known_keys(spark, sf_dir)))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What p3_errors counts without regard to the filter."""
    return p3_errors(spark, sf_dir).select("kind", "n_keys", "n_rows", "unknown", "final_error_rate")


def p3_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key the filter let through, and whether it was disproved."""
    return passed_keys(incoming_keys(spark, sf_dir), known_store(known_keys(spark, sf_dir)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = sentences(table(spark, sf_dir, "documents"), "doc_id").select(F.lit("documents").alias("tbl"), "*")
    utterances = sentences(table(spark, sf_dir, "utterances"), "row_id").select(F.lit("utterances").alias("tbl"), "*")
    return documents.unionByName(utterances)


def utterance_cuis(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.coalesce(F.concat(F.lit("utt:"), "utt_id"), F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    cuis = F.flatten(F.transform("phrases.candidates", lambda candidates: F.coalesce(candidates["cui"], F.array().cast("array<string>"))))
    return utterances_with_cuis(spark, sf_dir).select(own.alias("utt"), cuis.alias("cui"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairs_together(utterance_cuis(spark, sf_dir), "utt", "cui", least_together=5, least_ratio=10)
    return pairs.select(F.col("item_a").alias("cui_a"), F.col("item_b").alias("cui_b"))


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with their counts and ratios."""
    pairs = pairs_together(utterance_cuis(spark, sf_dir), "utt", "cui")
    return pairs.select(F.col("item_a").alias("cui_a"), F.col("item_b").alias("cui_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixture(token_sizes(table(spark, sf_dir, "documents"), targets), targets)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached_shares(stored(p9_mixture(spark, sf_dir), "mixture"), table(spark, sf_dir, "mix_targets"))


def p9_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares for a tenth more tokens than the targets allow: the exponent is bisected to what the repetition limits allow."""
    targets = table(spark, sf_dir, "mix_targets")
    sizes = stored_sizes(token_sizes(table(spark, sf_dir, "documents"), targets))
    sources = listed_sources(sizes, targets)
    plan = plan_mixture(sources, int(1.1 * plan_mixture(sources).size))
    return planned_shares(stored(realised(sizes, sources, plan), "mixture"), targets, sources, plan)


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of natural ones made more equal: half as many tokens as there are, at 95 % of the entropy of equal shares at least."""
    targets = table(spark, sf_dir, "mix_targets")
    sizes = stored_sizes(token_sizes(table(spark, sf_dir, "documents"), targets))
    sources = listed_sources(sizes, targets)
    there = [s for s in sources if s.tokens]
    plan = plan_temperature(sources, sum(s.tokens for s in there) // 2, 0.95 * log(max(1, len(there))))
    return planned_shares(stored(realised(sizes, sources, plan), "mixture"), targets, sources, plan)


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and passages."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates_by_source(p10_scores(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_frequent": p1_frequent,
    "p1_estimates": p1_estimates,
    "p3_found": p3_found,
    "p3_batches": p3_batches,
    "p3_errors": p3_errors,
    "p3_counts": p3_counts,
    "p3_passed": p3_passed,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_pairs": p7_pairs,
    "p8_ids": p8_ids,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_budgeted": p9_budgeted,
    "p9_tempered": p9_tempered,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

EDGE_IDS = r"""(select unnest(list_filter(list_transform(regexp_extract_all(utt_ids,
    '"(?:[^"\\]|\\"|""|\\)*"|''[^'']*''|[\p{L}\p{N}._-]+'), lambda x: case when x[1] = '"' then
    regexp_replace(x[2:-2], '""|\\"', '"', 'g') when x[1] = '''' then x[2:-2] else x end), lambda x: x <> '')) as item from edges)"""
CUIS = "(select row_id, utt_id, unnest(c.candidates).cui as cui from (select row_id, utt_id, unnest(phrases) as c from utterances))"
BASKETS = f"b as (select distinct coalesce('utt:' || utt_id, 'row:' || row_id) as utt, cui from {CUIS} where cui is not null)"
PAIRS = f"""with {BASKETS}, n as (select count(distinct utt) as n from b), k as (select cui, count(*) as c from b group by cui),
    p as (select x.cui as cui_a, y.cui as cui_b, count(*) as n_ab from b x join b y on x.utt = y.utt and x.cui < y.cui group by all)
    select cui_a, cui_b, n_ab, ka.c as n_a, kb.c as n_b, n.n, round(n_ab / ka.c * (n.n / kb.c), 6) as lift
    from p join k ka on ka.cui = cui_a join k kb on kb.cui = cui_b, n"""

KEYS = rf"""i as (select incoming_id, k.kind, k.key from (select incoming_id, unnest([
        {{'kind': 'pmid', 'key': nullif(regexp_replace(pmid, '^\s+|\s+$', '', 'g'), '')}},
        {{'kind': 'utt', 'key': nullif(regexp_replace(utt_id, '^\s+|\s+$', '', 'g'), '')}}]) as k from incoming_utterances) where k.key is not null),
        h as (select distinct 'pmid' as kind, pmid as key from utterances union select 'utt', item from {EDGE_IDS}),
        f as (select kind, key, min(incoming_id) as first_id, count(*) as n from i group by all)"""
SEEN = f"""with {KEYS} select i.kind as key_kind, incoming_id from i join f using (kind, key) left join h using (kind, key)
        where incoming_id > first_id or h.key is not null"""
VALUES = f"""v as (select 'MMCandidate.cui' as field_name, cui as item from {CUIS} where cui is not null union all
        select 'edge.uttIds', item from {EDGE_IDS}), n as (select field_name, count(*) as n_field from v group by 1),
        w as (select field_name, item, count(*) as n, n_field from v join n using (field_name) group by field_name, item, n_field having count(*) * 100 >= n_field)"""

SQL = {
    "p1_found": f"with {VALUES} select field_name, item from w",
    "p1_frequent": f"with {VALUES} select field_name, item, n, n_field from w",
    "p3_found": SEEN,
    "p3_batches": SEEN,
    "p3_counts": f"""with {KEYS} select f.kind, count(*) as n_keys, sum(n)::bigint as n_rows, sum((h.key is null)::int)::bigint as unknown, 0.0::double as final_error_rate
        from f left join h using (kind, key) group by f.kind""",
    "p7_found": f"select cui_a, cui_b from ({PAIRS}) where n_ab >= 5 and n_ab * n >= 10 * n_a * n_b",
    "p7_pairs": PAIRS,
}
