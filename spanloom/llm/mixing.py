"""Mixing sources to target weights: temperature shares under repetition limits, realised by block permutations."""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, isqrt, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.tokenizer import VOCABULARY, encode_documents
from spanloom.session import stored

#: Sources one mixture may have; their totals are handled by the driver.
MOST_SOURCES = 10_000


@dataclass(frozen=True)
class Source:
    """What there is of a source and what is wanted: tokens, documents, target share, uses of a document at most."""

    name: str
    tokens: int
    documents: int
    target: float
    repeats: int


def entropy(shares: list[float]) -> float:
    return -sum(p * log(p) for p in shares if p > 0)


def bisect(holds, low: float, high: float) -> float:
    """The largest number in ``[low, high]`` for which ``holds`` (true up to some point, at ``low`` at least)."""
    if holds(high):
        return high
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def powered(bases: list[float], exponents: list[float], tilt: float) -> list[float]:
    weights = [exp(log(b) + tilt * e) if b > 0 else 0.0 for b, e in zip(bases, exponents)]
    total = sum(weights)
    return [w / total for w in weights] if total else weights


@dataclass(frozen=True)
class Plan:
    """What a mixture is to be: its exponent, its size, and tokens wanted of each source."""

    exponent: float
    size: float
    wanted: dict[str, float]


def plan_temperature(sources: list[Source], budget: int, least_entropy: float) -> Plan:
    """Shares ``p ** a``, normalised, of the natural token shares ``p``: natural at ``a = 1``, equal at ``a = 0``.

    The exponent is the largest in [0, 1] whose entropy is ``least_entropy`` or more, found by bisection. If a source
    would be used beyond its repetition limit for the ``budget``, it is the smallest above that at which none is, found by
    bisection too; and if none is small enough, natural shares are used as far as the limits allow. Targets are not looked at.
    """
    usable = [s for s in sources if s.tokens > 0 and s.repeats > 0]
    if not usable:
        return Plan(1.0, 0.0, {s.name: 0.0 for s in sources})
    total = sum(s.tokens for s in usable)
    logs = [log(s.tokens / total) for s in usable]
    most = [s.tokens * s.repeats for s in usable]
    size = min(budget, sum(most))
    at = lambda a: powered([1.0] * len(usable), logs, a)
    within = lambda a: all(w * size <= m * (1 + 1e-9) for w, m in zip(at(a), most))
    exponent = bisect(lambda a: entropy(at(a)) >= least_entropy - 1e-12, 0.0, 1.0)
    if not within(exponent):
        least = exponent
        exponent = 1.0 - bisect(lambda down: within(1.0 - down), 0.0, 1.0 - least) if within(1.0) else 1.0
    given = {s.name: min(w * size, m) for s, w, m in zip(usable, at(exponent), most)}
    return Plan(exponent, size, {s.name: given.get(s.name, 0.0) for s in sources})


def plan_mixture(sources: list[Source], budget: int | None = None) -> Plan:
    """Shares between the natural and the target ones, as near to the targets as the repetition limits allow.

    Shares are ``p * (target / p) ** a`` of the natural token shares ``p``: natural at ``a = 0``, the targets at
    ``a = 1``. The largest ``a`` is taken at which no source is used beyond its repetition limit for the ``budget``.
    Without a budget the mixture is as large as the limits allow at the targets themselves. Sources without tokens or
    without a target have nothing to give; their share goes to the others in proportion.
    """
    usable = [s for s in sources if s.tokens > 0 and s.target > 0 and s.repeats > 0]
    if not usable:
        return Plan(1.0, 0.0, {s.name: 0.0 for s in sources})
    total, wanted = sum(s.tokens for s in usable), sum(s.target for s in usable)
    natural = [s.tokens / total for s in usable]
    tilts = [log(s.target / wanted / p) for s, p in zip(usable, natural)]
    most = [s.tokens * s.repeats for s in usable]
    size = budget if budget is not None else min(m * wanted / s.target for m, s in zip(most, usable))
    size = min(size, sum(most))
    within = lambda a: all(w * size <= m * (1 + 1e-9) for w, m in zip(powered(natural, tilts, a), most))
    tilt = bisect(within, 0.0, 1.0)
    shares = powered(natural, tilts, tilt)
    given = {s.name: min(w * size, m) for s, w, m in zip(usable, shares, most)}
    return Plan(tilt, size, {s.name: given.get(s.name, 0.0) for s in sources})


def token_sizes(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of the documents of listed sources that have tokens."""
    listed = documents.join(targets.select("source").distinct(), "source", "left_semi")
    rows = listed.select(F.struct("doc_id", "source").alias("row"), "text")
    return encode_documents(rows, "row", "text", vocabulary, counts_only=True).where("n_tokens > 0").select("row.*", "n_tokens")


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id")


def stored_sizes(sizes: DataFrame) -> DataFrame:
    """Documents that can be used, in a table of their own, as planning and mixing read them several times."""
    return stored(sizes.select("doc_id", "source", "n_tokens").where("doc_id is not null and source is not null and n_tokens > 0"), "sizes")


def mixture(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17) -> DataFrame:
    """``(doc_id, source, use_no, n_tokens, place)``: each use of a document in the mixture; sort by ``place`` to shuffle.

    ``sizes`` as :func:`token_sizes` gives it, ``targets`` with ``source``, ``target_share`` and ``max_repeats`` (at most
    ``MOST_SOURCES`` rows; null or negative counts as none, a null ``max_repeats`` as 1, of a source listed more than
    once the row with the largest share). Planned by :func:`plan_mixture` and realised by :func:`realised`. Null sources
    and keys, and documents without tokens, are not used; an empty table gives no rows; other columns do not take part.
    """
    sizes = stored_sizes(sizes)
    sources = listed_sources(sizes, targets)
    return realised(sizes, sources, plan_mixture(sources, budget), seed)


def realised(sizes: DataFrame, sources: list[Source], plan: Plan, seed: int = 17) -> DataFrame:
    """The uses of documents that a plan asks for, by budgeted block permutations.

    A source is used whole as often as its budget allows. For the last, partial pass its documents are parted by a hash
    into as many blocks as a block has documents, the root of their number, and the blocks are permuted: whole blocks
    are taken until the budget falls inside one, and from that documents in hash order up to half a document of the
    budget. So every source meets its share to within one document, no more than the root of a source's documents is
    ever put in order in one task, and a source with a third of all rows is many tasks' work.
    """
    spark = sizes.sparkSession
    rows = []
    for s in sources:
        wanted = plan.wanted[s.name]
        full = min(int(wanted / s.tokens + 1e-9), s.repeats) if s.tokens else 0
        rest = max(0.0, wanted - full * s.tokens) if full < s.repeats else 0.0
        rows.append((s.name, full, rest, max(1, isqrt(s.documents))))
    planned = F.broadcast(spark.createDataFrame(rows, "source string, passes int, rest double, n_blocks int"))  # MOST_SOURCES rows at most
    docs = sizes.join(planned, "source").withColumn("hash", _order(seed)).withColumn("block", F.pmod("hash", "n_blocks"))
    sums = docs.where("rest > 0").groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    permuted = F.xxhash64(F.lit(seed + 2), "source", "block")
    until = F.sum("block_tokens").over(Window.partitionBy("source").orderBy(permuted, "block"))
    blocks = sums.withColumn("block_end", until).withColumn("block_start", F.col("block_end") - F.col("block_tokens"))
    partial = docs.where("rest > 0").join(blocks, ["source", "block"]).where("block_start < rest")
    whole = partial.where("block_end <= rest")
    inside = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    cut = partial.where("block_end > rest").withColumn("until", F.col("block_start") + inside - F.col("n_tokens") / 2).where("until <= rest")
    last = whole.select("doc_id", "source", "n_tokens", "passes").unionByName(cut.select("doc_id", "source", "n_tokens", "passes"))
    last = last.select("doc_id", "source", (F.col("passes") + 1).alias("use_no"), "n_tokens")
    often = docs.where("passes > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), "passes")).alias("use_no"), "n_tokens")
    return often.unionByName(last).withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id", "use_no"))


def planned_shares(mixed: DataFrame, targets: DataFrame, sources: list[Source], plan: Plan) -> DataFrame:
    """:func:`reached_shares` with the exponent, the natural shares and those that were planned."""
    total, size = sum(s.tokens for s in sources) or 1, sum(plan.wanted.values()) or 1.0
    rows = [(s.name, s.tokens / total, plan.wanted[s.name] / size, plan.exponent) for s in sources]
    planned = mixed.sparkSession.createDataFrame(rows, "source string, natural_share double, planned_share double, exponent double")
    return reached_shares(mixed, targets).join(F.broadcast(planned), "source", "left")  # MOST_SOURCES rows at most


def listed_sources(sizes: DataFrame, targets: DataFrame) -> list[Source]:
    rows = targets.where("source is not null").select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals = sizes.join(targets.select("source").distinct(), "source", "left_semi").groupBy("source")
    there = {r["source"]: r for r in totals.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    found: dict[str, Source] = {}
    for row in sorted(rows, key=lambda r: (r["source"], r["target_share"] or 0.0)):
        own = there.get(row["source"])
        repeats = 1 if row["max_repeats"] is None else max(0, row["max_repeats"])
        share = max(0.0, row["target_share"] or 0.0)
        found[row["source"]] = Source(row["source"], own["t"] if own else 0, own["n"] if own else 0, share, repeats)
    return list(found.values())


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target share, share really reached, tokens, different documents, most uses of one."""
    uses = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_uses"),
        F.sum((F.col("use_no") == 1).cast("bigint")).alias("n_documents"), F.max("use_no").alias("most_uses"),
    )
    joined = targets.join(uses, "source", "left")
    total = F.sum("n_tokens").over(Window.partitionBy())  # one row per source
    return joined.select(
        "source", "target_share", "max_repeats", F.coalesce(F.col("n_tokens") / total, F.lit(0.0)).alias("reached_share"),
        *[F.coalesce(name, F.lit(0)).alias(name) for name in ("n_tokens", "n_uses", "n_documents", "most_uses")],
    )
