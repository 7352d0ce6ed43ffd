import random
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm.heavy import CountSketch, Shape, frequent_items
from spanloom.llm import heavy, seen, together
from spanloom.llm.seen import KeyStore, MembershipFilter, filter_errors, first_occurrences, known_store, passed_keys, seen_before, trimmed
from spanloom.llm.together import pairs_together

VALUES = "field_name string, item string"


def test_sketch_finds_heavy_hashes():
    rng = np.random.default_rng(1)
    shape = Shape(width=1024)
    sketch = CountSketch(shape)
    heavy = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    sketch.add(np.concatenate([rng.integers(0, 1 << 63, 200_000, dtype=np.uint64), np.repeat(heavy, 4_000)]))
    found, estimates = sketch.heavy(0.5 * 4_000)
    assert set(map(int, heavy >> np.uint64(64 - shape.bits[-1]))) <= set(map(int, found))
    assert len(found) < 60 and abs(np.median(estimates) - 4_000) < 400


def test_frequent_items(spark):
    rng = random.Random(2)
    rows = [("a", "hot")] * 1_000 + [("a", f"x{i}") for i in range(1_990)] + [("a", "edge")] * 10 + [("b", "only"), ("a", None), (None, "y"), ("b", ""), ("c", "z" * 50_000)]
    rows += [("a", "nine")] * 9 if rng else []
    df = spark.createDataFrame(rows, VALUES).withColumn("n", F.lit(1)).repartition(7)
    n = sum(1 for f, i in rows if f == "a" and i is not None)
    got = {(r.field_name, r["item"]): (r.n, r.n_field) for r in frequent_items(df, Fraction(10, n)).collect()}
    assert got == {("a", "hot"): (1000, n), ("a", "edge"): (10, n), ("b", "only"): (1, 2), ("b", ""): (1, 2), ("c", "z" * 50_000): (1, 1)}
    assert frequent_items(df.limit(0)).count() == 0


KEYS = "kind string, key string, incoming_id long"


def test_seen_before(spark):
    known = spark.createDataFrame([("p", "k1"), ("p", "k1"), ("p", None), ("u", "k2")], "kind string, key string")
    rows = [("p", "k1", 1), ("p", "new", 2), ("p", "new", 3), ("u", "k1", 4), ("u", "k2", 5), ("p", None, 6), (None, "k1", 7), ("p", "x" * 20_000, 8), ("p", "k1", 9), ("p", "new", None)]
    df = spark.createDataFrame(rows, KEYS).withColumn("block", F.lit("clash"))
    store = known_store(known)
    assert sorted((r.kind, r.incoming_id) for r in seen_before(df, store).collect()) == [("p", 1), ("p", 3), ("p", 9), ("u", 5)]
    assert seen_before(df.limit(0), store).count() == 0
    assert sorted(r.incoming_id for r in seen_before(df.where("incoming_id > 1"), known_store(known.limit(0))).collect()) == [3]


@pytest.mark.parametrize("most", [seen.MOST_FILTER_BYTES, 0])
def test_filter_never_misses_and_errors_are_counted(spark, monkeypatch, most):
    monkeypatch.setattr(seen, "MOST_FILTER_BYTES", most)
    known = spark.range(5_000).select(F.lit("p").alias("kind"), F.col("id").cast("string").alias("key"))
    incoming = spark.range(2_500, 12_500).select(F.lit("p").alias("kind"), F.col("id").cast("string").alias("key"), F.col("id").alias("incoming_id"))
    store = known_store(known, bits_per_key=6)
    firsts = first_occurrences(incoming, store)
    assert firsts.where("known and not maybe").count() == 0 and firsts.where("known").count() == 2_500
    r = filter_errors(incoming, store).first()
    assert r.n_keys == 10_000 and r.turned_away + r.let_through == 10_000 and r.unknown == 7_500
    assert 0 < r.disproved < 1_500 and r.filter_error_rate == r.disproved / 7_500 and r.final_error_rate == 0
    assert sorted(x.incoming_id for x in seen_before(incoming, store).collect()) == list(range(2_500, 5_000))


def test_store_takes_batches(spark):
    store = KeyStore(spark, room=3.0)
    every = spark.range(0, 3_000).select(F.lit("p").alias("kind"), F.col("id").cast("string").alias("key"), F.col("id").alias("incoming_id"))
    for low in (0, 1_000, 2_000):
        store.append(every.where(F.col("incoming_id").between(low, low + 999)))
        assert seen_before(every, store).count() == low + 1_000
    assert store.keys.count() == 3_000
    asked = every.withColumn("kind", F.when(F.col("incoming_id") >= 0, "p"))
    plan = asked.join(store.keys.hint("merge"), ["kind", "key"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan  # keys on disk stay where they are


def test_trimmed(spark):
    rows = [(" a b\t", "a b"), (" x　", "x"), ("  ", None), ("", None), (None, None)]
    assert [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(trimmed(F.col("a"))).collect()] == [b for _, b in rows]


def brute_pairs(baskets):
    single, both = Counter(), Counter()
    for items in baskets.values():
        single.update(items)
        both.update(combinations(sorted(items), 2))
    return {(a, b, n, single[a], single[b], len(baskets)) for (a, b), n in both.items()}


@pytest.mark.parametrize("ratio", [None, 1, 3, 10])
def test_pairs_against_brute_force(spark, ratio):
    rng = random.Random(4)
    rows = [(f"b{rng.randrange(300)}", f"i{min(rng.randrange(40), rng.randrange(40))}") for _ in range(2_000)]
    rows += [("hub", f"i{i}") for i in range(60)] * 3 + [(None, "i1"), ("b1", None)]
    baskets = {}
    for basket, item in rows:
        if basket is not None and item is not None:
            baskets.setdefault(basket, set()).add(item)
    want = brute_pairs(baskets)
    least = 1 if ratio is None else 2
    want = {p for p in want if p[2] >= least and (ratio is None or p[2] * p[5] >= ratio * p[3] * p[4])}
    df = spark.createDataFrame(rows, "basket string, item string").withColumn("weight", F.lit("clash"))
    got = pairs_together(df, least_together=least, least_ratio=ratio).collect()
    assert {tuple(r)[:6] for r in got} == want and len(got) == len(want)
    parts = df.withColumn("part", F.rand(3) < 0.5).groupBy("basket", "part").agg(F.collect_list("item").alias("item"))
    parts = parts.unionByName(parts).unionByName(spark.createDataFrame([("b1", True, [None]), ("b2", True, []), ("b3", True, None)], "basket string, part boolean, item array<string>"))
    assert sorted(map(tuple, pairs_together(parts, least_together=least, least_ratio=ratio).collect())) == sorted(map(tuple, got))
    assert all(abs(r.lift - r.n_ab * r.n / (r.n_a * r.n_b)) < 1e-9 and (r.conviction is None) == (r.n_ab == r.n_a) for r in got)


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([("b", "i")], "basket string, item string")
    assert pairs_together(df).count() == 0 and pairs_together(df.limit(0)).count() == 0


def test_disproved_keys_are_rows_and_wrong_answers_are_counted(spark, monkeypatch):
    store = known_store(spark.createDataFrame([("a", f"k{i}") for i in range(8)], "kind string, key string"))
    incoming = spark.createDataFrame([("a", f"k{i}", i) for i in range(4, 16)], "kind string, key string, incoming_id long")
    monkeypatch.setattr(MembershipFilter, "ask", lambda self, keys: keys.withColumn("maybe", F.lit(True)))
    assert {(r.key, r.first_id, r.disproved) for r in passed_keys(incoming, store).collect()} == {(f"k{i}", i, i > 7) for i in range(4, 16)}
    r = filter_errors(incoming, store).first()
    assert (r.let_through, r.disproved, r.unknown, r.filter_error_rate, r.final_error_rate) == (12, 8, 8, 1.0, 0.0)
    monkeypatch.setattr(MembershipFilter, "ask", lambda self, keys: keys.withColumn("maybe", F.lit(False)))
    r = filter_errors(incoming, store).first()
    assert (r.turned_away, r.unknown, r.final_error_rate) == (12, 8, 4 / 12)


@pytest.mark.parametrize("most", [heavy.MOST_BROADCAST, 0])
def test_hot_items_are_no_rows_of_an_exchange(spark, monkeypatch, most):
    """A third of all rows is one item; with and without a broadcast the counts are right and values are combined first."""
    monkeypatch.setattr(heavy, "MOST_BROADCAST", most)
    df = spark.range(30_000).select(F.lit("f").alias("field_name"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("x"), "id")).alias("item"))
    found = frequent_items(df)
    assert [(r["item"], r.n, r.n_field) for r in found.collect()] == [("hot", 10_000, 30_000)] and 0 <= found.first().miss_bound < 1e-3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join") if most else plan.index("Join") < plan.rindex("Aggregate")


def test_sketch_follows_the_support():
    assert Shape.of(Fraction(1, 100)).width == 4096 and Shape.of(Fraction(1, 5_000)).width == 1 << 18 and Shape.of(Fraction(1, 2)).width == 1024
    with pytest.raises(ValueError):
        Shape.of(Fraction(1, 10_000_000))


def test_pairs_when_hot_items_are_too_many_to_list(spark, monkeypatch):
    rows = [(f"b{i}", f"i{j}") for i in range(40) for j in range(12) if j < 6 or i % 12 == j]
    df = spark.createDataFrame(rows, "basket string, item string")
    want = sorted(map(tuple, pairs_together(df, least_together=2, least_ratio=3).collect()))
    monkeypatch.setattr(together, "MOST_HOT", 2)
    assert sorted(map(tuple, pairs_together(df, least_together=2, least_ratio=3).collect())) == want
