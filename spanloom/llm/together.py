"""Items that appear together: pair counts and their ratio to chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from spanloom.session import stored

#: Items too frequent for any pair that are taken out of the arrays as one list.
MOST_HOT = 2_000


def collapse_baskets(items: DataFrame, basket: str = "basket", item: str = "item") -> DataFrame:
    """``(items, weight)``: the different item sets, sorted, and how many baskets have each.

    ``item`` is an item, or an array of a basket's items or of a part of them. Repeats are combined before the first
    shuffle: items within an array where it lies, equal arrays of a basket, or equal rows of one. So a basket delivered
    any number of times costs its different parts only. Rows with a null basket and null items do not count.
    """
    rows = items.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna()
    if not isinstance(rows.schema["item"].dataType, ArrayType):
        sets = rows.distinct().groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    else:
        own = F.array_sort(F.array_distinct(F.filter("item", lambda x: x.isNotNull())))
        parts = rows.select("basket", own.alias("part")).where(F.size("part") > 0)
        parts = parts.groupBy("basket").agg(F.collect_set("part").alias("parts"))
        both = F.array_sort(F.array_distinct(F.flatten("parts")))
        sets = parts.select("basket", F.when(F.size("parts") == 1, F.get("parts", F.lit(0))).otherwise(both).alias("items"))
    return sets.groupBy("items").agg(F.count("*").alias("weight"))


def pairs_together(
    items: DataFrame, basket: str = "basket", item: str = "item", least_together: int = 1, least_ratio: int | None = None
) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n, lift, conviction)`` with ``item_a < item_b``.

    ``n`` counts baskets with an item, ``lift`` is ``n_ab * n / (n_a * n_b)``, ``conviction`` that of a -> b (null
    where b follows always). Equal item sets are collapsed into one with a weight; pairs are made once from each, the
    rest of the set being unfolded behind each item, and only their weights are added up. Only pairs together in
    ``least_together`` baskets meet the item counts. With ``least_ratio`` a pair stays if
    ``n_ab * n >= least_ratio * n_a * n_b``, compared exactly; as ``n_ab`` is at most either count, an item in more
    than ``n / least_ratio`` baskets is in no such pair, so these items leave the sets before pairs are made. There are
    fewer of them than ``least_ratio`` times the mean number of items in a basket; up to ``MOST_HOT`` are taken out of
    the arrays where they lie, and were there more, only the pairs' own counts would decide. Making pairs is one narrow
    step behind the sets. A single item, an empty table: no pairs. Other columns do not take part.
    """
    baskets = stored(collapse_baskets(items, basket, item), "baskets")
    n = baskets.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    single = baskets.select(F.explode("items").alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("n_item"))
    single = stored(single.where(F.col("n_item") >= least_together), "item-counts")
    if least_ratio:
        hot = single.where(F.col("n_item") * least_ratio > n).select("item").limit(MOST_HOT + 1).collect()
        if 0 < len(hot) <= MOST_HOT:
            left = F.array_except("items", F.array(*[F.lit(row["item"]) for row in hot]))
            baskets = baskets.withColumn("items", left)
    placed = baskets.where(F.size("items") > 1).select("items", "weight", F.posexplode("items").alias("place", "item_a"))
    rest = F.slice("items", F.col("place") + 2, F.size("items"))
    both = placed.select("item_a", F.explode(rest).alias("item_b"), "weight")
    counted = both.groupBy("item_a", "item_b").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= least_together)
    counted = counted.join(single.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a")), "item_a")
    counted = counted.join(single.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b")), "item_b")
    whole = lambda name: F.col(name).cast("decimal(19,0)")
    if least_ratio:
        chance = (whole("n_a") * whole("n_b")) * F.lit(least_ratio).cast("decimal(10,0)")
        counted = counted.where(whole("n_ab") * F.lit(n).cast("decimal(19,0)") >= chance)
    lift = F.col("n_ab") / F.col("n_a") * (F.lit(n) / F.col("n_b"))
    misses = 1 - F.col("n_ab") / F.col("n_a")
    conviction = F.when(misses > 0, (1 - F.col("n_b") / F.lit(n)) / misses)
    return counted.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n).cast("bigint").alias("n"), lift.alias("lift"), conviction.alias("conviction")
    )
