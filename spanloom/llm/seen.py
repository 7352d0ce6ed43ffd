"""Has this key been seen before? A membership filter, and exact lookup of what passes it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import shared_path, stored

#: Words of a filter block, one bit set in each for a key.
WORDS = 8
#: A filter of up to so many bytes (some 7 million keys) is broadcast.
MOST_FILTER_BYTES = 16 << 20


def trimmed(key: Column) -> Column:
    """A key without white space around it; null if nothing is left."""
    bare = F.regexp_replace(key, r"(?U)^\s+|\s+$", "")
    return F.when(bare != "", bare)


class MembershipFilter:
    """A blocked Bloom filter kept as a table: one row of eight 64-bit words per block of 512 bits.

    It grows with the keys (``bits_per_key`` bits each) and is therefore never collected. A key's block lies among those of
    the key's bucket in the store, so a task that builds it from a bucket combines all keys of a block before anything is
    shuffled. Up to ``MOST_FILTER_BYTES`` it is broadcast, so that keys are answered where they lie; a larger one is asked
    by a join on the block's number.
    """

    def __init__(self, table: DataFrame, buckets: int, per_bucket: int) -> None:
        self.table, self.buckets, self.per_bucket = table, buckets, per_bucket

    @staticmethod
    def blocks_for(n_keys: int, bits_per_key: int, buckets: int) -> int:
        """Blocks of a bucket."""
        return max(1, n_keys * bits_per_key // (64 * WORDS * buckets) + 1)

    @classmethod
    def of(cls, keys: DataFrame, buckets: int, per_bucket: int) -> MembershipFilter:
        words = [F.bit_or(bit).alias(f"word_{i}") for i, bit in enumerate(cls._bits())]
        return cls(keys.select("kind", "key").groupBy(cls._block(buckets, per_bucket).alias("block")).agg(*words), buckets, per_bucket)

    @staticmethod
    def _block(buckets: int, per_bucket: int) -> Column:
        bucket = F.pmod(F.hash("kind", "key"), F.lit(buckets)).cast("bigint")
        return bucket * per_bucket + F.pmod(F.xxhash64("kind", "key"), F.lit(per_bucket))

    @staticmethod
    def _bits() -> list[Column]:
        mixed = F.xxhash64(F.lit("bits"), "key", "kind")
        places = [F.shiftright(mixed, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
        return [F.call_function("shiftleft", F.lit(1).cast("bigint"), place) for place in places]

    def ask(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``maybe``: false if a key certainly is not in the filter."""
        asked = keys.withColumn("block", self._block(self.buckets, self.per_bucket))
        hits = [F.col(f"word_{i}").bitwiseAND(bit) != 0 for i, bit in enumerate(self._bits())]
        all_set = hits[0]
        for hit in hits[1:]:
            all_set = all_set & hit
        table = F.broadcast(self.table) if self.buckets * self.per_bucket * 8 * (WORDS + 1) <= MOST_FILTER_BYTES else self.table
        joined = asked.join(table, "block", "left").withColumn("maybe", F.coalesce(all_set, F.lit(False)))
        return joined.drop("block", *[f"word_{i}" for i in range(WORDS)])


class KeyStore:
    """Earlier keys on disk and the filter in front of them, to which batches of keys are appended.

    ``keys`` is a table bucketed by key, so that a lookup shuffles what is looked up and never the keys that lie there;
    ``filter`` holds one filter a batch, all of the same number of blocks, which asking puts together. The number is
    fixed by the first batch and ``room``, how many times as many keys are to come in all: with more keys than that the
    filter lets more through, which :func:`filter_errors` tells, and answers stay right. A batch is in the store once
    its filter is: one whose writing broke off is written anew under the next number, and keys there twice do not matter.
    """

    def __init__(self, spark: SparkSession, bits_per_key: int = 16, room: float = 1.0, path: str | None = None) -> None:
        self.spark, self.path = spark, path or shared_path(spark, "key-store")
        self.bits_per_key, self.room = bits_per_key, room
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"key_store_{uuid.uuid4().hex}"
        self.per_bucket = self.batches = 0

    def append(self, keys: DataFrame) -> KeyStore:
        """Add ``(kind, key)``; nulls are no keys, repeats are combined before they are shuffled. Making keys distinct parts them
        by the hash that buckets go by, so that is the only shuffle they see."""
        fresh = keys.where("kind is not null and key is not null").select("kind", "key").distinct()
        writer = fresh.withColumn("batch", F.lit(self.batches)).write.mode("append").option("path", f"{self.path}/keys")
        writer.bucketBy(self.buckets, "kind", "key").saveAsTable(self.name)
        batch = self.spark.table(self.name).where(F.col("batch") == self.batches)
        if not self.per_bucket:
            self.per_bucket = MembershipFilter.blocks_for(int(batch.count() * self.room), self.bits_per_key, self.buckets)
        MembershipFilter.of(batch, self.buckets, self.per_bucket).table.write.parquet(f"{self.path}/filter/batch={self.batches}")
        self.batches += 1
        return self

    @property
    def keys(self) -> DataFrame:
        return self.spark.table(self.name).select("kind", "key")

    @property
    def filter(self) -> MembershipFilter:
        table = self.spark.read.parquet(f"{self.path}/filter").drop("batch")
        if self.batches > 1:
            table = table.groupBy("block").agg(*[F.bit_or(f"word_{i}").alias(f"word_{i}") for i in range(WORDS)])
        return MembershipFilter(table, self.buckets, self.per_bucket)

    def drop(self) -> None:
        """Forget the store; its files go with the application's folder, or with a path of its own when that is deleted."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def known_store(known: DataFrame, bits_per_key: int = 16) -> KeyStore:
    """A store of the keys ``known``."""
    return KeyStore(known.sparkSession, bits_per_key).append(known)


def first_occurrences(incoming: DataFrame, store: KeyStore) -> DataFrame:
    """``(kind, key, first_id, n_rows, maybe, known)`` of every different incoming key.

    ``maybe`` is the filter's answer and ``known`` the exact one: keys the filter turns away are done, and only those it
    lets through are shuffled to the full keys on disk. Incoming rows are reduced to different keys before anything is
    joined, so a hot key is one row.
    """
    firsts = (
        incoming.where("kind is not null and key is not null")
        .groupBy("kind", "key")
        .agg(F.min("incoming_id").alias("first_id"), F.count("*").alias("n_rows"))
    )
    asked = stored(store.filter.ask(firsts), "asked-keys")
    passed, turned_away = asked.where("maybe"), asked.where("not maybe").withColumn("known", F.lit(False))
    confirmed = stored(passed.join(store.keys, ["kind", "key"], "left_semi"), "confirmed-keys")  # the full keys are read once
    disproved = passed.join(confirmed.select("kind", "key"), ["kind", "key"], "left_anti").withColumn("known", F.lit(False))
    return turned_away.unionByName(confirmed.withColumn("known", F.lit(True))).unionByName(disproved)


def seen_before(incoming: DataFrame, store: KeyStore) -> DataFrame:
    """``(kind, incoming_id)`` of the incoming rows whose key is in the store or came in a row with a smaller id.

    ``incoming`` has ``kind``, ``key`` and ``incoming_id`` (unique for a kind). All rows but the first of each key are
    seen, and the first one is if the key is known; so the first rows of unknown keys are subtracted by id, and no row is
    ever joined by a key that many rows share. Null keys and ids are no cases; repeated keys and empty tables are fine;
    other columns do not take part.
    """
    firsts = stored(first_occurrences(incoming, store), "first-keys")
    new = firsts.where("not known").select("kind", F.col("first_id").alias("incoming_id"))
    rows = incoming.where("kind is not null and key is not null and incoming_id is not null").select("kind", "incoming_id")
    return rows.join(new, ["kind", "incoming_id"], "left_anti")


def passed_keys(incoming: DataFrame, store: KeyStore) -> DataFrame:
    """``(kind, key, first_id, n_rows, disproved)`` of every key the filter let through: the log of its positives, with those
    that the exact lookup disproved."""
    firsts = first_occurrences(incoming, store)
    return firsts.where("maybe").select("kind", "key", "first_id", "n_rows", (~F.col("known")).alias("disproved"))


def filter_errors(incoming: DataFrame, store: KeyStore) -> DataFrame:
    """Per kind: different keys and rows, keys the filter turned away, let through and let through wrongly, the rate of
    wrong answers among keys that are not known, and the rate of wrong final answers among all keys, found by joining
    every key, turned away or not, with the full keys."""
    full = store.keys.distinct().withColumn("is_known", F.lit(True))
    firsts = first_occurrences(incoming, store).join(full, ["kind", "key"], "left")
    count = lambda condition, name: F.sum(F.expr(condition).cast("bigint")).alias(name)
    groups = firsts.groupBy("kind").agg(
        F.count("*").alias("n_keys"), F.sum("n_rows").alias("n_rows"), count("not maybe", "turned_away"),
        count("maybe", "let_through"), count("maybe and is_known is null", "disproved"), count("is_known is null", "unknown"),
        count("known <> (is_known is not null)", "wrong"),
    )
    rate = F.when(F.col("unknown") > 0, F.col("disproved") / F.col("unknown")).otherwise(0.0)
    return groups.withColumn("filter_error_rate", rate).withColumn("final_error_rate", F.col("wrong") / F.col("n_keys")).drop("wrong")
