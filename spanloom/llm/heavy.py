"""Most frequent values among billions, in bounded memory: hierarchical count-sketch and a second scan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes one field's sketch may take: what a task and the driver hold at once.
MOST_SKETCH_BYTES = 64 << 20
#: Candidates whose table is broadcast for the second scan, some 100 bytes each. Beyond it items are added up before they
#: meet the candidates.
MOST_BROADCAST = 100_000


@dataclass(frozen=True)
class Shape:
    """``depth`` rows of ``width`` (a power of two) signed counters for prefixes of each length in ``bits``."""

    depth: int = 5
    width: int = 4096
    bits: tuple[int, ...] = (8, 16, 24, 32, 40)

    @classmethod
    def of(cls, support: Fraction) -> Shape:
        """A shape whose counters are 40 times as many as items can reach ``support``; :class:`ValueError` if that is too much."""
        shape = cls(width=max(1024, 1 << (ceil(40 / support) - 1).bit_length()))
        if shape.bytes > MOST_SKETCH_BYTES:
            raise ValueError(f"a support of {support} needs a sketch of {shape.bytes} bytes")
        return shape

    @property
    def bytes(self) -> int:
        return len(self.bits) * self.depth * self.width * 8


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing of unsigned integers, another one for each seed."""
    x = values + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class CountSketch:
    """Signed counters of one field by prefix length; all of them take ``len(bits) * depth * width * 8`` bytes."""

    def __init__(self, shape: Shape) -> None:
        self.shape = shape
        self.cells = np.zeros((len(shape.bits), shape.depth, shape.width), np.int64)
        self.total = 0
        self.kept: list[np.ndarray] = []

    def _places(self, level: int, row: int, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = _mixed(prefixes, level * self.shape.depth + row)
        return (mixed >> np.uint64(1)) & np.uint64(self.shape.width - 1), 1 - 2 * (mixed & np.uint64(1)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        self.total += len(hashes)
        for level, bits in enumerate(self.shape.bits):
            prefixes, counts = np.unique(hashes >> np.uint64(64 - bits), return_counts=True)
            for row in range(self.shape.depth):
                place, sign = self._places(level, row, prefixes)
                sums = np.bincount(place.astype(np.int64), weights=sign * counts, minlength=self.shape.width)
                self.cells[level, row] += sums.astype(np.int64)

    def estimate(self, level: int, prefixes: np.ndarray) -> np.ndarray:
        rows = []
        for row in range(self.shape.depth):
            place, sign = self._places(level, row, prefixes)
            rows.append(self.cells[level, row][place.astype(np.int64)] * sign)
        return np.median(np.array(rows), axis=0)

    def heavy(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Prefixes of full length estimated at ``least`` or more, found by going down through heavy prefixes only."""
        prefixes = np.zeros(1, np.uint64)
        estimates = np.zeros(1)
        before = 0
        self.kept = []
        for level, bits in enumerate(self.shape.bits):
            step = np.uint64(bits - before)
            children = np.arange(1 << (bits - before), dtype=np.uint64)
            prefixes = ((prefixes << step)[:, None] | children[None, :]).ravel()
            estimates = self.estimate(level, prefixes)
            chosen = estimates >= least
            prefixes, estimates, before = prefixes[chosen], estimates[chosen], bits
            self.kept.append(estimates)
        return prefixes, estimates

    def miss_bound(self, margin: float) -> float:
        """An upper bound on the probability that a given item was estimated at ``margin`` or more below its count on some
        level that :meth:`heavy` came to.

        A row errs so if the item's counter is also that of a prefix kept there, or else with a probability of the other
        counters' squares over ``width * margin ** 2`` at most (Chebyshev); the median only if more than half of the rows do.
        """
        half, total = self.shape.depth // 2 + 1, 0.0
        for level, kept in enumerate(self.kept):
            squares = float(np.median((self.cells[level].astype(np.float64) ** 2).sum(axis=1)))
            rest = max(0.0, squares - float((kept**2).sum()))
            row = (len(kept) + rest / margin**2) / self.shape.width if margin > 0 else 1.0
            total += comb(self.shape.depth, half) * min(1.0, row) ** half
        return min(1.0, total)


SKETCH = "field_name string, total bigint, cells binary"


def _sketch(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[str, CountSketch] = {}
        for batch in batches:
            fields = batch.column(0).dictionary_encode()
            codes = fields.indices.to_numpy()
            hashes = batch.column(1).to_numpy().view(np.uint64)
            for code, field in enumerate(fields.dictionary.to_pylist()):
                sketches.setdefault(field, CountSketch(shape)).add(hashes[codes == code])
        yield _as_batch(sketches)

    return run


def _add_up(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[str, CountSketch] = {}
        for batch in batches:
            for field, total, cells in zip(*(column.to_pylist() for column in batch.columns)):
                own = sketches.setdefault(field, CountSketch(shape))
                own.total += total
                own.cells += np.frombuffer(cells, np.int64).reshape(own.cells.shape)
        yield _as_batch(sketches)

    return run


def _as_batch(sketches: dict[str, CountSketch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(sketches), pa.string()),
            pa.array([s.total for s in sketches.values()], pa.int64()),
            pa.array([s.cells.tobytes() for s in sketches.values()], pa.binary()),
        ],
        names=["field_name", "total", "cells"],
    )


def frequent_items(values: DataFrame, support: Fraction = Fraction(1, 100), shape: Shape | None = None, slack: float = 0.5) -> DataFrame:
    """``(field_name, item, n, estimate, n_field, miss_bound)`` of the items with at least ``support`` of their field's rows.

    ``values`` has ``field_name`` (few different ones) and ``item`` (string); rows with a null in either do not count,
    repeated rows count each, and an item exactly at the support belongs. First scan: each partition adds the items'
    64-bit hashes to a count-sketch per field and hash-prefix length (:meth:`Shape.of` the support unless one is given);
    the sketches, all of one fixed size, are added up in two steps. The driver goes down from the shortest prefixes,
    keeping those estimated at ``slack * support`` or more, which are at most a few times ``1 / (slack * support)``.
    Second scan: items under a kept prefix are counted exactly, so no item below the support is reported; one above it
    could only be missed if the median of ``depth`` estimates erred by ``(1 - slack) * support`` of all rows, which
    ``miss_bound`` bounds. Up to ``MOST_BROADCAST`` candidates go to the rows, of which those under no candidate leave
    where they lie and the others are combined before they are shuffled; more candidates than that meet items that are
    added up already. Either way no value is shuffled row by row, and a hot item is one counter a partition. An empty
    table gives no rows; items of any length take part as their hash; other columns do not take part.
    """
    spark = values.sparkSession
    shape = shape or Shape.of(support)
    values = values.select("field_name", "item").where("field_name is not null and item is not null")
    hashed = values.select("field_name", F.xxhash64("item").alias("hash"))
    parts = hashed.mapInArrow(_sketch(shape), SKETCH)
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    added = parts.repartition(width).mapInArrow(_add_up(shape), SKETCH).repartition(1).mapInArrow(_add_up(shape), SKETCH)
    wanted = []
    for row in added.collect():  # one row of fixed size per field
        sketch = CountSketch(shape)
        sketch.cells += np.frombuffer(row["cells"], np.int64).reshape(sketch.cells.shape)
        least = ceil(support * row["total"])
        prefixes, estimates = sketch.heavy(slack * least)
        missed = sketch.miss_bound((1 - slack) * least)
        wanted += [(row["field_name"], int(p), int(e), least, row["total"], missed) for p, e in zip(prefixes, estimates)]
    ddl = "field_name string, prefix bigint, estimate bigint, least bigint, n_field bigint, miss_bound double"
    candidates = spark.createDataFrame(wanted, ddl)
    known = ["estimate", "least", "n_field", "miss_bound"]
    prefix = F.shiftrightunsigned(F.xxhash64("item"), 64 - shape.bits[-1])
    if len(wanted) <= MOST_BROADCAST:
        counted = values.withColumn("prefix", prefix).join(F.broadcast(candidates), ["field_name", "prefix"])
        groups = counted.groupBy("field_name", "item", *known).agg(F.count("*").alias("n"))
    else:
        sums = values.groupBy("field_name", "item").agg(F.count("*").alias("n"))
        groups = sums.withColumn("prefix", prefix).join(candidates, ["field_name", "prefix"])
    return groups.where("n >= least").select("field_name", "item", "n", "estimate", "n_field", "miss_bound")
