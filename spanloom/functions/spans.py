"""Expressions over spans: structs ``begin, end`` (half open, code points) and arrays of them in text order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_spans(text: Column, separators: str) -> Column:
    """Spans of the non-empty pieces between single separator characters (a character class such as ``[\\n\\r]``).

    One fold over the pieces with a running offset, so no text is exploded or shuffled. Null gives null.
    """
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<begin:int,end:int>>)").alias("found"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        span = F.struct(state["at"].alias("begin"), end.alias("end"))
        found = F.when(piece == "", state["found"]).otherwise(F.array_append(state["found"], span))
        return F.struct((end + 1).alias("at"), found.alias("found"))

    return F.aggregate(F.split(text, separators, -1), start, step, lambda state: state["found"])


def piece(text: Column, begin: Column, end: Column) -> Column:
    return F.substring(text, begin + 1, end - begin)


def covered_text(text: Column, spans: Column) -> Column:
    """The pieces of a multi-span annotation joined by one blank."""
    return F.array_join(F.transform(spans, lambda s: piece(text, s["begin"], s["end"])), " ")


def begin_of(spans: Column) -> Column:
    return F.get(spans, F.lit(0))["begin"]


def end_of(spans: Column) -> Column:
    return F.try_element_at(spans, F.lit(-1))["end"]


def between(begin: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether an annotation lies inside ``[low, high]``."""
    return (begin >= low) & (end <= high)


def contains(spans: Column, begin: Column, end: Column) -> Column:
    """Whether some single span covers ``[begin, end)``."""
    return F.exists(spans, lambda s: (s["begin"] <= begin) & (s["end"] >= end))


def all_within(spans: Column, begin: Column, end: Column) -> Column:
    """Whether every span lies inside ``[begin, end]``."""
    return F.forall(spans, lambda s: (s["begin"] >= begin) & (s["end"] <= end))


def in_order(spans: Column) -> Column:
    """Whether spans are ordered, do not overlap and none begins behind its end."""
    after = F.transform(spans, lambda s, i: (s["begin"] <= s["end"]) & ((i == 0) | (s["begin"] >= F.get(spans, i - 1)["end"])))
    return F.forall(after, lambda ok: F.coalesce(ok, F.lit(True)))


def resolve_overlaps(spans: Column, begin: str = "begin", size: str = "size") -> Column:
    """Keys ``(begin, size)`` that stay when overlapping or adjacent ones are resolved.

    In order of ``begin`` each key is compared with the last one kept: one that starts behind it with a gap is
    added; else the longer of both stays, the earlier on ties. Null gives null.
    """
    kept = F.expr(f"cast(array() as array<struct<{begin}:int,{size}:int>>)")

    def step(state: Column, key: Column) -> Column:
        last = F.try_element_at(state, F.lit(-1))
        apart = F.size(state).eqNullSafe(0) | (last[begin] + last[size] < key[begin])
        replaced = F.array_append(F.slice(state, F.lit(1), F.greatest(F.size(state) - 1, F.lit(0))), key)
        return F.when(apart, F.array_append(state, key)).when(key[size] <= last[size], state).otherwise(replaced)

    keys = F.transform(spans, lambda s: F.struct(s[begin].cast("int").alias(begin), s[size].cast("int").alias(size)))
    return F.aggregate(F.array_sort(keys), kept, step)


def relocate(text: Column, wanted: Column) -> Column:
    """Where each of some strings begins in ``text``, searched in order, each behind the start of the one before.

    ``wanted`` is an array of strings; the result an array of begins, -1 for a string not found, behind which the
    search starts at the beginning again.
    """
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("found"))

    def step(acc: Column, entity: Column) -> Column:
        place = F.call_function("locate", entity, text, acc["at"] + 1) - 1
        return F.struct((place + 1).alias("at"), F.array_append(acc["found"], place).alias("found"))

    return F.aggregate(wanted, state, step, lambda acc: acc["found"])
