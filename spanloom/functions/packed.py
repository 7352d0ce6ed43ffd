"""Expressions over fields that pack several values into one string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quoted span. Possessive, so that long spans are matched in a loop and not by recursion.
QUOTED = r""""(?:[^"\\]++|\\"|""|\\)*+"|'[^']*+'"""
#: What a value without quotes cannot hold.
SEPARATOR = r"[^\p{L}\p{N}._-]+"
#: Opens a placeholder. Everything outside quotes is reduced to value characters and blanks before placeholders are put
#: in, so no character of the data can be taken for one.
PLACEHOLDER = "\ue000"


def packed_items(packed: Column) -> Column:
    """The values packed in a string, as an array in their order.

    Quoted spans are exchanged for placeholders that carry their index, the rest is split at its delimiters, and the
    placeholders are looked up again in the array of spans. Quotes are dropped; in double quotes ``""`` and ``\\"`` are
    one quote. Empty parts do not count, repeats stay. A quote that is never closed separates like any other
    character. Null gives null, a blank string an empty array.
    """
    spans = F.regexp_extract_all(packed, F.lit(QUOTED), F.lit(0))
    outside = F.split(packed, QUOTED, -1)

    def mask(piece: Column, index: Column) -> Column:
        bare = F.regexp_replace(piece, SEPARATOR, " ")
        mark = F.concat(F.lit(f" {PLACEHOLDER}"), index.cast("string"), F.lit(" "))
        return F.concat(bare, F.when(index < F.size(spans), mark).otherwise(""))

    masked = F.array_join(F.transform(outside, mask), "")
    parts = F.filter(F.split(masked, " "), lambda part: part != "")

    def restore(part: Column) -> Column:
        span = F.get(spans, F.try_to_number(F.substring(part, 2, 9), F.lit("999999999")).cast("int"))
        inner = F.substr(span, F.lit(2), F.length(span) - 2)
        plain = F.when(F.startswith(span, F.lit('"')), F.regexp_replace(inner, r'""|\\"', '"')).otherwise(inner)
        return F.when(F.startswith(part, F.lit(PLACEHOLDER)), plain).otherwise(part)

    return F.filter(F.transform(parts, restore), lambda item: item != "")
