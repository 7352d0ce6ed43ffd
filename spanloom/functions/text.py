"""Scalar text expressions of the annotation model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(text: Column) -> Column:
    """Text as a document takes it on construction: typographic apostrophes made plain, a colon between two
    characters set apart by blanks, runs of blanks made one. Not idempotent (``a:b:c`` needs two passes), so apply it
    once. Null stays null."""
    plain = F.replace(text, F.lit("’"), F.lit("'"))
    return F.regexp_replace(F.regexp_replace(plain, r"([^\s])(:)([^\s])", "$1 $2 $3"), " {2,}", " ")
