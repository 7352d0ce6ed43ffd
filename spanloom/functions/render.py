"""How spans, annotations, concepts and nodes are written out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def show_span(span: Column) -> Column:
    return F.format_string("[%d,%d)", span["begin"], span["end"])


def show_annotation(kind: str, covered: Column) -> Column:
    """For example ``Token[fever]``; a document is shown like an annotation of its whole text."""
    return F.concat(F.lit(f"{kind}["), covered, F.lit("]"))


def show_chunk(chunk_type: Column, covered: Column) -> Column:
    return F.concat(F.lit("Chunk_"), chunk_type, F.lit("["), covered, F.lit("]"))


def show_concept(concept: Column) -> Column:
    return F.concat(concept["concept_id"], F.lit("-"), concept["preferred_label"], F.lit("["), concept["source"], F.lit("]"))


def node_label(tokens: Column, field: str = "lemma") -> Column:
    """A node's tokens in order of position, one field of each joined by blanks."""
    ordered = F.array_sort(F.transform(tokens, lambda t: F.struct(t["position"].alias("p"), t[field].alias("f"))))
    return F.array_join(F.transform(ordered, lambda t: t["f"]), " ")


def show_node(tokens: Column) -> Column:
    return F.concat(F.lit("DepNode["), node_label(tokens, "covered_text"), F.lit("]"))
