"""Annotated documents as XML: per type an element ``<Type>s class="..."`` with the annotations nested in it."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.spans import covered_text
from spanloom.operators.store import STORE, by_layer, lineage
from spanloom.sources.files import locate

OPTIONS = {"rowTag": "AnnotatedText", "attributePrefix": "_", "valueTag": "value", "ignoreSurroundingSpaces": "false"}


def _layer(ann_type: str, text: Column, package: str) -> Column:
    def element(a: Column) -> Column:
        spans = F.struct(F.transform(a["spans"], lambda s: F.struct(s["begin"].alias("_begin"), s["end"].alias("_end"))).alias("span"))
        return F.struct(F.lit(f"{package}{ann_type}").alias("_class"), covered_text(text, a["spans"]).alias("_coveredText"), spans.alias("spans"), a["fields"].alias("fields"))

    layer = F.col(f"{ann_type}s")
    own = F.struct(F.lit(f"{package}{ann_type}").alias("_class"), F.transform(layer, element).alias(ann_type))
    return F.when(F.size(layer) > 0, own).alias(f"{ann_type}s")


def documents_xml(documents: DataFrame, store: DataFrame, types: list[str], package: str = "") -> DataFrame:
    """``(id, xml)`` of documents (``id``, ``text``, ``enhanced_by``) with their annotations of some types.

    Spans, covered text, ids and classes are attributes or elements named as ``span``, ``coveredText``, ``id``, ``class``; an annotation
    listed under two of the types comes in both elements. One join by id, which must be unique; documents without
    annotations keep no element for them.
    """
    layers = by_layer(store, types)
    both = documents.join(layers.withColumnRenamed("doc_id", "id"), "id", "left")
    document = F.struct(
        F.col("id").alias("_id"), F.col("text").alias("text"), F.struct(F.col("enhanced_by").alias("string")).alias("enhancedBy"),
        F.struct(*[_layer(t, F.col("text"), package) for t in types]).alias("annotations"),
    )
    return both.select("id", F.to_xml(document, OPTIONS).alias("xml"))


def _schema(types: list[str]) -> str:
    element = "_class: string, _coveredText: string, spans: struct<span: array<struct<_begin: int, _end: int>>>, fields: map<string, string>"
    layers = ", ".join(f"{t}s: struct<_class: string, {t}: array<struct<{element}>>>" for t in types)
    return f"_id string, text string, enhancedBy struct<string: array<string>>, annotations struct<{layers}>"


def read_documents_xml(rows: DataFrame, types: list[str], xml: str = "xml", parents: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and annotation store of XML texts as :func:`documents_xml` writes them.

    Annotations are listed anew under their type and its supertypes. XML that cannot be read gives a document without
    id and annotations.
    """
    parsed = rows.select(F.from_xml(F.col(xml), _schema(types), OPTIONS).alias("d")).select("d.*")
    nobody = F.array().cast("array<string>")
    documents = parsed.select(F.col("_id").alias("id"), "text", F.coalesce("enhancedBy.string", nobody).alias("enhanced_by"))
    store = None
    for t in types:
        each = parsed.select(F.col("_id").alias("doc_id"), F.posexplode(f"annotations.{t}s.{t}").alias("seq", "a"))
        spans = F.transform("a.spans.span", lambda s: F.struct(s["_begin"].alias("begin"), s["_end"].alias("end")))
        listed = F.array(*[F.lit(x) for x in lineage(t, parents or {})])
        none = F.expr("cast(map() as map<string,string>)")
        part = each.select(
            "doc_id", F.lit(t).alias("ann_type"), listed.alias("listed_under"), F.col("seq").cast("bigint").alias("seq"),
            spans.cast("array<struct<begin:int,end:int>>").alias("spans"), F.coalesce("a.fields", none).alias("fields"),
        )
        store = part if store is None else store.unionByName(part)
    return documents, store if store is not None else rows.sparkSession.createDataFrame([], STORE)


def write_document_files(xml: DataFrame, folder: str) -> int:
    """One file ``<id>.xml`` a document below ``folder``, written by the executors; how many there were.

    Ids are escaped as in URLs, so that no id leaves the folder. A task that is run again writes the same files again; of
    documents with one id the last written stays, so ids must be unique. Null texts are no files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = locate(folder)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{inner.rstrip('/')}/{quote(name, safe='')}.xml") as out:
                    out.write(text.encode())
            yield batch.select(["id"])

    rows = xml.where("id is not null and xml is not null").select(F.col("id").cast("string"), F.col("xml").cast("string"))
    return rows.mapInArrow(write, "id string").count()


def written_ids(spark, folder: str) -> DataFrame:
    """``id`` of the documents that have a file below ``folder``, for runs that go on."""
    from urllib.parse import unquote

    from spanloom.sources.files import list_files

    names = [(unquote(path.rpartition("/")[2][:-4]),) for path in list_files(f"{folder.rstrip('/')}/*.xml")]
    return spark.createDataFrame(names, "id string")
