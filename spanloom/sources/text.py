"""Text formats: curated relations, documents parted by blank lines, properties, annotation XML."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanloom.sources.files import list_files, read_lines


def read_relations(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """``(cui1, cui2, rel)`` of tab-separated lines; further tabs belong to ``rel``.

    A line of fewer than three fields fails the job on reading, or is left out with ``mode="DROPMALFORMED"``.
    """
    return split_relations(spark.read.text(path), "value", mode)


def split_relations(lines: DataFrame, line: str, mode: str = "FAILFAST") -> DataFrame:
    parts = F.split(line, "\t", 3)
    rows = lines.select(parts.alias("parts"))
    if mode == "DROPMALFORMED":
        rows = rows.where(F.size("parts") == 3)
    else:
        wrong = F.raise_error(F.concat(F.lit("fewer than three fields: "), F.array_join("parts", "|")))
        rows = rows.select(F.when(F.size("parts") == 3, F.col("parts")).otherwise(wrong.cast("array<string>")).alias("parts"))
    return rows.select(*[F.col("parts")[i].alias(name) for i, name in enumerate(("cui1", "cui2", "rel"))])


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


def frame_documents(lines: Iterator[str]) -> Iterator[str]:
    """Texts between empty lines, trimmed: each empty line ends a text, so two in a row give an empty one; the last
    needs none."""
    own: list[str] = []
    open_text = False
    for line in lines:
        if line:
            own.append(line)
            open_text = True
        else:
            yield "\n".join(own).strip()
            own, open_text = [], False
    if open_text:
        yield "\n".join(own).strip()


class BlankLineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_File(path) for path in list_files(self.paths)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple[str, int, str]]:
        if partition is None:  # as it is where no file matches
            return
        lines = (line.decode("utf-8", "replace").rstrip("\n") for _, line in read_lines(partition.path))
        for number, text in enumerate(frame_documents(lines)):
            yield partition.path, number, text


class BlankLineSource(DataSource):
    """``spark.read.format("blanklines").load(glob)``: documents with their file and number in it."""

    @classmethod
    def name(cls) -> str:
        return "blanklines"

    def schema(self) -> str:
        return "source_file string, doc_no bigint, text string"

    def reader(self, schema: Any) -> DataSourceReader:
        return BlankLineReader(self.options)


def read_blank_line_documents(spark: SparkSession, paths: str) -> DataFrame:
    """One partition per file, lines in order; a file is read by one task, files in parallel."""
    spark.dataSource.register(BlankLineSource)
    return spark.read.format("blanklines").load(paths)


def read_properties(text: str) -> dict[str, str]:
    """Keys and values of a properties file's text: ``key=value`` or ``key: value``, ``#`` and ``!`` start comments."""
    found: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            at = min([line.find(mark) for mark in "=:" if mark in line] or [len(line)])
            found[line[:at].strip()] = line[at + 1 :].strip()
    return found


def document_xml(columns: dict[str, Column]) -> Column:
    """A document's columns as one XML element; columns called ``_name`` become attributes."""
    return F.to_xml(F.struct(*[column.alias(name) for name, column in columns.items()]), {"rowTag": "document", "attributePrefix": "_"})


def write_xml(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents with nested annotations as XML files, one element per document."""
    documents.write.format("xml").option("rowTag", "document").option("rootTag", "documents").option("attributePrefix", "_").mode(mode).save(path)


def read_xml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", "document").option("attributePrefix", "_").option("ignoreSurroundingSpaces", "false")
    return reader.schema(schema).load(path)
