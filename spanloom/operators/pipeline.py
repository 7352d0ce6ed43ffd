"""Annotators and pipelines of them over documents with nested annotations."""

from __future__ import annotations

from abc import ABC, abstractmethod

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from spanloom.functions.constants import ACRONYM, NOUN, whole
from spanloom.functions.let import let
from spanloom.functions.spans import piece, split_spans
from spanloom.functions.text import clean_text
from spanloom.session import stored
from spanloom.sources.files import read_bytes

#: The id of a document without one.
NO_ID = "NO_ID"
#: Digests of finished documents, 64 characters each, that are broadcast.
MOST_DONE = 100_000
TOKENS = "array<struct<sent_no:int,position:int,begin:int,end:int,covered_text:string,lemma:string,pos_tag:string>>"
CHUNKS = "array<struct<begin:int,end:int,chunk_type:string>>"
CONCEPTS = "array<struct<source:string,concept_id:string,preferred_label:string,synonyms:array<string>,score:double>>"
MENTIONS = f"array<struct<begin:int,end:int,covered_text:string,concepts:{CONCEPTS}>>"
LAYERS = {"sections": "array<struct<begin:int,end:int>>", "tokens": TOKENS, "chunks": CHUNKS, "mentions": MENTIONS}


class Annotator(ABC):
    """The extension point: adds to a document's layers.

    Documents have ``id``, ``text``, ``enhanced_by`` and the layers of ``LAYERS``. An annotator runs once on a document; those it has run on
    already pass unchanged, null layers count as empty. It is an expression over the document, so that a chain of annotators
    stays one narrow projection whose size grows with the number of annotators only.
    """

    @property
    def name(self) -> str:
        return type(self).__name__

    @abstractmethod
    def annotate(self, document: Column) -> Column:
        """The document, a struct, with fields changed."""

    def apply(self, document: Column) -> Column:
        names = F.coalesce(document["enhanced_by"], F.array().cast("array<string>"))
        done = F.array_contains(names, self.name)
        marked = let(self.annotate(document), lambda d: d.withField("enhanced_by", F.array_append(names, self.name)))
        return F.when(done, document).otherwise(marked)


class FrameAnnotator(ABC):
    """An annotator that needs Python, such as a model: a function of a DataFrame (``mapInPandas`` or ``mapInArrow``)."""

    @property
    def name(self) -> str:
        return type(self).__name__

    @abstractmethod
    def annotate_frame(self, documents: DataFrame) -> DataFrame:
        """Documents, none of which it has run on, with layers added and the columns kept."""

    def run(self, documents: DataFrame) -> DataFrame:
        names = F.coalesce("enhanced_by", F.array().cast("array<string>"))
        done = F.array_contains(names, self.name)
        fresh = self.annotate_frame(documents.where(~done)).withColumn("enhanced_by", F.array_append(names, self.name))
        return documents.where(done).unionByName(fresh)


class LineTokenizer(Annotator):
    """Sections and sentences are lines, tokens lie between blanks; lemma is the lower case, the tag a guess by form."""

    def annotate(self, document: Column) -> Column:
        text = document["text"]

        def words(line: Column, number: Column) -> Column:
            own = piece(text, line["begin"], line["end"])
            return let(own, lambda t: F.transform(split_spans(t, " "), lambda w, i: let(piece(t, w["begin"], w["end"]), lambda x: self.token(line, number, x, w, i))))

        tokens = lambda lines: F.flatten(F.transform(lines, words))
        return let(split_spans(text, r"[\n\r]"), lambda lines: document.withField("sections", lines).withField("tokens", tokens(lines)))

    @staticmethod
    def token(line: Column, number: Column, text: Column, word: Column, at: Column) -> Column:
        tag = F.when(text.rlike("^[0-9.,%]+$"), "CD").when(text.rlike("(?:ed|ing|izes|uces)$"), "VBD").when(text.rlike("(?:ous|al|ive|ic)$"), "JJ")
        tag = tag.when(F.lower(text).isin("the", "a", "an"), "DT").when(F.lower(text).isin("of", "in", "by", "with", "for", "to"), "IN").otherwise("NN")
        return F.struct(
            number.alias("sent_no"), (at + 1).alias("position"), (line["begin"] + word["begin"]).alias("begin"), (line["begin"] + word["end"]).alias("end"),
            text.alias("covered_text"), F.lower(text).alias("lemma"), tag.alias("pos_tag"),
        )


class ChunkMerger(Annotator):
    """Neighbouring chunks of one type in the ``chunks`` layer, which some chunker filled, made one."""

    def annotate(self, document: Column) -> Column:
        def step(done: Column, chunk: Column) -> Column:
            last = F.try_element_at(done, F.lit(-1))
            longer = last.withField("end", chunk["end"])
            same = (F.size(done) > 0) & last["chunk_type"].eqNullSafe(chunk["chunk_type"])
            return F.when(same, F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), longer)).otherwise(F.array_append(done, chunk))

        none = F.expr(f"cast(array() as {CHUNKS})")
        return document.withField("chunks", F.aggregate(F.array_sort(F.coalesce(document["chunks"], none)), none, step))


class AcronymAnnotator(Annotator):
    """Noun tokens that look like acronyms and that no mention covers, as mentions with a concept of source ACRONYM."""

    def annotate(self, document: Column) -> Column:
        tokens = F.coalesce(document["tokens"], F.expr(f"cast(array() as {TOKENS})"))

        def fits(t: Column, old: Column) -> Column:
            free = ~F.exists(old, lambda m: (m["begin"] <= t["begin"]) & (m["end"] >= t["end"]))
            return t["pos_tag"].rlike(whole(NOUN)) & t["covered_text"].rlike(whole(ACRONYM)) & free

        def mention(t: Column) -> Column:
            name = F.upper(t["covered_text"])
            concept = F.struct(F.lit("ACRONYM").alias("source"), name.alias("concept_id"), name.alias("preferred_label"), F.array(name).alias("synonyms"), F.lit(0.5).alias("score"))
            return F.struct(t["begin"].alias("begin"), t["end"].alias("end"), t["covered_text"].alias("covered_text"), F.array(concept).alias("concepts"))

        added = lambda old: F.concat(old, F.transform(F.filter(tokens, lambda t: fits(t, old)), mention))
        return document.withField("mentions", let(F.coalesce(document["mentions"], F.expr(f"cast(array() as {MENTIONS})")), added))


class EntitySelector(Annotator):
    """Concepts above a score, mentions that still have one, and of those no one inside another."""

    def __init__(self, threshold: float = 0.1, source: str = "") -> None:
        self.threshold, self.source = threshold, source

    def annotate(self, document: Column) -> Column:
        keep = lambda c: (c["score"] > self.threshold) | (F.lit(bool(self.source)) & (c["source"] != self.source))
        scored = F.transform(document["mentions"], lambda m: m.withField("concepts", F.filter(m["concepts"], keep)))

        def free(m: Column, i: Column, kept: Column) -> Column:
            size = m["end"] - m["begin"]

            def covers(o: Column, at: Column) -> Column:
                wider = (o["begin"] <= m["begin"]) & (o["end"] >= m["end"])
                return wider & ((o["end"] - o["begin"] > size) | ((o["end"] - o["begin"] == size) & (at < i)))

            return ~F.exists(F.transform(kept, covers), lambda x: x)

        chosen = lambda kept: F.filter(kept, lambda m, i: free(m, i, kept))
        return document.withField("mentions", let(F.filter(scored, lambda m: F.size(m["concepts"]) > 0), chosen))


class Pipeline:
    """Annotators one after the other; all narrow, so a document passes them in one task."""

    def __init__(self, annotators: list[Annotator | FrameAnnotator]) -> None:
        if not annotators:
            raise ValueError("a pipeline needs an annotator")
        self.annotators = annotators

    def run(self, documents: DataFrame) -> DataFrame:
        pending: list[Annotator] = []
        for annotator in [*self.annotators, None]:
            if isinstance(annotator, Annotator):
                pending.append(annotator)
                continue
            if pending:
                document = F.struct(*documents.columns)
                for each in pending:
                    document = let(document, each.apply)
                documents = documents.select(document.alias("document")).select("document.*")
                pending = []
            if annotator is not None:
                documents = annotator.run(documents)
        return documents

    def append(self, documents: DataFrame, path: str) -> DataFrame:
        """Annotate the documents that are not yet in the table at ``path``, append them to it and return them all.

        A document is told by its id, or where that is ``NO_ID`` by its text too. Digests are compared, never texts. Up to
        ``MOST_DONE`` of them go to the documents, so that no text is shuffled; beyond that documents meet them by a shuffle.
        """
        spark = documents.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            done = stored(spark.read.parquet(path).select(_identity().alias("done")).distinct(), "done")
            done = F.broadcast(done) if done.count() <= MOST_DONE else done
            documents = documents.join(done, _identity() == F.col("done"), "left_anti")
        self.run(documents).write.mode("append").parquet(path)
        return spark.read.parquet(path)


def _identity() -> Column:
    own = F.when(F.col("id") == NO_ID, F.concat(F.lit("text:"), F.coalesce("text", F.lit("")), F.col("text").isNull().cast("string")))
    return F.sha2(own.otherwise(F.concat(F.lit("id:"), F.col("id"))), 256)


def as_documents(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows as documents without annotations: text cleaned once, a null key called ``NO_ID``."""
    layers = [F.lit(None).cast(kind).alias(name) for name, kind in LAYERS.items()]
    return rows.select(
        F.coalesce(F.col(key).cast("string"), F.lit(NO_ID)).alias("id"), clean_text(F.col(text)).alias("text"), F.array().cast("array<string>").alias("enhanced_by"), *layers
    )


def full_pipeline(threshold: float = 0.1) -> Pipeline:
    """The default: tokenizer, chunk merging, acronyms, selection."""
    return Pipeline([LineTokenizer(), ChunkMerger(), AcronymAnnotator(), EntitySelector(threshold)])


def batches(documents: DataFrame, size: int, order: str = "id") -> DataFrame:
    """Documents with a ``batch`` number: runs of ``size`` documents in the order of ``order``, the last one maybe shorter.

    The rows are parted by ranges of ``order`` and numbered within their part; only the parts' sizes, one number each, are
    added up in order, so no task sees all rows.
    """
    parts = stored(documents.repartitionByRange(order).sortWithinPartitions(order).withColumn("part_no", F.spark_partition_id()).withColumn("row_no", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranges")
    sizes = parts.groupBy("part_no").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part_no")) - F.col("n")).select("part_no", "before")  # a row for each part
    numbered = parts.join(F.broadcast(before), "part_no").withColumn("batch", F.floor((F.col("before") + F.col("row_no")) / size))
    return numbered.drop("part_no", "row_no", "before")


def counted(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``rows`` with counters beside them: how many rows passed (``rows``) and what ``counts`` add up, to be read from the
    observation once a job over them has ended. Nothing is computed twice."""
    observation = Observation(name)
    return rows.observe(observation, F.count(F.lit(1)).alias("rows"), *[value.alias(key) for key, value in counts.items()]), observation


class ModelAnnotator(FrameAnnotator):
    """An annotator around a model in a file that all executors reach.

    ``load`` turns the file's bytes into a function from a Pandas frame of documents to one with the same columns. Each Python worker
    loads the file once, when its first batch comes.
    """

    def __init__(self, path: str, load: Callable[[bytes], Callable], name: str = "") -> None:
        self.path, self.load, self._name = path, load, name

    @property
    def name(self) -> str:
        return self._name or type(self).__name__

    def annotate_frame(self, documents: DataFrame) -> DataFrame:
        path, load = self.path, self.load

        def run(frames: Iterator) -> Iterator:
            model = None
            for frame in frames:
                model = model or loaded(path, load)
                yield model(frame)

        return documents.mapInPandas(run, documents.schema)


_MODELS: dict[str, Callable] = {}


def loaded(path: str, load: Callable[[bytes], Callable]) -> Callable:
    """The model of a file, loaded once in a process."""
    if path not in _MODELS:
        _MODELS[path] = load(b"".join(read_bytes(path)))
    return _MODELS[path]
