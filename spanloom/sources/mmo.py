"""MetaMap machine output: record framing, strict parser and loader that sets damaged records apart."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.utils import AnalysisException

from spanloom.sources.files import Truncated, list_files, read_lines

UTTERANCE_DDL = (
    "pmid string, section string, num int, utt_id string, text string, start_pos int, length int, "
    "phrases array<struct<start_pos int, length int, candidates array<struct<score int, cui string, "
    "semtypes array<string>, positions array<struct<start_pos int, length int>>>>, "
    "mappings array<struct<score int, cuis array<string>>>>>"
)
MAPPINGS_DDL = f"{UTTERANCE_DDL}, mappings_reason string"
END_OF_UTTERANCE = "'EOU'."

# The grammar as regular expressions. A token may have white space before it and, once matched, is never given up
# again, so all repetitions are possessive and all alternatives atomic.
WS = r"[ \t\n\x0b\f\r]*+"
DOT = r"[^\n\r\x85\u2028\u2029]"


def lit(text: str) -> str:
    return WS + re.escape(text)


def quoted(mark: str, group: bool = False) -> str:
    body = rf"(?:[^{mark}\\]++|\\{mark}|\\|{mark}{mark}|{mark}(?![,\[\]()]))*+"
    return rf"{lit(mark)}{WS}{f'({body})' if group else body}{lit(mark)}"


def bracketed(element: str, group: bool = False) -> str:
    body = rf"(?:{element}(?:{lit(',')}{element})*+)?+"
    return rf"{lit('[')}{f'({body})' if group else body}{lit(']')}"


SYMBOL = rf"{WS}[^,\n()\[\]]*+"
NUMBER = rf"{WS}-?[0-9]++"
SYMBOL_OR_QUOTE = rf"(?>{quoted(chr(39))}|{SYMBOL})"
SYMBOLS = bracketed(SYMBOL)
MATCH_MAP = bracketed(bracketed(rf"(?>{bracketed(NUMBER)}|{NUMBER})"))

HEADER = re.compile(
    "".join(rf"(?:{lit(word)}{WS}[^\n]++\n)?+" for word in ("args", "aas", "neg_list"))
    + lit("utterance(")
)
UTTERANCE = re.compile(
    quoted("'", True) + lit(",") + quoted('"', True) + lit(",") + rf"{WS}([^,\n()\[\]]*+)" + lit(",")
    + SYMBOLS + WS + r"\)\.\n"
)
PHRASE = re.compile(
    lit("phrase(") + SYMBOL_OR_QUOTE + lit(",") + rf"{WS}(?>{DOT}*\],){WS}([^,\n()\[\]]*+){WS},[^\n]++\n"
)
PHRASE_START = re.compile(lit("phrase("))
CANDIDATES = re.compile(lit("candidates(") + (NUMBER + lit(",")) * 4 + lit("["))
CANDIDATE = re.compile(
    lit("ev(") + rf"{WS}(-?[0-9]++)" + lit(",") + quoted("'", True) + lit(",") + SYMBOL_OR_QUOTE + lit(",")
    + SYMBOL_OR_QUOTE + lit(",") + SYMBOLS + lit(",") + bracketed(SYMBOL, True) + lit(",") + MATCH_MAP + lit(",")
    + rf"{WS}(?:yes|no),(?:yes|no)" + lit(",") + bracketed(quoted("'")) + lit(",") + bracketed(SYMBOL, True)
    + lit(",") + NUMBER + lit(")")
)
COMMA = re.compile(lit(","))
CANDIDATES_END = re.compile(lit("])."))
SKIPPED_MAPPINGS = re.compile(rf"{WS}mappings[^\n]++")
MAPPINGS = re.compile(lit("mappings(["))
MAPPING = re.compile(lit("map(") + rf"{WS}(-?[0-9]++)" + lit(",") + lit("["))
MAPPING_END = re.compile(lit("]") + lit(")"))
REST_BLANK = re.compile(WS + r"\Z")
END = re.compile(lit(END_OF_UTTERANCE) + WS + r"\Z")
INTEGER = re.compile(r"[+-]?[0-9]+")
POSITION = re.compile(r"([0-9]+)/([0-9]+)")


class Rejected(Exception):
    """A record that cannot be read: ``reason`` and the ``offset`` reading came to."""

    def __init__(self, reason: str, offset: int) -> None:
        super().__init__(reason)
        self.reason, self.offset = reason, offset


def _integer(text: str, reason: str, at: int) -> int:
    value = int(text) if INTEGER.fullmatch(text) else 1 << 31
    if not -(1 << 31) <= value < 1 << 31:
        raise Rejected(reason, at)
    return value


def _symbols(body: str) -> list[str]:
    return [item.lstrip(" \t\n\x0b\f\r") for item in body.split(",")]


class _Scan:
    def __init__(self, text: str, at: int = 0, stop: int | None = None) -> None:
        self.text, self.at, self.stop = text, at, len(text) if stop is None else stop

    def take(self, pattern: re.Pattern[str], reason: str) -> re.Match[str]:
        found = pattern.match(self.text, self.at, self.stop)
        if not found:
            raise Rejected(reason, self.at)
        self.at = found.end()
        return found

    def maybe(self, pattern: re.Pattern[str]) -> bool:
        found = pattern.match(self.text, self.at, self.stop)
        if found:
            self.at = found.end()
        return found is not None


def _candidate(scan: _Scan, start: int, length: int, checked: bool = True) -> dict[str, Any]:
    at = scan.at
    score, cui, semtypes, positions = scan.take(CANDIDATE, "candidate").groups()
    spans = []
    for item in _symbols(positions) if checked else ():
        found = POSITION.fullmatch(item)
        if not found:
            raise Rejected("candidate position", at)
        begin, size = (_integer(x, "candidate position", at) for x in found.groups())
        if begin < start or begin + size > start + length:
            raise Rejected("candidate position outside the utterance", at)
        spans.append({"start_pos": begin, "length": size})
    return {"score": _integer(score, "candidate score", at), "cui": cui, "semtypes": _symbols(semtypes), "positions": spans}


def _mappings(scan: _Scan, start: int, length: int) -> list[dict[str, Any]]:
    """The mappings of the line that ``scan`` is bounded by, or :class:`Rejected`."""
    mappings: list[dict[str, Any]] = []
    scan.take(MAPPINGS, "mappings")
    while not scan.maybe(CANDIDATES_END):
        if mappings:
            scan.take(COMMA, "mappings")
        score, cuis = scan.take(MAPPING, "mappings").group(1), []
        while not scan.maybe(MAPPING_END):
            if cuis:
                scan.take(COMMA, "mappings")
            cuis.append(_candidate(scan, start, length, checked=False)["cui"])
        mappings.append({"score": _integer(score, "mapping score", scan.at), "cuis": cuis})
    scan.take(REST_BLANK, "mappings")
    return mappings


def parse_record(text: str | None, with_mappings: bool = False) -> dict[str, Any]:
    """One machine-output record as an utterance, or :class:`Rejected`.

    Optional ``args``, ``aas`` and ``neg_list`` lines, the utterance with an id of three parts (the third an integer),
    phrases with candidates and mappings, and the closing ``'EOU'.``. Every candidate position must be two
    non-negative integers inside its utterance. Mappings are one line and never a ground to reject: unless asked for, the
    line is skipped; asked for, a line that cannot be read gives null mappings, and ``mappings_reason`` names the first.
    """
    if text is None:
        raise Rejected("null record", 0)
    if not text.strip(" \t\n\x0b\f\r"):
        raise Rejected("empty record", 0)
    scan = _Scan(text)
    scan.take(HEADER, "header")
    at = scan.at
    utt_id, utterance, position = scan.take(UTTERANCE, "utterance").groups()
    parts = utt_id.split(".", 2)
    if len(parts) != 3:
        raise Rejected("utterance id without three parts", at)
    num = _integer(parts[2], "utterance id without a number", at)
    start, slash, length = position.partition("/")
    if not slash:
        raise Rejected("utterance position", at)
    start, length = (_integer(x, "utterance position", at) for x in (start, length))
    phrases = []
    mappings_reason = None
    while PHRASE_START.match(text, scan.at):
        at = scan.at
        p_start, slash, p_length = scan.take(PHRASE, "phrase").group(1).partition("/")
        if not slash:
            raise Rejected("phrase position", at)
        phrase = {"start_pos": _integer(p_start, "phrase position", at), "length": _integer(p_length, "phrase position", at)}
        scan.take(CANDIDATES, "candidates")
        candidates = []
        if not scan.maybe(CANDIDATES_END):
            candidates.append(_candidate(scan, start, length))
            while not scan.maybe(CANDIDATES_END):
                scan.take(COMMA, "candidates")
                candidates.append(_candidate(scan, start, length))
        mappings: list[dict[str, Any]] | None = []
        at = scan.at
        scan.take(SKIPPED_MAPPINGS, "mappings")
        if with_mappings:
            try:
                mappings = _mappings(_Scan(text, at, scan.at), start, length)
            except Rejected as why:
                mappings, mappings_reason = None, mappings_reason or why.reason
        phrases.append(phrase | {"candidates": candidates, "mappings": mappings})
    scan.take(END, "end of the utterance")
    return {
        "pmid": parts[0], "section": parts[1], "num": num, "utt_id": f"{parts[0]}.{parts[1]}.{num}", "text": utterance,
        "start_pos": start, "length": length, "phrases": phrases, "mappings_reason": mappings_reason,
    }


POSITIONS_TYPE = pa.list_(pa.struct([("start_pos", pa.int32()), ("length", pa.int32())]))
CANDIDATE_TYPE = pa.struct([("score", pa.int32()), ("cui", pa.string()), ("semtypes", pa.list_(pa.string())), ("positions", POSITIONS_TYPE)])
MAPPING_TYPE = pa.struct([("score", pa.int32()), ("cuis", pa.list_(pa.string()))])
PHRASES_TYPE = pa.list_(
    pa.struct([("start_pos", pa.int32()), ("length", pa.int32()), ("candidates", pa.list_(CANDIDATE_TYPE)), ("mappings", pa.list_(MAPPING_TYPE))])
)
UTTERANCE_FIELDS = [
    ("pmid", pa.string()), ("section", pa.string()), ("num", pa.int32()), ("utt_id", pa.string()), ("text", pa.string()),
    ("start_pos", pa.int32()), ("length", pa.int32()), ("phrases", PHRASES_TYPE),
]


def _strict(with_mappings: bool, carried: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The conforming records of each batch: columns ``problem``, ``rec_text`` and ``carried`` others, which are passed on."""
    fields = UTTERANCE_FIELDS + [("mappings_reason", pa.string())] * with_mappings

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, rows = _conforming(batch, with_mappings)
            columns = [batch.column(2 + i).take(pa.array(places, pa.int64())) for i in range(carried)]
            columns += [pa.array([row[name] for row in rows], kind) for name, kind in fields]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[2:], *(name for name, _ in fields)])

    return load


def _conforming(batch: pa.RecordBatch, with_mappings: bool = False) -> tuple[list[int], list[dict[str, Any]]]:
    """The strict load: places in the batch of the records that conform, and what they hold."""
    places, rows = [], []
    for at, (problem, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        try:
            if problem is None:
                rows.append(parse_record(text, with_mappings))
                places.append(at)
        except Rejected:
            continue
    return places, rows


def _explain(carried: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Strict load, anti join by offset, diagnosis of the remainder; all within a batch, whose offsets nobody else has."""

    def diagnose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = ["record_file", "record_offset"]
            raw = pa.table({"record_offset": batch.column(2), "record_file": batch.column(3), "place": pa.array(range(batch.num_rows), pa.int64())})
            loaded = raw.select(own).take(pa.array(_conforming(batch)[0], pa.int64()))
            rest = raw.join(loaded, own, join_type="left anti", use_threads=False).sort_by("place")
            remainder = batch.take(rest.column("place").combine_chunks())
            reasons, offsets = [], []
            for problem, text in zip(remainder.column(0).to_pylist(), remainder.column(1).to_pylist()):
                try:
                    if problem is not None:
                        raise Rejected(problem, 0)
                    parse_record(text)
                except Rejected as why:
                    reasons.append(why.reason)
                    offsets.append(why.offset)
            columns = [remainder.column(2 + i) for i in range(carried)]
            names = [*batch.schema.names[2:], "reason", "reason_offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(reasons, pa.string()), pa.array(offsets, pa.int32())], names=names)

    return diagnose


def with_offsets(records: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(problem, rec_text, record_offset, record_file, record_key, *keep)`` of raw records.

    A record is told by its file and its offset there, not by its key: the byte offset where framing gave one
    (:func:`read_machine_output`), else the row's number in its Parquet file, else a number given on reading. ``problem`` is
    what framing found wrong with it, null where nothing was framed.
    """
    key_column, text_column = F.col(key), F.col(text).alias("rec_text")
    rest = [key_column.cast("bigint").alias("record_key"), *[F.col(name) for name in keep]]
    if "byte_offset" in records.columns:
        return records.select(F.col("problem"), text_column, F.col("byte_offset").alias("record_offset"), F.col("source_file").alias("record_file"), *rest)
    none = F.lit(None).cast("string").alias("problem")
    try:
        own = [F.col("_metadata.row_index").alias("record_offset"), F.col("_metadata.file_path").alias("record_file")]
        found = records.select(none, text_column, *own, *rest)
        found.schema  # noqa: B018: analysed here, where the source may turn out to have no metadata
        return found
    except AnalysisException:
        return records.select(none, text_column, F.monotonically_increasing_id().alias("record_offset"), F.lit("").alias("record_file"), *rest)


def load_records(records: DataFrame, key: str = "record_id", text: str = "rec_text", with_mappings: bool = False) -> DataFrame:
    """The conforming records as utterance rows, with ``record_key``. Narrow: one pass, no shuffle.

    ``with_mappings`` loads the same records and adds ``mappings_reason``, null where all mappings could be read.
    """
    ddl = MAPPINGS_DDL if with_mappings else UTTERANCE_DDL
    raw = with_offsets(records, key, text).select("problem", "rec_text", "record_key")
    return raw.mapInArrow(_strict(with_mappings, 1), f"record_key bigint, {ddl}")


def rejected_records(records: DataFrame, key: str = "record_id", text: str = "rec_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(record_offset, record_file, record_key, *keep, reason, reason_offset)`` of every record the strict load did not take.

    Every record has its file and offset (:func:`with_offsets`). Batch by batch the conforming records are loaded, their
    offsets are subtracted from the batch's raw offsets by an anti join, and what remains is diagnosed. As a record's
    offset lies in the batch that reads it, nothing is shuffled, no text leaves its task, and loaded and rejected
    records together are all records. The key only comes along: it may be null or repeated. A null or empty text is a
    rejected record, and so is one that framing found a fault with; records delivered twice are judged each; an empty
    table gives no rows; of the other columns those named in ``keep`` come along.
    """
    raw = with_offsets(records, key, text, keep)
    own = raw.select("record_offset", "record_file", "record_key", *keep).schema
    ddl = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in own)
    return raw.mapInArrow(_explain(3 + len(keep)), f"{ddl}, reason string, reason_offset int")


def record_id(text: Column) -> Column:
    """The cheap id test before a full parse; an empty string if the record has none."""
    return F.regexp_extract(text, r"utterance\('([^']+)',", 1)


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


def frame_records(path: str) -> Iterator[tuple[str, int, int, str, str | None]]:
    """``(file, number, byte offset, text, problem)`` of the records of a file; each ends at a line that equals ``'EOU'.``.

    Nothing is left out: lines behind the last end are an ``unfinished record`` (blank ones are none), a compressed file
    that breaks off gives what could be read with the problem ``truncated file``, and a record that is no UTF-8 comes
    with replacement characters and the problem ``encoding``.
    """
    lines: list[bytes] = []
    number = start = end = 0

    def record(problem: str | None) -> tuple[str, int, int, str, str | None]:
        data = b"".join(lines)
        try:
            return path, number, start, data.decode("utf-8"), problem
        except UnicodeDecodeError:
            return path, number, start, data.decode("utf-8", "replace"), problem or "encoding"

    try:
        for at, line in read_lines(path):
            start, end = start if lines else at, at + len(line)
            lines.append(line)
            if line.rstrip(b"\n") == END_OF_UTTERANCE.encode():
                yield record(None)
                lines, number = [], number + 1
    except Truncated:
        start = start if lines else end
        yield record("truncated file")
        return
    if b"".join(lines).strip():
        yield record("unfinished record")


class MachineOutputReader(DataSourceReader):
    """One partition per file."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_Part(path) for path in list_files(self.paths)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple[str, int, int, str, str | None]]:
        if partition is not None:  # as it is where no file matches
            yield from frame_records(partition.path)


class MachineOutputSource(DataSource):
    """``spark.read.format("metamap").load(glob)``: raw records with file, number, byte offset and what is wrong with their framing."""

    @classmethod
    def name(cls) -> str:
        return "metamap"

    def schema(self) -> str:
        return "source_file string, rec_no bigint, byte_offset bigint, rec_text string, problem string"

    def reader(self, schema: Any) -> DataSourceReader:
        return MachineOutputReader(self.options)


def read_machine_output(spark: SparkSession, paths: str) -> DataFrame:
    """Raw records of plain or gzip'd files on any file system of :mod:`spanloom.sources.files`."""
    spark.dataSource.register(MachineOutputSource)
    return spark.read.format("metamap").load(paths)
