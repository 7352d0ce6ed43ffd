import glob
import gzip
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanloom.operators.pipeline import AcronymAnnotator, Pipeline, as_documents, batches, full_pipeline
from spanloom.sources.mmo import Rejected, load_records, parse_record, read_machine_output, rejected_records
from spanloom.sources.text import document_xml, frame_documents, read_blank_line_documents, read_properties, read_relations, read_xml, write_xml
from spanloom.operators.graph import load_relations, merge_edges
from spanloom.sources.graph_store import read_graph, read_shards, write_graph
from tests.brute_mmo import conforms
from spanloom.streaming.graph import current_edges, stream_evidence

RECORD = """args('MetaMap',[]).
aas([]).
neg_list([]).
utterance('100.ab.1',"Aspirin reduces fever strongly",0/30,[]).
phrase('Aspirin',[head([])],0/7,[]).
candidates(1,0,0,1,[ev(-1000,'C0000001','Aspirin','Aspirin',[aspirin],[phsu],[[[1,1],[1,1],0]],yes,no,['MTH'],[0/7],0)]).
mappings([map(-1000,[ev(-1000,'C0000001','Aspirin','Aspirin',[aspirin],[phsu],[[[1,1],[1,1],0]],yes,no,['MTH'],[0/7],0)])]).
phrase('fever',[head([])],16/5,[]).
candidates(2,0,0,2,[ev(-1000,'C0000002','Fever','Fever',[fever],[sosy],[[[1,1],[1,1],0]],yes,no,['MTH'],[16/5],0),ev(-800,'C0000003','Fevers','Fevers',[fever],[qlco],[[[1,1],[1,1],0]],yes,no,['MTH'],[16/5],1)]).
mappings([]).
'EOU'.
"""


def test_record_parses():
    got = parse_record(RECORD, with_mappings=True)
    assert (got["pmid"], got["section"], got["num"], got["utt_id"], got["length"]) == ("100", "ab", 1, "100.ab.1", 30)
    assert [[c["cui"] for c in p["candidates"]] for p in got["phrases"]] == [["C0000001"], ["C0000002", "C0000003"]]
    assert got["phrases"][0]["mappings"] == [{"score": -1000, "cuis": ["C0000001"]}]
    assert parse_record(RECORD)["phrases"][0]["mappings"] == []
    assert parse_record(RECORD.split("\n", 3)[3])["pmid"] == "100"


@pytest.mark.parametrize(
    "old, new, reason",
    [
        ("100.ab.1", "100.ab.x", "utterance id without a number"), ("100.ab.1", "100", "utterance id without three parts"),
        ("0/30", "0-30", "utterance position"), ("[0/7],0)", "[],0)", "candidate position"), ("[0/7],0)", "[-1/7],0)", "candidate position"),
        ("[0/7],0)", "[28/7],0)", "candidate position outside the utterance"), ("'EOU'.", "", "end of the utterance"),
        ("ev(-1000", "ev(-1.5", "candidate"), ("utterance(", "utterence(", "header"), ("[phsu]", "[phsu", "candidate"),
    ],
)
def test_damage_is_named(old, new, reason):
    with pytest.raises(Rejected) as error:
        parse_record(RECORD.replace(old, new))
    assert error.value.reason == reason


def test_load_and_rejects(spark, tmp_path):
    rows = [(1, RECORD, "a"), (2, RECORD.replace("0/30", "x"), "b"), (3, None, "c"), (4, "", "d"), (5, " \n", None), (6, RECORD, "f"), (7, "x" * 100_000, "g")]
    df = spark.createDataFrame(rows, "record_id long, rec_text string, reason string")
    assert sorted(r.record_key for r in load_records(df).collect()) == [1, 6]
    got = {r.record_key: r.reason for r in rejected_records(df).collect()}
    assert got == {2: "utterance position", 3: "null record", 4: "empty record", 5: "empty record", 7: "header"}
    assert rejected_records(df.limit(0)).count() == 0 and load_records(df.limit(0)).count() == 0
    with gzip.open(tmp_path / "a.gz", "wt") as out:
        out.write(RECORD + RECORD + "unfinished\n")
    raw = read_machine_output(spark, str(tmp_path / "*.gz"))
    size = len(RECORD)
    assert [(r.rec_no, r.byte_offset, r.problem) for r in raw.orderBy("rec_no").collect()] == [(0, 0, None), (1, size, None), (2, 2 * size, "unfinished record")]
    assert load_records(raw, "rec_no").count() == 2
    assert [(r.record_offset, r.reason) for r in rejected_records(raw, "rec_no").collect()] == [(2 * size, "unfinished record")]


def test_records_are_told_by_offset_and_not_by_key(spark, tmp_path):
    bad = RECORD.replace("0/30", "x")
    rows = [(1, RECORD), (1, bad), (None, bad), (None, RECORD), (2, RECORD), (2, RECORD), (None, None), (1, bad)]
    df = spark.createDataFrame(rows, "record_id long, rec_text string")
    for frame in (df, df.coalesce(1)):
        got = rejected_records(frame).collect()
        assert sorted(((r.record_key or 0), r.reason) for r in got) == [(0, "null record"), (0, "utterance position"), (1, "utterance position"), (1, "utterance position")]
        assert load_records(frame).count() + len(got) == len(rows)
    df.coalesce(1).write.parquet(str(tmp_path / "raw"))
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "raw"))
    table = spark.read.parquet(str(tmp_path / "raw")).coalesce(1)
    got = rejected_records(spark.read.parquet(str(tmp_path / "raw"))).collect()
    assert sorted(r.record_offset for r in got) == [1, 1, 2, 2, 6, 6, 7, 7] and len({r.record_file for r in got}) == 2
    assert rejected_records(table).count() == 8  # two files in one task
    assert "Exchange" not in rejected_records(table)._jdf.queryExecution().executedPlan().toString()


def test_damaged_bytes_come_out_with_a_reason(spark, tmp_path):
    data = RECORD.encode()
    (tmp_path / "bad.txt").write_bytes(data + data.replace(b"strongly", b"strong\xffy") + data + b"\n\n")
    whole = gzip.compress(data) + gzip.compress(data * 40)
    (tmp_path / "many.gz").write_bytes(whole)
    (tmp_path / "cut.gz").write_bytes(whole[:-40])
    (tmp_path / "noise.gz").write_bytes(b"no gzip at all")
    by_file = {}
    for r in rejected_records(read_machine_output(spark, f"{tmp_path}/*"), "rec_no").collect():
        by_file.setdefault(r.record_file.rpartition("/")[2], []).append((r.record_offset, r.reason))
    assert by_file.pop("bad.txt") == [(len(data), "encoding")] and by_file.pop("noise.gz") == [(0, "truncated file")]
    assert [reason for _, reason in by_file.pop("cut.gz")] == ["truncated file"] and by_file == {}
    loaded = load_records(read_machine_output(spark, f"file://{tmp_path}/*.*"), "rec_no")
    assert loaded.count() >= 2 + 41 + 1
    assert read_machine_output(spark, f"{tmp_path}/none*").count() == 0


def test_records_with_damaged_mappings_load(spark):
    line = "mappings([map(-1000,[ev(-1000,'C0000001'"
    assert line in RECORD
    damaged = [RECORD.replace(line, line.replace(*change)) for change in (("map(", "mop("), ("map(-1000", "map(-9999999999"), ("ev(", "ev"))]
    damaged += [RECORD.replace("mappings([]).", rest) for rest in ("mappings([]). x", "mappings(", "mappings([map(")]
    texts = [RECORD, *damaged, RECORD.replace("mappings([]).", ""), RECORD.replace("mappings([]).", "mappings(\n[])."), None, RECORD.replace("0/30", "x")]
    df = spark.createDataFrame(list(enumerate(texts)), "record_id long, rec_text string")
    loaded = {r.record_key: r for r in load_records(df, with_mappings=True).collect()}
    rejected = {r.record_key for r in rejected_records(df).collect()}
    assert sorted(loaded) == sorted(r.record_key for r in load_records(df).collect()) == list(range(7))
    assert rejected == {7, 8, 9, 10}
    assert [loaded[i].mappings_reason for i in range(7)] == [None, "mappings", "mapping score", "candidate", "mappings", "mappings", "mappings"]
    assert [[p.mappings is None for p in loaded[i].phrases] for i in range(7)] == [[False, False]] + [[True, False]] * 3 + [[False, True]] * 3
    assert [tuple(m) for m in loaded[4].phrases[0].mappings] == [(-1000, ["C0000001"])]


def test_relations(spark, tmp_path):
    (tmp_path / "good.tsv").write_text("C01\tC02\ttreats\nC01\tC02\ttreats\nC01\tC03\tunknown_rel\nC01\tC02\tisa\tx\n")
    rows = read_relations(spark, str(tmp_path / "good.tsv"))
    assert rows.where("rel = 'isa\tx'").count() == 1
    edges, vertices = load_relations(rows, ["treats", "isa"])
    assert [tuple(r) for r in edges.collect()] == [("C01", "treats", "C02", ["umls"], 1)] * 2
    assert sorted((r.cui, r.semtypes) for r in vertices.collect()) == [("C01", None), ("C02", None)]
    (tmp_path / "short.tsv").write_text("C01\tC02\n")
    with pytest.raises(Exception, match="fewer than three fields"):
        read_relations(spark, str(tmp_path / "short.tsv")).collect()
    assert read_relations(spark, str(tmp_path / "short.tsv"), "DROPMALFORMED").count() == 0


@pytest.mark.parametrize("lines, texts", [("a b  c", ["a\nb", "c"]), ("a   c", ["a", "", "c"]), ("a ", ["a"])])
def test_blank_lines(lines, texts):
    assert list(frame_documents(iter(lines.split(" ")))) == texts


def test_blank_line_source(spark, tmp_path):
    (tmp_path / "d.txt").write_text("a\nb\n\nc\n")
    got = read_blank_line_documents(spark, str(tmp_path / "*.txt")).orderBy("doc_no").collect()
    assert [(r.doc_no, r.text) for r in got] == [(0, "a\nb"), (1, "c")]


def test_properties():
    assert read_properties("# c\na.b = c=d\n! x\nk: v\n\nalone") == {"a.b": "c=d", "k": "v", "alone": ""}


def test_xml(spark, tmp_path):
    schema = "_id string, text string, tokens array<struct<_begin: int, _end: int, lemma: string>>"
    df = spark.createDataFrame([("1", "a < b & c", [(0, 1, "a"), (2, 3, "<")]), ("2", "x", [(0, 1, "x")])], schema)
    write_xml(df, str(tmp_path / "x"))
    assert sorted(map(tuple, read_xml(spark, str(tmp_path / "x"), schema).collect())) == sorted(map(tuple, df.collect()))
    assert 'id="2"' in df.where("_id = '2'").select(document_xml({"_id": F.col("_id"), "text": F.col("text")})).first()[0]


def test_pipeline(spark, tmp_path):
    rows = spark.createDataFrame([("1", "DNA and IL-2 rose\nyear:x"), ("2", None), (None, "")], "k string, t string")
    got = {r.id: r for r in full_pipeline().run(as_documents(rows, "k", "t")).collect()}
    assert [m.covered_text for m in got["1"].mentions] == ["DNA", "IL-2"]
    assert got["1"].enhanced_by == ["LineTokenizer", "ChunkMerger", "AcronymAnnotator", "EntitySelector"]
    assert [(t.sent_no, t.position, t.covered_text) for t in got["1"].tokens][-3:] == [(1, 1, "year"), (1, 2, ":"), (1, 3, "x")]
    again = full_pipeline().run(full_pipeline().run(as_documents(rows, "k", "t"))).where("id = '1'").first()
    assert len(again.mentions) == 2 and len(again.enhanced_by) == 4
    path = str(tmp_path / "out")
    p = Pipeline([AcronymAnnotator()])
    p.append(as_documents(rows.where("k = '1'"), "k", "t"), path)
    assert p.append(as_documents(rows.where("k is not null"), "k", "t"), path).count() == 2
    assert batches(as_documents(rows, "k", "t"), 2).select("batch").where("batch not in (0, 1)").count() == 0
    with pytest.raises(ValueError):
        Pipeline([])


def test_graph_store(spark, tmp_path):
    v = spark.createDataFrame([("A", "phsu"), ("B", None)], "cui string, semtypes string")
    e = spark.createDataFrame([("A", "r", "B", ["u1"], 1)], "src string, rel string, dst string, utt_ids array<string>, edge_count int")
    for shard in ("s1", "s2"):
        write_graph(v, e, f"{tmp_path}/{shard}")
    with pytest.raises(Exception, match="(?i)exists"):
        write_graph(v, e, f"{tmp_path}/s1")
    write_graph(v.limit(1), e, f"{tmp_path}/s1", override=True)
    assert [d.count() for d in read_graph(spark, f"{tmp_path}/s1")] == [1, 1]
    vertices, edges = read_shards(spark, str(tmp_path))
    assert sorted((r.cui, r.shard) for r in vertices.collect()) == [("A", "s1"), ("A", "s2"), ("B", "s2")]
    assert [tuple(r) for r in merge_edges(edges).collect()] == [("A", "r", "B", 0, 2, ["u1", "u1"])]


def test_stream(spark, tmp_path):
    schema = "src string, rel string, dst string, utt_id string"
    spark.createDataFrame([("A", "r", "B", "u1"), ("A", "r", "B", "u1"), ("A", "r", "B", "u2")], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream_evidence(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
        spark.createDataFrame([("A", "r", "B", "u2"), ("A", "r", "C", "u3")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    edges = {(r.src, r.dst): (r.utt_ids, r.edge_count) for r in current_edges(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert edges == {("A", "B"): (["u1", "u2"], 2), ("A", "C"): (["u3"], 1)}


def loads(text):
    try:
        parse_record(text)
        return True
    except Rejected:
        return False


def test_loader_against_the_slow_reading():
    """Records damaged at random, and all of the test tables: the patterns and a reading character by character agree."""
    rng = random.Random(7)
    bits = list("'\"\\,()[]/.\n -0x") + ["''", '""', "\\'", "yes", "mappings", "'EOU'.", "\u2028", "\r", "ev(", "])."]
    seen = {True: 0, False: 0}
    for _ in range(4_000):
        text = RECORD
        for _ in range(rng.choice((1, 1, 2, 4))):
            at = rng.randrange(len(text))
            how = rng.randrange(3)
            text = text[:at] + (rng.choice(bits) if how else "") + text[at + (how != 1) * rng.choice((1, 1, 5)) :]
        assert loads(text) == conforms(text), text
        seen[loads(text)] += 1
    assert min(seen.values()) > 300
    for path in glob.glob("/root/testdata/sf0.0*/mmo_records.parquet"):
        for text in pq.read_table(path, columns=["rec_text"]).column(0).to_pylist():
            assert loads(text) == conforms(text)
