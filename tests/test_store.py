import pytest
from pyspark.sql import functions as F

from spanloom.operators import pipeline
from spanloom.operators.pipeline import NO_ID, ModelAnnotator, Pipeline, as_documents, batches, counted, full_pipeline
from spanloom.operators.store import as_annotations, by_layer, insert, lineage, listings, listings_between, of_type, remove_all, remove_type, sentences_of_sections
from spanloom.operators.trees import Template, find, match_tree, node_of, zip_nodes
from spanloom.sources.annotation_xml import documents_xml, read_documents_xml, write_document_files, written_ids

PARENTS = {"Mention": "Entity", "Entity": "Thing"}


@pytest.fixture
def store(spark):
    spans = F.array(F.struct(F.col("b").alias("begin"), F.col("e").alias("end")))
    tokens = spark.createDataFrame([("d", 1, 0, 2, "x"), ("d", 2, 3, 5, None), ("e", 1, 0, 1, "y")], "doc string, n int, b int, e int, lemma string")
    mentions = spark.createDataFrame([("d", 1, 0, 5)], "doc string, n int, b int, e int")
    return insert(as_annotations(tokens, "Token", "doc", spans, "n", ("lemma",)), as_annotations(mentions, "Mention", "doc", spans, "n", (), PARENTS))


def test_types_and_supertypes(store):
    assert lineage("Mention", PARENTS) == ["Mention", "Entity", "Thing"]
    with pytest.raises(ValueError):
        lineage("a", {"a": "b", "b": "a"})
    count = lambda df, t: of_type(df, t).count()
    assert [count(store, t) for t in ("Token", "Mention", "Entity", "Thing", "None")] == [3, 1, 1, 1, 0]
    assert listings(store).count() == 6 and listings_between(store, 0, 2).count() == 2
    assert listings_between(store, 0, 5).where("listed_as = 'Thing'").count() == 1
    less = remove_type(store, "Entity")
    assert [count(less, t) for t in ("Token", "Mention", "Entity", "Thing")] == [3, 1, 0, 1]
    assert remove_type(remove_type(remove_type(store, "Mention"), "Entity"), "Thing").count() == 3 and remove_all(store).count() == 0
    assert insert(store, store).count() == 8
    rows = {r.doc_id: r for r in by_layer(store, ["Token", "Entity"]).collect()}
    assert [len(rows[d][c]) for d in "de" for c in ("Tokens", "Entitys")] == [2, 1, 1, 0] and rows["d"].Tokens[0].fields == {"lemma": "x"}


def test_xml_round_trip(spark, store, tmp_path):
    docs = spark.createDataFrame([("d", "ab <&\" cd", ["A", "B"]), ("e", " z\n", []), ("f", None, None)], "id string, text string, enhanced_by array<string>")
    xml = documents_xml(docs, store, ["Token", "Mention"], "m.")
    (first,) = [r.xml for r in xml.where("id = 'd'").collect()]
    assert '<Tokens class="m.Token">' in first and 'coveredText="ab"' in first and 'begin="3"' in first and 'id="d"' in first
    back, again = read_documents_xml(xml, ["Token", "Mention"], parents=PARENTS)
    assert sorted((r.id, r.text, tuple(r.enhanced_by)) for r in back.collect() if r.text) == [("d", "ab <&\" cd", ("A", "B")), ("e", " z\n", ())]
    flat = lambda df: sorted((r.doc_id, r.ann_type, tuple(r.listed_under), tuple(map(tuple, r.spans)), tuple(r.fields.items())) for r in df.collect())
    assert flat(again) == flat(store)
    folder = f"file://{tmp_path}/out"
    assert write_document_files(xml.unionByName(spark.createDataFrame([("../g h", "<x/>"), (None, "<y/>")], "id string, xml string")), folder) == 4
    assert sorted(r.id for r in written_ids(spark, folder).collect()) == ["../g h", "d", "e", "f"] and (tmp_path / "out" / "d.xml").read_text() == first


def test_sections_hold_sentences(spark):
    sections = spark.createDataFrame([("d", 0, 0, 10), ("d", 1, 10, 20), ("e", 0, 0, 3)], "doc_id string, sec_no int, begin int, end int")
    sentences = spark.createDataFrame([("d", 0, 0, 4), ("d", 1, 5, 10), ("d", 2, 8, 12), ("d", 3, 12, 20)], "doc_id string, sent_no int, begin int, end int")
    assert sorted((r.sec_no, r.sent_no) for r in sentences_of_sections(sections, sentences).collect()) == [(0, 0), (0, 1), (1, 3)]


def test_nodes(spark):
    df = spark.createDataFrame([([(2, "b", "VB"), (1, "a", "NN"), (3, None, "NN")], ["x", "y"])], "tokens array<struct<position:int,lemma:string,pos_tag:string>>, words array<string>")
    r = df.select(
        node_of(F.col("tokens"), 2)["lemma"].alias("two"), node_of(F.col("tokens"), 9).alias("none"), find(F.col("tokens"), lambda t: t["pos_tag"] == "NN")["position"].alias("noun"),
        find(F.col("tokens"), lambda t: t["lemma"] == "b")["position"].alias("b"), zip_nodes(F.col("words"), F.col("tokens")).alias("z"),
    ).first()
    assert (r.two, r.none, r.noun, r.b) == ("b", None, 1, 2) and [(z.word, z.node.position) for z in r.z] == [("x", 2), ("y", 1)]


def test_branching_templates(spark):
    rows = [(1, 1, 0, "root", "give"), (1, 2, 1, "nsubj", "she"), (1, 3, 1, "dobj", "pill"), (1, 4, 1, "dobj", "dose"), (1, 5, 3, "amod", "red"), (2, 1, 0, "root", "give"), (2, 2, 1, "nsubj", "he")]
    edges = spark.createDataFrame(rows, "k int, position int, head int, dep_tag string, lemma string")
    both = match_tree(edges, ["k"], Template("give", (("nsubj", Template()), ("dobj", Template()))))
    assert sorted(tuple(r) for r in both.collect()) == [(1, 1, 2, 3), (1, 1, 2, 4)]
    deep = match_tree(edges, ["k"], Template("give", (("dobj", Template("pill", (("amod", Template("r.*")),))), ("nsubj", Template()))))
    assert [tuple(r) for r in deep.collect()] == [(1, 1, 3, 5, 2)]
    assert match_tree(edges, ["k"], Template("give")).count() == 2 and match_tree(edges, ["k"], Template("x")).count() == 0


def test_batches_are_runs_in_order(spark):
    docs = spark.range(103).select(F.format_string("%05d", F.col("id")).alias("id")).repartition(7)
    rows = sorted((r.id, r.batch) for r in batches(docs, 10).collect())
    assert [b for _, b in rows] == [i // 10 for i in range(103)] and batches(docs.limit(0), 10).count() == 0


def test_counters(spark):
    rows, seen = counted(spark.range(10), "progress", even=F.sum((F.col("id") % 2 == 0).cast("int")))
    assert rows.where("id > 3").count() == 6 and seen.get == {"rows": 10, "even": 5}


def test_model_files(spark, tmp_path):
    (tmp_path / "model.txt").write_text("!")
    docs = as_documents(spark.createDataFrame([("1", "a"), ("2", None)], "k string, t string"), "k", "t")

    def load(data: bytes):
        return lambda frame: frame.assign(text=frame["text"].where(frame["text"].isna(), frame["text"] + data.decode()))

    out = Pipeline([ModelAnnotator(f"file://{tmp_path}/model.txt", load, "bang")]).run(docs)
    assert sorted((r.id, r.text, r.enhanced_by) for r in out.collect()) == [("1", "a!", ["bang"]), ("2", None, ["bang"])]


@pytest.mark.parametrize("most", [pipeline.MOST_DONE, 0])
def test_append_keeps_documents_without_an_id(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(pipeline, "MOST_DONE", most)
    docs = as_documents(spark.createDataFrame([(None, "One DNA."), (None, "Two."), (None, None), ("7", "x")], "k string, t string"), "k", "t")
    path = f"file://{tmp_path}/out"
    full_pipeline().append(docs.where("text = 'One DNA.'"), path)
    assert full_pipeline().append(docs, path).count() == 4 and full_pipeline().append(docs, path).count() == 4
    assert {r.text for r in spark.read.parquet(path).where(F.col("id") == NO_ID).collect()} == {"One DNA.", "Two.", None}
