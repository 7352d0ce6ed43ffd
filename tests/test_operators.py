from pyspark.sql import functions as F

from spanloom.functions.spans import all_within, between, contains, covered_text, in_order, relocate, resolve_overlaps
from spanloom.operators import annotations as A
from spanloom.operators import candidates as C
from spanloom.operators import graph as G

PHRASES = "array<struct<start_pos:int,length:int,candidates:array<struct<score:int,cui:string,semtypes:array<string>,positions:array<struct<start_pos:int,length:int>>>>>>"
UTTERANCE = f"row_id long, text string, start_pos int, length int, phrases {PHRASES}"


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def spans(*pairs, names=("begin", "size")):
    return F.array(*[F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1])) for a, b in pairs])


def test_overlap_resolution(spark):
    kept = lambda *p: [tuple(s) for s in one(spark, resolve_overlaps(spans(*p)))]
    assert kept((0, 5), (5, 9), (20, 2)) == [(5, 9), (20, 2)]
    assert kept((0, 5), (6, 2)) == [(0, 5), (6, 2)]
    assert kept((0, 5), (3, 5)) == [(0, 5)]
    assert kept((3, 5), (0, 5)) == [(0, 5)]


def test_span_predicates(spark):
    s = spans((0, 3), (5, 8), names=("begin", "end"))
    assert one(spark, contains(s, F.lit(5), F.lit(7))) and not one(spark, contains(s, F.lit(2), F.lit(6)))
    assert one(spark, all_within(s, F.lit(0), F.lit(8))) and not one(spark, all_within(s, F.lit(1), F.lit(8)))
    assert one(spark, between(F.lit(2), F.lit(4), F.lit(2), F.lit(4)))
    assert one(spark, in_order(s)) and not one(spark, in_order(spans((0, 6), (5, 8), names=("begin", "end"))))
    assert one(spark, covered_text(F.lit("abcdefgh"), s)) == "abc fgh"


def test_relocation(spark):
    assert one(spark, relocate(F.lit("a b a b"), F.array(*map(F.lit, ["a", "b", "a", "x", "a"])))) == [0, 2, 4, -1, 0]


def test_sections_and_tokens(spark):
    df = spark.createDataFrame([(1, "ab\n\ncd\ref"), (2, None), (3, ""), (4, "x  y")], "doc_id int, text string")
    assert [tuple(r) for r in A.sections(df).where("doc_id = 1").collect()] == [(1, 0, 0, 2), (1, 1, 4, 6), (1, 2, 7, 9)]
    assert [tuple(r) for r in A.tokens(df).where("doc_id = 4").collect()] == [(4, 0, 1, 0, 1, "x"), (4, 0, 2, 3, 4, "y")]
    assert A.tokens(df).where("doc_id in (2, 3)").count() == 0


def test_acronyms(spark):
    words = ["DNA", "A", "thth", "year", "IL-2"]
    df = spark.createDataFrame([(1, i, i + 1, w, "NN") for i, w in enumerate(words)] + [(1, 9, 10, "RNA", "VB")], "doc_id int, begin int, end int, covered_text string, pos_tag string")
    got = A.acronym_mentions(df, pos_tag="pos_tag")
    assert sorted(r.concept_id for r in got.collect()) == ["DNA", "IL-2", "THTH"]
    mention = spark.createDataFrame([(1, 0, 5)], "doc_id int, begin int, end int")
    assert A.acronym_mentions(df, mention, pos_tag="pos_tag").count() == 0


def test_tokens_of_with_fallback(spark):
    tokens = spark.createDataFrame([(1, 0, 5), (1, 6, 9)], "doc_id int, begin int, end int")
    mentions = spark.createDataFrame([(1, "in", 0, 9), (1, "part", 2, 4), (1, "across", 4, 7)], "doc_id int, m string, begin int, end int")
    got = sorted(tuple(r)[1:] for r in A.tokens_of(mentions, tokens, ["doc_id"], "m").collect())
    assert got == [("in", 0, 5), ("in", 6, 9), ("part", 0, 5)]


def test_chunks_and_containment(spark):
    chunks = spark.createDataFrame([(1, 0, 3, "NP"), (1, 5, 8, "NP"), (1, 9, 12, "VP"), (1, 13, 15, "NP")], "s int, begin int, end int, chunk_type string")
    assert sorted((r.begin, r.end, r.chunk_type) for r in A.merge_chunks(chunks, ["s"]).collect()) == [(0, 8, "NP"), (9, 12, "VP"), (13, 15, "NP")]
    m = spark.createDataFrame([(1, 0, 10, 1), (1, 2, 5, 2), (1, 8, 14, 3), (1, 0, 10, 4)], "d int, begin int, end int, seq int")
    assert sorted(r.seq for r in A.suppress_contained(m, "d", "seq").collect()) == [1, 3]


def test_duplicates_merge_and_selection(spark):
    t = spark.createDataFrame([(1, "Token", 0, 1), (2, "Token", 2, 3), (3, "Token", 0, 1)], "seq int, kind string, begin int, end int")
    assert sorted(r.seq for r in A.drop_duplicates(t, ["kind", "begin", "end"], "seq").collect()) == [2, 3]
    m = spark.createDataFrame([(1, 0, 5, ["a"]), (2, 0, 5, ["b"]), (3, 6, 7, ["a"])], "seq int, begin int, end int, concepts array<string>")
    assert sorted((r.begin, r.concepts) for r in A.merge_mentions(m, ["begin", "end"], "seq").collect()) == [(0, ["a", "b"]), (6, ["a"])]
    c = spark.createDataFrame([(1, [("UMLS", 0.1), ("UMLS", 0.5)]), (2, [("GO", 0.1)])], "id int, concepts array<struct<source:string,score:double>>")
    assert [(r.id, len(r.concepts)) for r in A.select_concepts(c, 0.1).collect()] == [(1, 1)]
    assert sorted((r.id, len(r.concepts)) for r in A.select_concepts(c, 0.1, "UMLS").collect()) == [(1, 1), (2, 1)]


def test_candidate_selection(spark):
    cand = lambda score, cui, *pos: (score, cui, ["phsu"], list(pos))
    rows = [
        (1, "Aspirin is a drug for strong fever", 100, 30, [
            (100, 7, [cand(-1000, "A", (100, 7)), cand(-1000, "B", (100, 7)), cand(-800, "C", (100, 7))]), (100, 7, [cand(-900, "D", (100, 7))]), (125, 5, [cand(-900, "E", (125, 5))]),
            (110, 4, [cand(-900, "F", (110, 4))]),
        ]),
        (2, None, 0, 0, None), (3, "", 0, 0, []),
    ]
    got = {(r.row_id, r.begin, r.end): [c.cui for c in r.candidates] for r in C.select_spans(spark.createDataFrame(rows, UTTERANCE)).collect()}
    assert got == {(1, 0, 7): ["D"], (1, 10, 14): ["F"]}


def test_allowed(spark):
    cases = [("gngm", "Insulin", False), ("gngm", "BRCA1", True), ("gngm", "II", False), ("phsu", "levels of x", False), ("phsu", "a", False), ("phsu", "aspirin", True), ("qlco", "good", False), (None, "x", False)]
    df = spark.createDataFrame([([s] if s else None, t) for s, t, _ in cases], "s array<string>, t string")
    assert [r[0] for r in df.select(C.allowed(F.col("s"), F.col("t"))).collect()] == [ok for _, _, ok in cases]


def test_mentions_relocated(spark):
    cand = lambda cui, *pos: (-1000, cui, ["phsu"], list(pos))
    rows = [(1, 'ab ab ""cd"" x', 0, 14, [(0, 2, [cand("A", (0, 2))]), (3, 2, [cand("B", (3, 2))])])]
    got = C.mentions(spark.createDataFrame(rows, UTTERANCE))
    assert [(r.begin, r.end, r.covered_text, r.concepts[0].concept_id) for r in got.orderBy("begin").collect()] == [(0, 2, "ab", "A"), (3, 5, "ab", "B")]
    pairs = C.mention_pairs(got, "row_id", "begin", ("concepts",))
    assert [(r.concept_1.concept_id, r.concept_2.concept_id) for r in C.concept_pairs(pairs).collect()] == [("A", "B")]


def test_pairs_need_different_begins(spark):
    m = spark.createDataFrame([(1, 0), (1, 5), (1, 5)], "d int, begin int")
    assert [(r.begin_1, r.begin_2) for r in C.mention_pairs(m, "d").collect()] == [(0, 5), (0, 5)]


def test_graph(spark):
    ev = spark.createDataFrame([("A", "r", "B", "u1"), ("A", "r", "B", "u1"), ("A", "r", "B", "u2")], "src string, rel string, dst string, utt_id string")
    assert [(r.utt_ids, r.edge_count) for r in G.upsert_edges(ev).collect()] == [(["u1", "u2"], 2)]
    shards = spark.createDataFrame([("A", "r", "B", ["u1", "u2"], 2), ("A", "r", "B", ["u2"], 1), ("A", "r", "A", ["u9"], 1), ("A", "s", "B", None, None)], "src string, rel string, dst string, utt_ids array<string>, edge_count int")
    assert sorted((r.rel, r.edge_count, r.utt_ids) for r in G.merge_edges(shards).collect()) == [("r", 3, ["u1", "u2", "u2"]), ("s", 0, [])]
    v = spark.createDataFrame([("A", "phsu", 1), ("A", "aapp", 2), ("B", None, 1), ("B", "x", 2)], "cui string, semtypes string, n int")
    assert sorted((r.cui, str(r.semtypes)) for r in G.first_vertices(v, ["n"]).collect()) == [("A", "phsu"), ("B", "None")]
    assert one(spark, G.vertex_semtypes(F.array(F.lit("qlco"), F.lit("phsu"), F.lit("aapp")))) == "aapp,phsu"
    assert sorted(r[0] for r in G.processed_ids(shards).collect()) == ["u1", "u2", "u9"]
    assert [r.utt_id for r in G.unprocessed(ev.select("utt_id").distinct(), spark.createDataFrame([("u1",)], "x string")).collect()] == ["u2"]
    assert G.out_edges(shards, "A", "r").count() == 3 and G.out_edges(shards, "A").count() == 4 and G.vertex(v, "B").count() == 1
    assert [r.edge_count for r in G.edge_counts(ev).collect()] == [2]


def test_violations(spark):
    rows = [(1, [(0, 3)], "ab"), (2, [], "x"), (3, [(5, 8), (0, 2)], "y"), (4, [(0, 1), (2, 3)], "z"), (5, [(0, 3)], "a b")]
    df = spark.createDataFrame(rows, "id int, spans array<struct<begin:int,end:int>>, w string")
    got = {r.id: r.reason for r in A.violations(df, single=True, word="w").collect()}
    assert got == {2: "no spans", 3: "spans out of order", 4: "more than one span", 5: "blank in token"}


def test_hub_edges_are_parted(spark):
    """An edge with a third of all evidence: no row holds more than about the bound, the parts together hold all ids once."""
    ev = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("src"), F.lit("r").alias("rel"), F.lit("x").alias("dst"), F.col("id").cast("string").alias("utt_id"))
    ev = ev.unionByName(ev.limit(500))
    rows = G.upsert_edges(ev, most_ids=100).collect()
    hub = [r for r in rows if r.src == "hub"]
    assert len(hub) == 10 and {r.part for r in hub} == set(range(10)) and all(r.edge_count == 1_000 and len(r.utt_ids) < 150 for r in hub)
    assert sorted(i for r in hub for i in r.utt_ids) == sorted(str(i) for i in range(0, 3_000, 3)) and all(r.part == 0 for r in rows if r.src != "hub")
    edges = G.upsert_edges(ev, most_ids=100)
    merged = [r for r in G.merge_edges(edges.unionByName(edges), most_ids=100).collect() if r.src == "hub"]
    assert len(merged) == 20 and all(r.edge_count == 2_000 for r in merged) and sorted(i for r in merged for i in r.utt_ids) == sorted(2 * [str(i) for i in range(0, 3_000, 3)])


def test_whitelist(spark, tmp_path):
    (tmp_path / "w.txt").write_text("treats\n\n isa \ntreats\n")
    assert sorted(r.rel for r in G.whitelist(spark, str(tmp_path / "w.txt")).collect()) == ["isa", "treats"]
