import itertools
import random

from pyspark.sql import functions as F

from spanloom.functions.render import show_annotation, show_chunk, show_concept, show_node, show_span
from spanloom.operators.extract import relation_evidence
from spanloom.operators.graph import upsert_edges
from spanloom.operators.relations import clean_path, collapse, path_nodes, print_path
from spanloom.streaming.graph import windowed_counts
from spanloom.operators.trees import dependency_path, depth, has_cycle, heads_of, match_template, nominal_relations, nominal_roles, number_tokens, pretty_print, print_roles, role_triples, root_paths_of, shallowest, subtree
from spanloom.plans.graph import QUERIES, SQL, event_edges
from tests.oracle import differences

TOKEN = "struct<position:int,begin:int,end:int,covered_text:string,lemma:string,pos_tag:string,dep_tag:string,depends_on:int>"


def sentence(rows, gap=1):
    tokens, at = [], 0
    for position, (word, lemma, pos, tag, head) in enumerate(rows, 1):
        tokens.append((position, at, at + len(word), word, lemma, pos, tag, head))
        at += len(word) + gap
    return tokens


ACTIVE = sentence([("Aspirin", "aspirin", "NN", "nsubj", 2), ("reduces", "reduce", "VBZ", "root", 0), ("fever", "fever", "NN", "dobj", 2)])
PASSIVE = sentence([
    ("Fever", "fever", "NN", "nsubjpass", 3), ("is", "be", "VBZ", "auxpass", 3), ("reduced", "reduce", "VBN", "root", 0),
    ("by", "by", "IN", "agent", 3), ("aspirin", "aspirin", "NN", "pobj", 4),
])


def trees(spark, *sentences):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sentences)], f"id int, tokens array<{TOKEN}>")
    return df.withColumn("heads", heads_of(F.col("tokens"))).withColumn("paths", root_paths_of(F.col("heads")))


def label(spark, tokens, first, second):
    df = trees(spark, tokens)
    path = dependency_path(F.col("paths"), F.lit(first[0]), F.lit(second[0]), F.array(*map(F.lit, first)), F.array(*map(F.lit, second)))
    df = df.withColumn("path", path).withColumn("nodes", path_nodes(F.col("tokens"), F.col("paths"), F.col("path")))
    df = df.withColumn("done", clean_path(F.col("nodes")))
    return df.select("path", print_path(F.col("done"), F.col("tokens"))).first()


def test_depth_and_cycles(spark):
    rows = [[("a", "a", "NN", "x", h) for h in heads] for heads in ([2, 0, 2, 3], [2, 1, 0], [9, 0])]
    got = trees(spark, *map(sentence, rows)).select(F.transform("paths", depth).alias("d"), has_cycle(F.col("heads"), F.col("paths")).alias("c")).collect()
    assert got[0].d == [1, 0, 1, 2] and not got[0].c
    assert got[1].c and got[1].d[2] == 0
    assert got[2].d == [0, 0] and not got[2].c


def test_empty_sentence(spark):
    df = spark.createDataFrame([(1, [])], f"id int, tokens array<{TOKEN}>").withColumn("heads", heads_of(F.col("tokens")))
    assert df.select(F.size("heads")).first()[0] == 0


def test_subtree_and_print(spark):
    row = trees(spark, PASSIVE).select(subtree(F.col("paths"), F.lit(4)), pretty_print(F.col("tokens"), F.col("paths"))).first()
    assert row[0] == [4, 5]
    assert row[1].split("\n")[4] == "\t\t\t\t4:pobj:aspirin:5"


def test_labels(spark):
    assert label(spark, ACTIVE, [1], [3]) == ([1, 2, 3], "nsubj -> reduce:VB <- dobj")
    assert label(spark, PASSIVE, [1], [5]) == ([1, 3, 4, 5], "dobj -> reduce:VB <- nsubj")


def test_label_needs_verb_and_connection(spark):
    nouns = sentence([("a", "a", "NN", "nn", 2), ("b", "b", "NN", "root", 0), ("c", "c", "NN", "root", 0)])
    assert label(spark, nouns, [1], [2])[1] is None
    assert label(spark, nouns, [1], [3]) == (None, None)


def test_modifiers_in_label(spark):
    tokens = sentence([
        ("Drug", "drug", "NN", "nsubj", 2), ("lowers", "lower", "VBZ", "root", 0), ("high", "high", "JJ", "amod", 4), ("level", "level", "NN", "dobj", 2),
        ("of", "of", "IN", "prep", 4), ("sugar", "sugar", "NN", "pobj", 5),
    ])
    assert label(spark, tokens, [1], [6])[1] == "nsubj -> lower:VB <- level:dobj(high) <- of <- pobj"


def test_conjunction_collapses(spark):
    tokens = sentence([
        ("A", "a", "NN", "nsubj", 2), ("treats", "treat", "VBZ", "root", 0), ("x", "x", "NN", "dobj", 2), ("and", "and", "CC", "cc", 3), ("y", "y", "NN", "conj", 3),
    ])
    df = trees(spark, tokens)
    nodes = path_nodes(F.col("tokens"), F.col("paths"), F.array(*map(F.lit, [1, 2, 3, 5])))
    got = df.select(collapse(nodes, "conj").alias("n")).first().n
    assert [(n.position, n.tag, n.head) for n in got] == [(1, "nsubj", 2), (2, "root", 0), (5, "dobj", 2)]
    assert label(spark, tokens, [1], [5])[1] == "nsubj -> treat:VB <- dobj"


def test_shallowest(spark):
    assert trees(spark, ACTIVE).select(shallowest(F.array(F.lit(3), F.lit(1)), F.col("paths"))).first()[0] == 1


def test_nominal_relations(spark):
    for preposition, expected in (("of", (3, 1, "A1")), ("for", (2, 1, "AM"))):
        rows = [(1, 1, 4, "nsubj", "treatment"), (1, 2, 1, "prep", preposition), (1, 3, 2, "pobj", "pain"), (1, 4, 0, "root", "help")]
        edges = spark.createDataFrame(rows, "s int, position int, head int, dep_tag string, lemma string")
        got = nominal_relations(edges, ["s"]).collect()
        assert [tuple(r)[1:] for r in got] == [expected]
    assert match_template(edges, ["s"], [("prep", "for"), ("pobj", ".*")]).count() == 1


def brute_roles(tokens):
    tags = {"subject": {"nsubj", "dobj", "pobj"}, "prep": {"prep"}, "object": {"pobj", "conj"}}
    by, found = {t[0]: t for t in tokens}, []
    for x, n, p, o in itertools.product(tokens, repeat=4):
        if n[7] == x[0] and p[7] == n[0] and o[7] == p[0] and n[6] in tags["subject"] and p[6] in tags["prep"] and o[6] in tags["object"]:
            found.append((o[0], n[0], "A1") if by[p[0]][4] == "of" else (p[0], n[0], "AM"))
    return sorted(found)


def test_nominal_roles_match_upwards(spark):
    rng = random.Random(5)
    words, tags = ["of", "of", "for", "a\nb", None], ["nsubj", "dobj", "prep", "prep", "pobj", "conj", "xobject", None]
    sentences = [[(i, 0, 0, "", rng.choice(words), "NN", rng.choice(tags), rng.choice([None, -1, *range(n + 2)])) for i in range(1, n + 1)] for n in (0, 1, 2, 4, 8, 12) for _ in range(40)]
    df = trees(spark, *sentences)
    roles = nominal_roles(F.col("tokens"), object_="pobj|conj")
    got = {r.id: sorted(map(tuple, r.roles)) for r in df.select("id", roles.alias("roles")).collect()}
    edges = df.select("id", F.explode("tokens").alias("t")).select("id", "t.position", F.col("t.depends_on").alias("head"), "t.dep_tag", "t.lemma")
    joined = {i: [] for i in got}
    for r in nominal_relations(edges, ["id"], object_="pobj|conj").collect():
        joined[r.id].append(tuple(r)[1:])
    want = dict(enumerate(map(brute_roles, sentences)))
    assert {label for found in want.values() for _, _, label in found} == {"A1", "AM"}
    assert got == want and {i: sorted(found) for i, found in joined.items()} == want


def test_nominal_relations_broadcast_nothing(spark, tmp_path):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = [(("click", None, "view")[i % 3], user, i) for user in (0, 1, None) for i in range(200)]
    events = spark.createDataFrame(rows, "event_type string, user_id long, event_id long").withColumn("ts", F.timestamp_seconds("event_id"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["nominal_relations"](spark, str(tmp_path))
    assert found.count() > 0 and differences(spark, str(tmp_path), "nominal_relations", QUERIES["nominal_relations"], SQL["nominal_relations"]) == ""
    assert "Join" not in plan(found)
    assert "Broadcast" not in plan(nominal_relations(event_edges(spark, str(tmp_path)), ["user_id"]))


def test_roles_printed(spark):
    tokens = sentence([("treatment", "treatment", "NN", "nsubj", 4), ("of", "of", "IN", "prep", 1), ("pain", "pain", "NN", "pobj", 2), ("helps", "help", "VBZ", "root", 0)])
    roles = F.array(F.struct(F.lit(3).alias("position"), F.lit(1).alias("head"), F.lit("A1").alias("label")))
    assert trees(spark, tokens).select(print_roles(F.col("tokens"), F.col("paths"), roles)).first()[0] == "A1(treatment,pain)"
    assert tuple(trees(spark, tokens).select(role_triples(F.col("tokens"), F.col("paths"), roles)).first()[0][0]) == ("A1", "treatment", 1, "pain", 3)


def test_rendering(spark):
    span = F.struct(F.lit(2).alias("begin"), F.lit(5).alias("end"))
    concept = F.struct(F.lit("C1").alias("concept_id"), F.lit("Fever").alias("preferred_label"), F.lit("UMLS").alias("source"))
    shown = [show_span(span), show_annotation("Token", F.lit("x")), show_chunk(F.lit("NP"), F.lit("x y")), show_concept(concept), show_node(F.col("tokens"))]
    got = trees(spark, ACTIVE).select(*[c.alias(f"c{i}") for i, c in enumerate(shown)]).first()
    assert tuple(got) == ("[2,5)", "Token[x]", "Chunk_NP[x y]", "C1-Fever[UMLS]", "DepNode[Aspirin reduces fever]")


def test_extraction(spark):
    concept = "array<struct<source:string,concept_id:string,preferred_label:string,synonyms:array<string>,semtypes:array<string>,score:double>>"
    mention = lambda u, b, e, *cuis: (u, b, e, [("UMLS", c, "", [], ["phsu", "qlco"], -1000.0) for c in cuis])
    mentions = spark.createDataFrame(
        [mention("u1", 0, 7, "C1", "C2"), mention("u1", 16, 21, "C3"), mention("u2", 0, 5, "C3"), mention("u2", 20, 27, "C1")],
        f"utt_id string, begin int, end int, concepts {concept}",
    )
    sentences = spark.createDataFrame([("u1", 0, ACTIVE), ("u2", 0, PASSIVE)], f"utt_id string, sent_no int, tokens array<{TOKEN}>")
    evidence = relation_evidence(mentions, sentences, "utt_id")
    edges = {(r.src, r.rel, r.dst): (r.utt_ids, r.edge_count) for r in upsert_edges(evidence).collect()}
    assert edges == {
        ("C1", "nsubj -> reduce:VB <- dobj", "C3"): (["u1"], 1),
        ("C2", "nsubj -> reduce:VB <- dobj", "C3"): (["u1"], 1),
        ("C3", "dobj -> reduce:VB <- nsubj", "C1"): (["u2"], 1),
    }
    assert {r.src_semtypes for r in evidence.collect()} == {"phsu"}


def test_chains_of_any_depth(spark):
    df = spark.createDataFrame([(1, list(range(700))), (2, list(range(256))), (3, [0]), (4, []), (5, None), (6, [300, *range(1, 300)]), (7, [0, 1, 4, 3])], "id int, heads array<int>")
    df = df.withColumn("paths", root_paths_of(F.col("heads")))
    got = {r.id: r for r in df.select("id", "paths", has_cycle(F.col("heads"), F.col("paths")).alias("cycle")).collect()}
    assert got[1].paths == [list(range(i, 0, -1)) for i in range(1, 701)] and not got[1].cycle
    assert got[2].paths[-1] == list(range(256, 0, -1)) and not got[2].cycle
    assert (got[3].paths, got[4].paths, got[5].paths) == ([[1]], [], None)
    assert got[6].cycle and {len(path) for path in got[6].paths} == {300}
    assert got[7].cycle and got[7].paths == [[1], [2, 1], [3, 4], [4, 3]]


def test_numbered_tokens_and_windows(spark):
    tokens = spark.createDataFrame([("d", 0, 5, "b"), ("d", 0, 1, "a"), ("d", 1, 9, "c")], "doc string, sent int, begin int, word string")
    assert sorted((r.sent, r.position, r.word) for r in number_tokens(tokens, ["doc", "sent"], ["begin"]).collect()) == [(0, 1, "a"), (0, 2, "b"), (1, 1, "c")]
    rows = spark.sql("select timestamp'2020-01-01 00:00:30' as t, 'a' as src, 'r' as rel, 'b' as dst union all select timestamp'2020-01-01 00:00:50', 'a', 'r', 'b' union all select timestamp'2020-01-01 00:01:10', 'a', 'r', 'b'")
    assert sorted((r.window.start.minute, r.n) for r in windowed_counts(rows, "t", "1 minute", "5 minutes").collect()) == [(0, 2), (1, 1)]
