"""Queries over the graph, tree and relation operators, with their SQL.

Trees for the queries are made of each user's events: the event in place ``p`` hangs on the one in place ``p div 2``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import render as R
from spanloom.functions.let import let
from spanloom.functions.packed import packed_items
from spanloom.operators import graph as G
from spanloom.operators import trees as T
from spanloom.operators.candidates import concept_pairs
from spanloom.operators.extract import relation_evidence
from spanloom.operators.candidates import mentions as placed_mentions
from spanloom.operators.relations import clean_path, collapse, path_nodes, passive_to_active, print_path, resolve_agent
from spanloom.plans.annotation import span_pairs
from spanloom.session import shared_path, spread, stored, table
from spanloom.sources.graph_store import read_shards, write_graph
from spanloom.sources.text import read_xml, split_relations, write_xml
from spanloom.streaming.graph import current_edges, stream_evidence

#: The vertex looked up by the point queries.
SOME_CUI = "C0017873"
#: What the extraction query takes for a verb.
VERB_LIKE = "^(?:[a-z]+(?:ed|es|ts|ds|rs|ise|bind)|was|were|cause)$"
SOME_RELATIONS = ["diagnoses", "treats", "isa", "causes", "part_of", "location_of"]


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All concepts of neighbouring mentions as evidence, the semantic types of the first as relation. Narrow."""
    pairs = span_pairs(spark, sf_dir).where("utt_id is not null").select("utt_id", F.col("p.one.candidates").alias("ones"), F.col("p.two.candidates").alias("twos"))
    both = concept_pairs(pairs, "ones", "twos")
    kind = F.coalesce(F.array_join("concept_1.semtypes", ","), F.lit("none"))
    rows = both.select(F.col("concept_1.cui").alias("src"), kind.alias("rel"), F.col("concept_2.cui").alias("dst"), "utt_id")
    return rows.where("src is not null and dst is not null")


def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.upsert_edges(evidence(spark, sf_dir))
    return edges.withColumn("utt_ids", F.array_join("utt_ids", ",")).drop("part")


def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edge_counts(evidence(spark, sf_dir))


def edge_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges by way of a stream of evidence."""
    source, out, state = (shared_path(spark, name) for name in ("stream-in", "evidence", "stream-state"))
    rows = evidence(spark, sf_dir)
    rows.write.parquet(source)
    stream_evidence(spark.readStream.schema(rows.schema).parquet(source), out, state).awaitTermination()
    return current_edges(spark.read.parquet(out)).where("part = 0").drop("utt_ids", "part")


def vertex_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_vertices(table(spark, sf_dir, "vertices"), ["updated_at", "vertex_id"])


def semtype_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vertices")
    return v.select("vertex_id", G.vertex_semtypes(packed_items(F.col("semtypes"))).alias("semtypes"))


def relation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "edges").select(F.concat_ws("\t", "src", "dst", "rel").alias("line"))
    return split_relations(lines, "line", "DROPMALFORMED")


def listed_relations(spark: SparkSession) -> DataFrame:
    """The names of a whitelist file; a user's own is a parameter of ``G.whitelist``."""
    path = shared_path(spark, "whitelist")
    spark.createDataFrame([(r,) for r in SOME_RELATIONS], "rel string").write.text(path)
    return G.whitelist(spark, path)


def whitelist_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, _ = G.load_relations(relation_lines(spark, sf_dir), listed_relations(spark))
    return edges.select("src", "rel", "dst", F.array_join("utt_ids", ",").alias("utt_ids"), "edge_count")


def whitelist_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.load_relations(relation_lines(spark, sf_dir), listed_relations(spark))[1].select("cui")


def unpacked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "edges")
    return e.withColumn("utt_ids", F.coalesce(packed_items(F.col("utt_ids")), F.array().cast("array<string>")))


def merge_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = G.merge_edges(unpacked_edges(spark, sf_dir))
    return merged.withColumn("utt_ids", F.array_join("utt_ids", ",")).drop("part")


def processed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.processed_ids(unpacked_edges(spark, sf_dir))


def unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "utterances").where("utt_id is not null").select("row_id", "utt_id")
    return G.unprocessed(u, processed_ids(spark, sf_dir))


def vertex_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.vertex(vertex_first_wins(spark, sf_dir), SOME_CUI)


def out_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.out_edges(table(spark, sf_dir, "edges"), SOME_CUI).select("rel", "dst", "edge_id")


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the token array."""
    e = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = e.select("user_id", "event_type", place.alias("position"))
    tag = F.expr("element_at(array('nsubj', 'dobj', 'prep', 'pobj', 'nsubjpass', 'conj', 'amod', 'agent', 'punct', 'appos'), position % 10 + 1)")
    pos = F.expr("element_at(array('NN', 'VBZ', 'IN', 'NNS', 'JJ', 'VBD', 'NNP'), position % 7 + 1)")
    token = F.struct(
        "position", F.lit(0).alias("begin"), F.lit(0).alias("end"), F.col("event_type").alias("covered_text"), F.col("event_type").alias("lemma"),
        pos.alias("pos_tag"), tag.alias("dep_tag"), F.expr("cast(position div 2 as int)").alias("depends_on"),
    )
    return rows.select("user_id", token.alias("t")).groupBy("user_id").agg(F.array_sort(F.collect_list("t")).alias("tokens"))


def event_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the token array and root paths, in a table of their own as several steps read them."""
    trees = event_tokens(spark, sf_dir)
    return spread(stored(trees.withColumn("paths", T.root_paths(F.col("tokens"))), "trees"))


def dep_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = event_trees(spark, sf_dir)
    return trees.select("user_id", F.posexplode("paths").alias("i", "path")).select("user_id", (F.col("i") + 1).alias("position"), T.depth(F.col("path")).alias("depth"))


def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tree_checks(event_trees(spark, sf_dir), "user_id")


def subtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    above = event_trees(spark, sf_dir).select("user_id", F.explode("paths").alias("path")).select("user_id", F.explode("path").alias("position"))
    return above.groupBy("user_id", "position").agg(F.count("*").alias("n"))


def subtree_of_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the positions below the event in place 2."""
    below = T.subtree(F.col("paths"), F.lit(2))
    trees = event_trees(spark, sf_dir).select("user_id", F.array_join(F.transform(below, lambda p: p.cast("string")), ",").alias("positions"))
    return trees.where("positions <> ''")


def of_pairs(spark: SparkSession, sf_dir: str, value: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """``(user_id, a, name)``: ``value`` of the user's tokens and of the nodes on the path from every event ``a`` to the one three
    places on. Worked out within the user's row, so tokens and root paths are not copied to the pairs."""
    trees = event_trees(spark, sf_dir).where(F.size("tokens") > 3)

    def pair(a: Column) -> Column:
        path = T.dependency_path(F.col("paths"), a, a + 3, F.array(a), F.array(a + 3))
        nodes = let(path, lambda p: path_nodes(F.col("tokens"), F.col("paths"), p))
        return F.struct(a.alias("a"), let(nodes, lambda n: value(F.col("tokens"), n)).alias(name))

    found = F.transform(F.sequence(F.lit(1), F.size("tokens") - 3), pair)
    return trees.select("user_id", F.explode(found).alias("x")).select("user_id", "x.*")


def dep_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_pairs(spark, sf_dir, lambda _, nodes: F.array_join(F.transform(nodes, lambda n: n["position"].cast("string")), ","), "path")


def show(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: F.concat_ws(":", n["position"].cast("string"), n["tag"], n["head"].cast("string"))), " ")


def passive_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_pairs(spark, sf_dir, lambda _, nodes: show(passive_to_active(nodes)), "nodes")


def agents_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_pairs(spark, sf_dir, lambda _, nodes: show(resolve_agent(nodes)), "nodes")


def sequences_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_pairs(spark, sf_dir, lambda _, nodes: show(collapse(nodes, "conj")), "nodes")


def relation_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    def label(tokens: Column, nodes: Column) -> Column:
        said = lambda done: F.struct(F.size(done).alias("n"), print_path(done, tokens).alias("rel"))
        return let(clean_path(nodes), lambda done: F.when(done.isNotNull(), said(done)))

    return of_pairs(spark, sf_dir, label, "label").where("label is not null").select("user_id", "a", "label.n", "label.rel")


def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of a user's tree as the tokens of one node."""
    return event_trees(spark, sf_dir).select("user_id", R.node_label(F.col("tokens")).alias("label"), R.show_node(F.slice("tokens", 1, 2)).alias("node"))


def first_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tree the first preposition and the token in place 3, and how many words meet a node when one word less than nodes is given."""
    tokens = F.col("tokens")
    words = F.transform(F.slice(tokens, F.lit(1), F.size(tokens) - 1), lambda t: t["lemma"])
    zipped = T.zip_nodes(words, tokens)
    return event_trees(spark, sf_dir).select(
        "user_id", T.find(tokens, lambda t: t["dep_tag"] == "prep")["position"].alias("prep"), T.node_of(tokens, 3)["lemma"].alias("third"),
        F.size(zipped).alias("n"), F.size(F.filter(zipped, lambda z: z["word"] == z["node"]["lemma"])).alias("alike"),
    )


def with_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees in which every subject has the role A0 of its head."""
    subjects = F.filter("tokens", lambda t: (t["dep_tag"] == "nsubj") & (t["depends_on"] > 0))
    roles = F.transform(subjects, lambda t: F.struct(t["position"].alias("position"), t["depends_on"].alias("head"), F.lit("A0").alias("label")))
    return event_trees(spark, sf_dir).withColumn("roles", roles).where(F.size("roles") > 0)


def roles_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_roles(spark, sf_dir).select("user_id", T.print_roles(F.col("tokens"), F.col("paths"), F.col("roles")).alias("roles"))


def role_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = T.role_triples(F.col("tokens"), F.col("paths"), F.col("roles"))
    return with_roles(spark, sf_dir).select("user_id", F.explode(triples).alias("x")).select("user_id", "x.*")


def graph_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as two graphs, read back as shards and merged."""
    folder = shared_path(spark, "graphs")
    vertices, edges = table(spark, sf_dir, "vertices"), unpacked_edges(spark, sf_dir)
    for half in (0, 1):
        own = lambda df: df.where(F.pmod(F.coalesce("shard", F.lit(0)), F.lit(2)) == half)  # noqa: B023, E731
        write_graph(own(vertices), own(edges), f"{folder}/g{half}")
    merged = G.merge_edges(read_shards(spark, folder)[1])
    return merged.withColumn("utt_ids", F.array_join("utt_ids", ",")).drop("part")


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_trees(spark, sf_dir).select("user_id", F.explode("tokens").alias("t"))
    return t.select("user_id", "t.position", F.col("t.depends_on").alias("head"), "t.dep_tag", "t.lemma")


def nominal_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worked out within the user's row; root paths are not needed."""
    roles = T.nominal_roles(F.col("tokens"), subject="nsubj|.obj", preposition="prep|conj", object_="conj|nsubjpass", of="click")
    return event_tokens(spark, sf_dir).where("user_id is not null").select("user_id", F.explode(roles).alias("x")).select("user_id", "x.*")


def branching_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a subject and an object below them, one of each for a match."""
    template = T.Template("click|view|.*", (("nsubj", T.Template()), ("dobj", T.Template("[a-z].*"))))
    return T.match_tree(event_edges(spark, sf_dir), ["user_id"], template)


def tree_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_trees(spark, sf_dir).select("user_id", T.pretty_print(F.col("tokens"), F.col("paths")).alias("text"))


def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances to edges: mentions, sentences whose first verb-like word heads the rest, paths, labels, upsert."""
    found = spread(stored(placed_mentions(table(spark, sf_dir, "utterances")), "mentions"))
    words = F.filter(F.split(F.col("text"), " "), lambda w: w != "")
    texts = found.select("row_id", "text").distinct()
    verb = lambda w: w.rlike(VERB_LIKE)
    at = F.coalesce(F.array_position(F.transform("words", verb), True), F.lit(0)).cast("int")
    texts = texts.withColumn("words", words).withColumn("verb", F.when(at > 0, at).otherwise(1))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<begin:int,end:int>>)").alias("found"))

    def place(state: Column, word: Column) -> Column:
        begin = F.call_function("locate", word, F.col("text"), state["at"] + 1) - 1
        return F.struct((begin + F.length(word)).alias("at"), F.array_append(state["found"], F.struct(begin.alias("begin"), (begin + F.length(word)).alias("end"))).alias("found"))

    texts = texts.withColumn("spans", F.aggregate("words", start, place, lambda s: s["found"]))

    def token(word: Column, i: Column) -> Column:
        span, own = F.get("spans", i), i + 1 == F.col("verb")
        return F.struct(
            (i + 1).alias("position"), span["begin"].alias("begin"), span["end"].alias("end"), word.alias("covered_text"), F.lower(F.rtrim(word, F.lit(".,"))).alias("lemma"),
            F.when(own, "VBZ").otherwise("NN").alias("pos_tag"), F.when(own, "root").when(i + 1 < F.col("verb"), "nsubj").otherwise("dobj").alias("dep_tag"),
            F.when(own, 0).otherwise(F.col("verb")).alias("depends_on"),
        )

    sentences = stored(texts.select("row_id", F.lit(0).alias("sent_no"), F.transform("words", token).alias("tokens")), "sentences")
    edges = G.upsert_edges(relation_evidence(found, sentences, "row_id"))
    return edges.where("part = 0").select("src", "rel", "dst", "edge_count")


def xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "annotated_texts").select(F.concat_ws("#", "file_path", "rec_no").alias("_id"), "text", "enhanced_by")
    path = shared_path(spark, "xml")
    write_xml(rows, path)
    back = read_xml(spark, path, "_id string, text string, enhanced_by array<string>")
    return back.select(F.col("_id").alias("id"), "text", F.coalesce(F.array_join("enhanced_by", ","), F.lit("")).alias("enhanced_by"))


QUERIES = {
    f.__name__: f
    for f in (
        edge_upsert, edge_counts, edge_stream, vertex_first_wins, semtype_projection, whitelist_load, whitelist_vertices, merge_graphs, processed_ids,
        unprocessed, vertex_lookup, out_neighbours, dep_depth, tree_roots, subtree_sizes, subtree_of_second, branching_matches, node_labels, first_nodes, roles_printed, role_triples, graph_roundtrip, dep_path, passive_active, agents_resolved,
        sequences_collapsed, relation_label, nominal_relations, tree_print, extraction, xml_roundtrip,
    )
}


def _sql() -> dict[str, str]:
    from spanloom.functions.constants import LABEL_SEMTYPES, SELECTED_SEMTYPES
    from spanloom.plans.annotation import PLACED, SPANS
    from spanloom.plans.preparation import ITEMS, PLAIN

    items = lambda name: f"list_filter(list_transform({ITEMS.format(name)}, lambda x: {PLAIN}), lambda x: x <> '')"
    listed = ", ".join(f"'{r}'" for r in SOME_RELATIONS)
    first = SPANS.replace("list(cui) as cuis", "list(cui order by cand_no) as cuis, list(semtypes order by cand_no) as kinds").replace("n, cuis from kept", "n, cuis, kinds, utt_id from kept")
    evidence_sql = f"""with recursive {first}, m as (select row_id, utt_id, "begin", c.cui as cui, coalesce(array_to_string(c.kind, ','), 'none') as kind from (
            select row_id, utt_id, "begin", unnest(list_transform(range(1, len(cuis) + 1), lambda i: {{'cui': cuis[i], 'kind': kinds[i]}})) as c from chosen where utt_id is not null)),
        ev as (select distinct x.cui as src, x.kind as rel, y.cui as dst, x.utt_id from m x join m y on x.row_id = y.row_id and x."begin" < y."begin" where x.cui is not null and y.cui is not null)"""
    unpacked = f"u as (select src, rel, dst, edge_count, coalesce({items('utt_ids')}, []) as ids from edges)"
    tags = "['nsubj', 'dobj', 'prep', 'pobj', 'nsubjpass', 'conj', 'amod', 'agent', 'punct', 'appos']"
    trees = f"""t as (select user_id, event_type as lemma, p, p // 2 as head, ({tags})[p % 10 + 1] as tag from (select user_id, event_type,
        (row_number() over (partition by user_id order by ts, event_id))::int as p from events)),
        up as (select user_id, p, p as v, 0 as d from t union all select up.user_id, up.p, up.v // 2, d + 1 from up where up.v > 1)"""
    path = f"""with recursive {trees}, pr as (select user_id, p as a, p + 3 as b from t where p + 3 <= (select max(p) from t m where m.user_id = t.user_id)),
        lca as (select pr.user_id, a, b, max(x.v) as c from pr join up x on x.user_id = pr.user_id and x.p = a join up y on y.user_id = pr.user_id and y.p = b and y.v = x.v group by 1, 2, 3),
        pa as (select l.user_id, a, b, c, x.v, row_number() over (partition by l.user_id, a order by x.d) as k from lca l join up x on x.user_id = l.user_id and x.p = a and x.v > c and x.v <> b
        union all select l.user_id, a, b, c, x.v, 1000 - x.d from lca l join up x on x.user_id = l.user_id and x.p = b and x.v >= c and (x.v = c or x.v <> a))"""
    nodes = f"""{path}, nd as (select pa.user_id, a, k, v, t.tag, t.head, row_number() over (partition by pa.user_id, a order by k) as i,
        min(case when t.tag = 'nsubjpass' then k end) over (partition by pa.user_id, a) as first from pa join t on t.user_id = pa.user_id and t.p = pa.v)"""

    def agent_steps(source: str) -> str:
        """The first agent of every path resolved, as ``agd``."""
        return f"""ag as (select user_id, a, arg_min(v, k) as ag_by, arg_min(head, k) as verb_at from {source} where tag = 'agent' group by 1, 2),
            fx as (select user_id, a, ag_by, verb_at, bool_or(v = verb_at) as verb, min(case when head = ag_by then k end) as obj, min(case when head = verb_at and tag = 'nsubj' then k end) as subj
                from ag join {source} using (user_id, a) group by 1, 2, 3, 4),
            agd as (select user_id, a, k, v, case when k = obj and verb then 'nsubj' when k = subj and verb then 'dobj' else tag end as tag, case when k = obj and verb then verb_at else head end as head,
                row_number() over (partition by user_id, a order by k) as i from {source} left join fx using (user_id, a) where ag_by is null or v <> ag_by or obj is null)"""

    def collapsed(name: str, source: str, label: str) -> str:
        """Runs of ``label`` collapsed in the nodes of ``source`` (numbered by ``i``), as ``name``."""
        node = "{'v': s.v, 'tag': s.tag, 'head': s.head, 'd': length(bin(s.v)) - 1}"
        last, rest = "f.done[-1]", "f.done[1:len(f.done) - 1]"
        inherited = "{'v': s.v, 'tag': f.done[-1].tag, 'head': f.done[-1].head, 'd': length(bin(s.v)) - 1}"
        given = "{'v': f.done[-1].v, 'tag': s.tag, 'head': s.head, 'd': f.done[-1].d}"
        return f"""{name}_f as (select user_id, a, i, [{node}] as done from {source} s where i = 1 union all select s.user_id, s.a, s.i,
            case when s.tag = '{label}' then case when length(bin(s.v)) - 1 > {last}.d then list_append({rest}, {inherited}) when {last}.tag = '{label}' then f.done else list_append(f.done, {node}) end
            when {last}.tag = '{label}' then list_append({rest}, {given}) else list_append(f.done, {node}) end
            from {name}_f f join {source} s on s.user_id = f.user_id and s.a = f.a and s.i = f.i + 1),
            {name} as (select user_id, a, generate_subscripts(done, 1) as i, unnest(done, recursive := true) from (select user_id, a, arg_max(done, i) as done from {name}_f group by 1, 2))"""

    merged = f"""with {unpacked}, i as (select src, rel, dst, string_agg(x, ',' order by x) as utt_ids from (select src, rel, dst, unnest(ids) as x from u where src <> dst) group by 1, 2, 3)
            select src, rel, dst, sum(coalesce(edge_count, 0))::bigint as edge_count, coalesce(any_value(utt_ids), '') as utt_ids from u left join i using (src, rel, dst) where src <> dst group by 1, 2, 3"""
    below = "below as (select user_id, v, string_agg(t.lemma, ' ' order by up.p) as words from up join t using (user_id, p) group by 1, 2)"
    agents = f"{nodes}, {agent_steps('nd')}"
    labels = "(" + ", ".join(f"'{s}'" for s in LABEL_SEMTYPES) + ")"
    return {
        "edge_upsert": evidence_sql + " select src, rel, dst, string_agg(utt_id, ',' order by utt_id) as utt_ids, count(*) as edge_count from ev group by 1, 2, 3",
        "edge_counts": evidence_sql + " select src, rel, dst, count(*) as edge_count from ev group by 1, 2, 3",
        "edge_stream": evidence_sql + " select src, rel, dst, count(*) as edge_count from ev group by 1, 2, 3",
        "vertex_first_wins": "select cui, semtypes from (select *, row_number() over (partition by cui order by updated_at, vertex_id) as k from vertices) where k = 1",
        "semtype_projection": f"""select vertex_id, case when semtypes is null then null else coalesce(array_to_string(list_sort(list_distinct(list_filter({items('semtypes')},
            lambda x: list_contains({SELECTED_SEMTYPES!r}, x)))), ','), '') end as semtypes from vertices""",
        "whitelist_load": f"select src, rel, dst, 'umls' as utt_ids, 1::int as edge_count from edges where rel in ({listed}) and src is not null and dst is not null",
        "whitelist_vertices": f"select src as cui from edges where rel in ({listed}) and src is not null and dst is not null union select dst from edges where rel in ({listed}) and src is not null and dst is not null",
        "merge_graphs": merged,
        "graph_roundtrip": merged,
        "node_labels": f"with recursive {trees} select user_id, string_agg(lemma, ' ' order by p) as label, 'DepNode[' || string_agg(lemma, ' ' order by p) filter (p <= 2) || ']' as node from t group by 1",
        "first_nodes": f"""with recursive {trees} select user_id, min(p) filter (tag = 'prep') as prep, any_value(lemma) filter (p = 3) as third, (count(*) - 1)::int as n, (count(*) - 1)::int as alike from t group by 1""",
        "roles_printed": f"""with recursive {trees}, {below} select x.user_id, string_agg('A0(' || h.lemma || ',' || words || ')', chr(9) order by x.p) as roles from t x join t h on h.user_id = x.user_id and h.p = x.head
            join below b on b.user_id = x.user_id and b.v = x.p where x.tag = 'nsubj' and x.head > 0 group by 1""",
        "role_triples": f"""with recursive {trees}, {below} select x.user_id, 'A0' as label, h.lemma as predicate, x.head as predicate_at, words as argument, x.p as argument_at from t x
            join t h on h.user_id = x.user_id and h.p = x.head join below b on b.user_id = x.user_id and b.v = x.p where x.tag = 'nsubj' and x.head > 0""",
        "processed_ids": f"with {unpacked} select distinct unnest(ids) as utt_id from u",
        "unprocessed": f"with {unpacked}, p as (select distinct unnest(ids) as utt_id from u) select row_id, utt_id from utterances x where utt_id is not null and not exists (select 1 from p where p.utt_id = x.utt_id)",
        "vertex_lookup": f"select cui, semtypes from vertices where cui = '{SOME_CUI}' order by updated_at, vertex_id limit 1",
        "out_neighbours": f"select rel, dst, edge_id from edges where src = '{SOME_CUI}'",
        "dep_depth": f"with recursive {trees} select user_id, p as position, max(d)::int as depth from up group by 1, 2",
        "tree_roots": f"with recursive {trees} select user_id, count(*)::int as n_tokens, sum((head = 0)::int)::int as roots, 0::int as missing_heads, false as cycle from t group by 1",
        "subtree_of_second": f"with recursive {trees} select user_id, string_agg(p::varchar, ',' order by p) as positions from up where v = 2 group by 1",
        "branching_matches": f"""with recursive {trees} select n.user_id, n.p as p_0, x.p as p_1, y.p as p_2 from t n join t x on x.user_id = n.user_id and x.head = n.p and x.tag = 'nsubj'
            join t y on y.user_id = n.user_id and y.head = n.p and y.tag = 'dobj'""",
        "agents_resolved": f"{agents} select user_id, a, string_agg(v || ':' || tag || ':' || head, ' ' order by k) as nodes from agd group by 1, 2",
        "sequences_collapsed": f"""{nodes}, {collapsed('cj', 'nd', 'conj')} select user_id, a, string_agg(v || ':' || tag || ':' || head, ' ' order by i) as nodes from cj group by 1, 2""",
        "relation_label": f"""{nodes}, pas as (select user_id, a, k, v, head, case when k = first then 'dobj' else tag end as tag from nd), {agent_steps('pas')},
            verb as (select user_id, a from nd where v % 7 in (1, 5) group by 1, 2), ok as (select agd.* from agd join verb using (user_id, a)),
            {collapsed('cj', 'ok', 'conj')}, {collapsed('ap', 'cj', 'appos')},
            kept as (select *, row_number() over (partition by user_id, a order by i) as j, count(*) over (partition by user_id, a) as n from ap where tag not in ('punct', 'hyph')),
            ends as (select user_id, a, arg_min(v, k) as v1, arg_max(v, k) as v2 from ok group by 1, 2),
            fine as (select k.* from kept k join ends using (user_id, a) join (select user_id, a from kept group by 1, 2 having max(n) <= 6 and bool_or(v % 7 in (1, 5))) using (user_id, a)
                join (select user_id, a, arg_min(v, j) as f1, arg_max(v, j) as f2 from kept group by 1, 2) using (user_id, a) where v1 = f1 and v2 = f2),
            near as (select f.user_id, f.a, f.v, '(' || string_agg(t.lemma, ' ' order by t.p) || ')' as words from fine f join t on t.user_id = f.user_id and t.head = f.v and t.tag in ('amod', 'nn', 'neg')
                and t.p % 7 in (0, 1, 3, 4, 5, 6) and t.lemma not in {labels} where not exists (select 1 from fine g where g.user_id = f.user_id and g.a = f.a and g.v = t.p) group by 1, 2, 3),
            said as (select f.*, t.lemma, case when lag(d) over (partition by f.user_id, f.a order by j) < d then ' <- ' else ' -> ' end as arrow, coalesce(words, '') as words
                from fine f join t on t.user_id = f.user_id and t.p = f.v left join near on near.user_id = f.user_id and near.a = f.a and near.v = f.v)
            select user_id, a, max(n)::int as n, string_agg(case when j = 1 then tag when j = n then arrow || tag else arrow || lemma || case when v % 7 in (1, 5) then ':VB' else '' end
                || case when v % 7 in (0, 3, 6) then ':' || tag || words else '' end end, '' order by j) || case when max(n) = 1 then ' -> ' || any_value(tag) else '' end as rel from said group by 1, 2""",
        "subtree_sizes": f"with recursive {trees} select user_id, v as position, count(*) as n from up where v > 0 group by 1, 2",
        "dep_path": f"{path} select user_id, a, string_agg(v::varchar, ',' order by k) as path from pa group by 1, 2",
        "passive_active": f"""{nodes} select user_id, a, string_agg(v || ':' || case when k = first then 'dobj' else tag end || ':' || head, ' ' order by k) as nodes from nd group by 1, 2""",
        "nominal_relations": f"""with recursive {trees} select n.user_id, case when p.lemma = 'click' then o.p else p.p end as position, n.p as head, case when p.lemma = 'click' then 'A1' else 'AM' end as label
            from t n join t p on p.user_id = n.user_id and p.head = n.p join t o on o.user_id = p.user_id and o.head = p.p
            where n.head > 0 and regexp_full_match(n.tag, 'nsubj|.obj') and p.tag in ('prep', 'conj') and o.tag in ('conj', 'nsubjpass')""",
        "tree_print": f"""with recursive {trees}, d as (select user_id, p, max(d) as d from up group by 1, 2)
            select user_id, string_agg(repeat(chr(9), (2 * d)::int) || head || ':' || tag || ':' || lemma || ':' || p, chr(10) order by p) as text from t join d using (user_id, p) group by 1""",
        "extraction": PLACED + f""", txt as (select distinct row_id, clean as text from m where least >= 0),
            w0 as (select row_id, p, i, coalesce(sum(len(p) + 1) over (partition by row_id order by i rows between unbounded preceding and 1 preceding), 0)::int as b from (
                select row_id, unnest(string_split(text, ' ')) as p, unnest(range(1, len(string_split(text, ' ')) + 1))::int as i from txt)),
            tok as (select row_id, p, b as tb, b + len(p) as te, row_number() over (partition by row_id order by i) as pos from w0 where p <> ''),
            vb as (select row_id, coalesce(min(pos) filter (regexp_matches(p, '{VERB_LIKE}')), 1) as v from tok group by 1),
            vl as (select row_id, v, lower(rtrim(p, '.,')) || ':VB' as said from tok join vb using (row_id) where pos = v),
            own as (select m.row_id, i, place, cuis, said, v, case when bool_or(pos = v) then v else min(pos) end as top from m join vl using (row_id)
                join tok on tok.row_id = m.row_id and tb >= place and te <= place + len(wanted) where least >= 0 group by 1, 2, 3, 4, 5, 6 having bool_or(pos <> v)),
            pr as (select x.row_id, case when x.top = x.v then 'root' else case when x.top < x.v then 'nsubj' else 'dobj' end || ' -> ' || case when y.top = y.v then 'root' else x.said end end
                || case when y.top = y.v then '' when y.top < y.v then ' <- nsubj' else ' <- dobj' end as rel, x.cuis as ones, y.cuis as twos from own x join own y on x.row_id = y.row_id and x.place < y.place),
            c1 as (select row_id, rel, unnest(ones) as src, twos from pr), ev as (select distinct row_id, rel, src, unnest(twos) as dst from c1)
            select src, rel, dst, count(*) as edge_count from ev group by 1, 2, 3""",
        "xml_roundtrip": "select concat_ws('#', file_path, rec_no) as id, text, coalesce(array_to_string(enhanced_by, ','), '') as enhanced_by from annotated_texts",
    }


SQL = _sql()
