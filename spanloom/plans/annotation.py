"""Queries over the annotation and selection operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import render as R
from spanloom.functions.spans import all_within, begin_of, between, contains, covered_text, end_of, resolve_overlaps
from spanloom.functions.text import clean_text
from spanloom.operators import annotations as A
from spanloom.operators import candidates as C
from spanloom.functions.constants import ACRONYM
from spanloom.operators import store as S
from spanloom.operators.pipeline import as_documents, batches, counted, full_pipeline
from spanloom.session import shared_path, spread, stored, table
from spanloom.sources.annotation_xml import documents_xml, read_documents_xml, write_document_files, written_ids
from spanloom.sources.text import document_xml, read_blank_line_documents, read_xml


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "annotated_texts")
    return rows.select("file_path", "rec_no", clean_text(F.col("text")).alias("text"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sections(table(spark, sf_dir, "documents"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tokens(table(spark, sf_dir, "documents"))


def acronym_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.acronym_mentions(tokens(spark, sf_dir))
    return found.select("doc_id", "begin", "end", "concept_id", "score")


def utterance_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tokens(table(spark, sf_dir, "utterances"), "row_id")


def candidate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as multi-span annotations relative to their utterance, numbered."""
    rows = table(spark, sf_dir, "utterances").select("row_id", "text", "start_pos", F.posexplode("phrases").alias("phrase_no", "p"))
    each = rows.select("row_id", "text", "start_pos", "phrase_no", F.posexplode("p.candidates").alias("cand_no", "c"))
    spans = F.transform("c.positions", lambda s: F.struct((s["start_pos"] - F.col("start_pos")).alias("begin"), (s["start_pos"] - F.col("start_pos") + s["length"]).alias("end")))
    return each.select("row_id", "phrase_no", "cand_no", "text", "c.cui", "c.score", "c.semtypes", spans.alias("spans"))


def acronyms_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms that no candidate of at least twelve characters covers."""
    spans = candidate_spans(spark, sf_dir).select("row_id", F.explode("spans").alias("s")).select("row_id", "s.begin", "s.end")
    found = A.acronym_mentions(utterance_tokens(spark, sf_dir), spans.where(F.col("end") - F.col("begin") >= 12), "row_id")
    return found.select("row_id", "begin", "end", "concept_id")


def covered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidate_spans(spark, sf_dir).where(F.size("spans") > 0)
    spans = F.col("spans")
    return c.select("row_id", "phrase_no", "cand_no", begin_of(spans).alias("begin"), end_of(spans).alias("end"), covered_text(F.col("text"), spans).alias("covered"))


def containing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates one of whose spans covers the utterance's first five characters."""
    c = candidate_spans(spark, sf_dir)
    return c.where(contains(F.col("spans"), F.lit(0), F.lit(5))).select("row_id", "phrase_no", "cand_no", "cui")


def token_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = candidate_spans(spark, sf_dir).select("row_id", "phrase_no", "cand_no", F.posexplode("spans").alias("span_no", "s"))
    mention = F.concat_ws("/", "row_id", "phrase_no", "cand_no", "span_no")
    found = A.tokens_of(spans.select("row_id", mention.alias("mention"), "s.begin", "s.end"), utterance_tokens(spark, sf_dir), ["row_id"], "mention")
    return found.select("mention", "t_begin", "t_end")


def noun_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate spans with a noun inside; capitals stand for nouns here."""
    spans = candidate_spans(spark, sf_dir).select("row_id", "phrase_no", "cand_no", F.explode("spans").alias("s"))
    tagged = utterance_tokens(spark, sf_dir).withColumn("pos_tag", F.when(F.col("covered_text").rlike("^[A-Z]"), "NNP").otherwise("VB"))
    return A.noun_gate(spans.select("row_id", "phrase_no", "cand_no", "s.begin", "s.end"), tagged, "row_id")


def dedup_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "utterances").where("utt_id is not null")
    rows = rows.select("row_id", "utt_id", F.coalesce("start_pos", F.lit(-1)).alias("start_pos"), F.coalesce("length", F.lit(-1)).alias("length"))
    return A.drop_duplicates(rows, ["utt_id", "start_pos", "length"], "row_id")


def mention_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = candidate_spans(spark, sf_dir).where(F.size("spans") > 0)
    seq = F.struct("phrase_no", "cand_no")
    m = spans.select("row_id", begin_of(F.col("spans")).alias("begin"), end_of(F.col("spans")).alias("end"), seq.alias("seq"), F.array("cui").alias("concepts"))
    merged = A.merge_mentions(m, ["row_id", "begin", "end"], "seq")
    return merged.select("row_id", "begin", "end", F.array_join("concepts", ",", "-").alias("concepts"))


def chunk_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    order = A.Window.partitionBy("user_id").orderBy("ts", "event_id")
    chunks = e.select("user_id", F.row_number().over(order).alias("begin"), (F.row_number().over(order) + 1).alias("end"), F.col("event_type").alias("chunk_type"))
    return A.merge_chunks(chunks, ["user_id"])


def containment_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = candidate_spans(spark, sf_dir).select("row_id", "phrase_no", "cand_no", F.posexplode("spans").alias("span_no", "s"))
    seq = F.struct("phrase_no", "cand_no", "span_no")
    kept = A.suppress_contained(spans.select("row_id", seq.alias("seq"), "s.begin", "s.end"), "row_id", "seq")
    return kept.select("row_id", "seq.*", "begin", "end")


def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "utterances").select("row_id", F.posexplode("phrases").alias("phrase_no", "p"))
    concepts = F.transform("p.candidates", lambda c: F.struct(c["cui"].alias("concept_id"), F.lit("UMLS").alias("source"), (-c["score"] / 1000.0).alias("score")))
    kept = A.select_concepts(rows.select("row_id", "phrase_no", concepts.alias("concepts")), 0.9)
    return kept.select("row_id", "phrase_no", F.size("concepts").alias("n"), F.array_join(F.transform("concepts", lambda c: c["concept_id"]), ",", "-").alias("concepts"))


def span_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.violations(candidate_spans(spark, sf_dir), single=True)
    return found.select("row_id", "phrase_no", "cand_no", "reason")


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = C.best_in_phrase(C.candidate_positions(table(spark, sf_dir, "utterances")))
    return best.select("row_id", "phrase_no", "cand_no", "begin", "size", "score", "cui")


def last_phrase_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = C.last_phrase(C.best_in_phrase(C.candidate_positions(table(spark, sf_dir, "utterances"))))
    return best.select("row_id", "phrase_no", "cand_no", "begin", "size")


def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 60).cast("int").alias("begin"), (F.col("l_quantity").cast("int") % 12 + 1).alias("size"))
    per = spans.groupBy("l_orderkey").agg(F.collect_list(F.struct("begin", "size")).alias("spans"))
    return per.select("l_orderkey", F.explode(resolve_overlaps(F.col("spans"))).alias("s")).select("l_orderkey", "s.begin", "s.size")


def bounds_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "utterances")
    c = C.candidate_positions(u).join(u.select("row_id", "start_pos", "length"), "row_id")
    begin = F.col("begin") - F.col("start_pos")
    rows = c.select("row_id", "phrase_no", "cand_no", begin.alias("begin"), (begin + F.col("size")).alias("end"), "length")
    return rows.where("begin >= 0 and end > begin and end < length").drop("length")


def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidate_spans(spark, sf_dir).withColumn("covered", covered_text(F.col("text"), F.col("spans")))
    return c.where(C.allowed(F.col("semtypes"), F.col("covered"))).select("row_id", "phrase_no", "cand_no")


def selected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole selection: best, last phrase, overlaps, bounds."""
    rows = C.select_spans(table(spark, sf_dir, "utterances"))
    return rows.select("row_id", "begin", "end", F.size("candidates").alias("n"))


def mentions_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected spans relocated in the cleaned text and admitted, utterances with two spans at least."""
    rows = C.mentions(table(spark, sf_dir, "utterances"))
    return rows.select("row_id", "m_no", "begin", "end", "covered_text", F.size("concepts").alias("n"))


def multi_span_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = C.with_chosen_spans(table(spark, sf_dir, "utterances"), ["row_id"])
    return spans.select("row_id", F.size("spans").cast("bigint").alias("n")).where("n > 1")


def span_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two chosen spans of an utterance in order, made within its row."""
    spans = C.with_chosen_spans(table(spark, sf_dir, "utterances"), ["row_id", "utt_id"])
    return spans.select("row_id", "utt_id", F.explode(C.pairs_within(F.col("spans"))).alias("p"))


def mention_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [F.col(f"p.{x}.{c}").alias(f"{c}_{i}") for i, x in ((1, "one"), (2, "two")) for c in ("begin", "end")]
    return span_pairs(spark, sf_dir).select("row_id", *ends)


def concept_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuis = span_pairs(spark, sf_dir).select(F.col("p.one.candidates.cui").alias("concepts_1"), F.col("p.two.candidates.cui").alias("concepts_2"))
    return C.concept_pairs(cuis).groupBy("concept_1", "concept_2").agg(F.count("*").alias("n"))


def pipeline_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents annotated in two goes, the second skipping what the first has done."""
    docs = as_documents(spread(table(spark, sf_dir, "documents")), "doc_id", "text")
    path = shared_path(spark, "annotated")
    pipeline = full_pipeline()
    pipeline.append(docs.where(F.length("text") < 500), path)
    done = pipeline.append(docs, path)
    count = lambda name: F.coalesce(F.size(name), F.lit(0))
    return done.select(F.col("id").cast("bigint").alias("doc_id"), F.greatest(count("tokens"), F.lit(0)).alias("n_tokens"), F.greatest(count("mentions"), F.lit(0)).alias("n_mentions"))


def mention_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selector: concepts above a score, mentions of one span that still have one, and of those no one inside another."""
    score = (-F.col("score") / 1000.0).alias("score")
    concept = F.struct(F.col("cui").alias("concept_id"), F.lit("UMLS").alias("source"), score)
    seq = F.struct("phrase_no", "cand_no").alias("seq")
    m = candidate_spans(spark, sf_dir).select("row_id", seq, "spans", F.array(concept).alias("concepts"))
    kept = A.select_concepts(m, 0.85).select("row_id", "seq", "concepts", begin_of(F.col("spans")).alias("begin"), end_of(F.col("spans")).alias("end"))
    return A.suppress_contained(kept, "row_id", "seq").select("row_id", "seq.*", "begin", "end")


def candidates_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that begin and end within the first forty characters, and whether all their spans lie there."""
    c = candidate_spans(spark, sf_dir).where(F.size("spans") > 0)
    spans = F.col("spans")
    inside = c.where(between(begin_of(spans), end_of(spans), F.lit(0), F.lit(40)))
    return inside.select("row_id", "phrase_no", "cand_no", all_within(spans, F.lit(0), F.lit(40)).alias("all_inside"))


def shown_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as they are printed: their text, their first span, their concept."""
    c = candidate_spans(spark, sf_dir).where((F.size("spans") > 0) & F.col("text").isNotNull() & F.col("cui").isNotNull())
    concept = F.struct(F.col("cui").alias("concept_id"), F.col("cui").alias("preferred_label"), F.lit("UMLS").alias("source"))
    return c.select(
        "row_id", "phrase_no", "cand_no", R.show_annotation("Mention", covered_text(F.col("text"), F.col("spans"))).alias("shown"),
        R.show_span(F.get("spans", F.lit(0))).alias("span"), R.show_concept(concept).alias("concept"),
    )


#: Supertypes of the annotations that the store queries make.
PARENTS = {"Acronym": "Mention", "Mention": "Entity"}


def annotation_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and acronyms of documents in one store."""
    docs = table(spark, sf_dir, "documents")
    spans = F.array(F.struct("begin", "end"))
    lines = S.as_annotations(A.sections(docs), "Section", "doc_id", spans, "sec_no")
    acronyms = S.as_annotations(A.acronym_mentions(A.tokens(docs)), "Acronym", "doc_id", spans, "begin", ("concept_id",), PARENTS)
    return S.insert(lines, acronyms)


def annotation_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many annotations a document has under each type, supertypes too, within its first 200 characters."""
    return S.listings_between(annotation_store(spark, sf_dir), 0, 200).groupBy("doc_id", "listed_as").agg(F.count("*").alias("n"))


def mentions_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is listed as a mention once the list of acronyms is removed, by document."""
    found = S.of_type(S.remove_type(annotation_store(spark, sf_dir), "Acronym"), "Mention")
    return found.select("doc_id", begin_of(F.col("spans")).alias("begin"), F.col("fields")["concept_id"].alias("concept_id"), F.array_join("listed_under", ",").alias("listed_under"))


def section_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents, as sentences, by the section they lie in."""
    docs = table(spark, sf_dir, "documents")
    words = A.tokens(docs).withColumn("sent_no", F.col("sent_no") * 1_000_000 + F.col("position"))
    return S.sentences_of_sections(A.sections(docs), words).groupBy("doc_id", "sec_no").agg(F.count("*").alias("n"), F.min("begin").alias("first"), F.max("end").alias("last"))


def document_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(table(spark, sf_dir, "documents").select("doc_id"), 64, "doc_id")


def annotation_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and acronyms written as XML, one text a document, and read back: how many there are and what they cover."""
    store = stored(annotation_store(spark, sf_dir), "annotations")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.array(F.lit("A")).alias("enhanced_by"))
    types = ["Section", "Acronym"]
    _, back = read_documents_xml(stored(documents_xml(docs, store, types), "xml"), types, parents=PARENTS)
    return S.listings(back).groupBy("doc_id", "listed_as").agg(F.count("*").alias("n"), F.sum(end_of(F.col("spans")) - begin_of(F.col("spans"))).alias("n_chars"))


def blank_line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations by region, written as documents parted by blank lines and read back."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("text"))
    path = shared_path(spark, "blank-lines")
    n.select(F.concat("text", F.lit("\n"))).write.text(path)
    return read_blank_line_documents(spark, f"{path}/*.txt").select("text")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as one XML file each, read back; only those whose file is listed."""
    folder = shared_path(spark, "document-files")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    write_document_files(rows.select("id", document_xml({"_id": F.col("id"), "name": F.col("name")}).alias("xml")), folder)
    back = read_xml(spark, f"{folder}/*.xml", "_id string, name string").withColumnRenamed("_id", "id")
    return back.join(written_ids(spark, folder), "id", "left_semi")


def counted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters kept beside a job over all orders."""
    rows, seen = counted(table(spark, sf_dir, "orders"), "orders", urgent=F.sum((F.col("o_orderpriority") == "1-URGENT").cast("bigint")))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"], seen.get["urgent"])], "rows bigint, urgent bigint")


QUERIES = {
    f.__name__: f
    for f in (
        clean_texts, sections, tokens, acronym_tokens, acronyms_uncovered, covered_texts, containing_candidates, token_containment, noun_gate,
        dedup_annotations, mention_merge, chunk_islands, containment_suppression, score_threshold, span_violations, best_candidates,
        last_phrase_wins, overlap_resolution, bounds_filter, candidate_filter, selected_spans, mentions_placed, multi_span_utterances,
        mention_pairs, concept_cross, pipeline_resume, mention_selection, candidates_within, shown_annotations, annotation_listings, mentions_of_type, section_sentences, document_batches, annotation_xml, blank_line_documents,
        document_files, counted_rows,
    )
}

CLEAN = r"regexp_replace(regexp_replace(replace({0}, '’', ''''), '([^\s])(:)([^\s])', '\1 \2 \3', 'g'), ' {{2,}}', ' ', 'g')"
LINES = """l as (select {key}, (row_number() over (partition by {key} order by i))::int - 1 as sec_no, b as "begin", b + len(p) as "end", p from (select {key}, p, i,
    coalesce(sum(len(p) + 1) over (partition by {key} order by i rows between unbounded preceding and 1 preceding), 0)::int as b from (
    select {key}, unnest(s) as p, unnest(range(1, len(s) + 1))::int as i from (select {key}, string_split_regex(text, '[\\n\\r]') as s from {table} where text is not null))) where p <> '')"""
TOKENS = (
    "with recursive " + LINES + """, t as (select {key}, sec_no as sent_no, b + lb as "begin", b + lb + len(p) as "end", p as covered_text, i from (select {key}, sec_no, "begin" as lb, p, i,
    coalesce(sum(len(p) + 1) over (partition by {key}, sec_no order by i rows between unbounded preceding and 1 preceding), 0)::int as b from (
    select {key}, sec_no, "begin", unnest(string_split(p, ' ')) as p, unnest(range(1, len(string_split(p, ' ')) + 1))::int as i from l)))"""
)
DOCS, UTTS = TOKENS.format(key="doc_id", table="documents"), TOKENS.format(key="row_id", table="utterances")
CANDS = """c as (select row_id, text, start_pos, length, phrase_no, i - 1 as cand_no, x.cui as cui, x.score as score, x.semtypes as semtypes, x.positions as positions from (
    select row_id, text, start_pos, length, phrase_no, unnest(cs) as x, unnest(range(1, len(cs) + 1))::int as i from (
    select row_id, text, start_pos, length, i - 1 as phrase_no, p.candidates as cs from (select row_id, text, start_pos, length, unnest(phrases) as p, unnest(range(1, len(phrases) + 1))::int as i from utterances)))),
    s as (select row_id, text, start_pos, length, phrase_no, cand_no, cui, score, semtypes, i - 1 as span_no, q.start_pos as abs_pos, q.length as size, q.start_pos - start_pos as b, q.start_pos - start_pos + q.length as e from (
    select *, unnest(positions) as q, unnest(range(1, len(positions) + 1))::int as i from c))"""
COVERED = "array_to_string(list_transform(positions, lambda q: substring(text, q.start_pos - start_pos + 1, q.length)), ' ')"
TEXTUAL = "text is not null and len(positions) > 0"
BEST = f"""{CANDS}, best as (select * from (select *, min(score) over (partition by row_id, phrase_no, abs_pos, size) as m from s) where score = m),
    lastp as (select * from (select *, max(phrase_no) over (partition by row_id, abs_pos, size) as lp from best) where phrase_no = lp)"""
FOLD = """g as (select {key}, row_number() over (partition by {key} order by b, z) as i, b, z from {source}),
    f as (select {key}, i, [{{'b': b, 'z': z}}] as kept from g where i = 1 union all
    select g.{key}, g.i, case when f.kept[-1].b + f.kept[-1].z < g.b then list_append(f.kept, {{'b': g.b, 'z': g.z}})
    when g.z <= f.kept[-1].z then f.kept else list_append(f.kept[1:len(f.kept) - 1], {{'b': g.b, 'z': g.z}}) end
    from f join g on g.{key} = f.{key} and g.i = f.i + 1),
    kept as (select {key}, unnest(kept, recursive := true) from (select {key}, arg_max(kept, i) as kept from f group by 1))"""
SPANS = f"""{BEST}, spots as (select row_id, abs_pos as b, size as z, count(*) as n, list(cui) as cuis from lastp group by all), {FOLD.format(key="row_id", source="spots")},
    chosen as (select k.row_id, k.b - u.start_pos as "begin", k.b - u.start_pos + k.z as "end", n, cuis from kept k join spots using (row_id, b, z) join utterances u using (row_id)
    where k.b >= u.start_pos and k.z > 0 and k.b - u.start_pos + k.z < u.length)"""

KINDS = SPANS.replace("list(cui) as cuis", "list(cui) as cuis, list(semtypes) as kinds").replace("n, cuis from kept", "n, cuis, kinds, text from kept")
ALLOWED = f"""len(list_filter(kinds, lambda s: len(list_intersect(s, {C.SELECTED_SEMTYPES!r})) > 0 and len(wanted) >= 2 and case when list_contains(s, 'gngm')
    then not regexp_full_match(wanted, '[A-Z]?[a-z]+') and lower(wanted) <> 'ii' else not starts_with(wanted, 'level') end)) > 0"""
PLACED = f"""with recursive {KINDS}, r as (select *, replace(text, '""', '"') || '.' as raw, row_number() over (partition by row_id order by "begin") as i,
    count(*) over (partition by row_id) as k from chosen where text is not null),
    w as (select row_id, i, n, cuis, kinds, {CLEAN.format("raw")} as clean, {CLEAN.format('substring(raw, "begin" + 1, "end" - "begin")')} as wanted from r where k > 1),
    pl as (select row_id, i, instr(clean, wanted) - 1 as place from w where i = 1 union all select w.row_id, w.i, case when wanted = '' then 0
    when instr(substring(clean, place + 2), wanted) = 0 then -1 else place + instr(substring(clean, place + 2), wanted) end from pl join w on w.row_id = pl.row_id and w.i = pl.i + 1),
    m as (select w.*, place, min(place) over (partition by w.row_id) as least from w join pl using (row_id, i) where {ALLOWED})"""
NOT_NOUN = ["^[0-9.,%]+$", "(?:ed|ing|izes|uces)$", "(?:ous|al|ive|ic)$", "^(?i:the|a|an|of|in|by|with|for|to)$"]

SQL = {
    "mentions_placed": PLACED + """ select row_id, (i - 1)::int as m_no, place::int as "begin", (place + len(wanted))::int as "end", wanted as covered_text, n::int as n from m where least >= 0""",
    "pipeline_resume": TOKENS.format(key="doc_id", table=f"(select doc_id, {CLEAN.format('text')} as text from documents)")
    + f""", c as (select doc_id, count(*) as n_tokens, sum((regexp_full_match(covered_text, '{ACRONYM}') and not regexp_matches(covered_text, '{"|".join(NOT_NOUN)}'))::int) as n_mentions
        from t where covered_text <> '' group by 1) select doc_id, coalesce(n_tokens, 0)::int as n_tokens, coalesce(n_mentions, 0)::int as n_mentions from documents left join c using (doc_id)""",
    "mention_selection": f"""with {CANDS}, o as (select row_id, phrase_no, cand_no, b, e from (select *, count(*) over (partition by row_id, phrase_no, cand_no) as k from s) where k = 1 and -score / 1000.0 > 0.85)
        select row_id, phrase_no, cand_no, b as "begin", e as "end" from o m where not exists (select 1 from o where o.row_id = m.row_id
        and o.b <= m.b and o.e >= m.e and (o.e - o.b > m.e - m.b or (o.e - o.b = m.e - m.b and (o.phrase_no, o.cand_no) < (m.phrase_no, m.cand_no))))""",
    "candidates_within": f"""with {CANDS} select row_id, phrase_no, cand_no, bool_and(b >= 0 and e <= 40) as all_inside from s group by 1, 2, 3
        having arg_min(b, span_no) >= 0 and arg_max(e, span_no) <= 40""",
    "shown_annotations": f"""with {CANDS} select row_id, phrase_no, cand_no, 'Mention[' || {COVERED} || ']' as shown,
        '[' || (positions[1].start_pos - start_pos) || ',' || (positions[1].start_pos - start_pos + positions[1].length) || ')' as span, cui || '-' || cui || '[UMLS]' as concept
        from c where len(positions) > 0 and text is not null and cui is not null""",
    "blank_line_documents": "select string_agg(n_name, chr(10) order by n_name) as text from nation group by n_regionkey",
    "document_files": "select s_suppkey::varchar as id, s_name as name from supplier",
    "counted_rows": "select count(*) as rows, sum((o_orderpriority = '1-URGENT')::int)::bigint as urgent from orders",
    "annotation_listings": DOCS + f""", x as (select doc_id, 'Section' as listed_as, "begin", "end" from l union all
        select doc_id, unnest(['Acronym', 'Mention', 'Entity']), "begin", "end" from t where regexp_full_match(covered_text, '{ACRONYM}'))
        select doc_id::varchar as doc_id, listed_as, count(*) as n from x where "begin" >= 0 and "end" <= 200 group by 1, 2""",
    "mentions_of_type": DOCS + f""" select doc_id::varchar as doc_id, "begin"::int as "begin", upper(covered_text) as concept_id, 'Mention,Entity' as listed_under from t where regexp_full_match(covered_text, '{ACRONYM}')""",
    "section_sentences": DOCS + """ select doc_id, sent_no as sec_no, count(*) as n, min("begin") as first, max("end") as last from t where covered_text <> '' group by 1, 2""",
    "document_batches": "select doc_id, (row_number() over (order by doc_id) - 1) // 64 as batch from documents",
    "annotation_xml": DOCS + f""", x as (select doc_id, 'Section' as listed_as, "begin", "end" from l union all
        select doc_id, unnest(['Acronym', 'Mention', 'Entity']), "begin", "end" from t where regexp_full_match(covered_text, '{ACRONYM}'))
        select doc_id::varchar as doc_id, listed_as, count(*) as n, sum("end" - "begin")::bigint as n_chars from x group by 1, 2""",
    "clean_texts": f"select file_path, rec_no, {CLEAN.format('text')} as text from annotated_texts",
    "sections": "with " + LINES.format(key="doc_id", table="documents") + ' select doc_id, sec_no, "begin", "end" from l',
    "tokens": DOCS + """ select doc_id, sent_no, row_number() over (partition by doc_id, sent_no order by i)::int as position, "begin", "end", covered_text from t where covered_text <> ''""",
    "acronym_tokens": DOCS + f""" select doc_id, "begin", "end", upper(covered_text) as concept_id, 0.5::double as score from t where regexp_full_match(covered_text, '{ACRONYM}')""",
    "acronyms_uncovered": UTTS + f""", {CANDS} select row_id, "begin", "end", upper(covered_text) as concept_id from t where regexp_full_match(covered_text, '{ACRONYM}')
        and not exists (select 1 from s where s.row_id = t.row_id and s.b <= t."begin" and s.e >= t."end" and s.e - s.b >= 12)""",
    "covered_texts": f"""with {CANDS} select row_id, phrase_no, cand_no, positions[1].start_pos - start_pos as "begin", positions[-1].start_pos - start_pos + positions[-1].length as "end",
        case when text is null then null else {COVERED} end as covered from c where len(positions) > 0""",
    "containing_candidates": f"with {CANDS} select distinct row_id, phrase_no, cand_no, cui from s where b <= 0 and e >= 5",
    "token_containment": UTTS + f""", {CANDS}, w as (select * from t where covered_text <> ''), m as (select concat_ws('/', row_id, phrase_no, cand_no, span_no) as mention, row_id, b, e from s),
        i as (select mention, "begin" as t_begin, "end" as t_end from m join w on m.row_id = w.row_id and "begin" >= b and "end" <= e)
        select * from i union all select mention, "begin", "end" from m join w on m.row_id = w.row_id and "begin" <= b and "end" >= e where mention not in (select mention from i)""",
    "noun_gate": UTTS + f""", {CANDS} select row_id, phrase_no, cand_no, b as "begin", e as "end" from s where exists (select 1 from t where t.row_id = s.row_id and t."begin" >= b and t."end" <= e and regexp_matches(covered_text, '^[A-Z]'))""",
    "dedup_annotations": "select max(row_id) as row_id, utt_id, coalesce(start_pos, -1) as start_pos, coalesce(length, -1) as length from utterances where utt_id is not null group by all",
    "mention_merge": f"""with {CANDS} select row_id, positions[1].start_pos - start_pos as "begin", positions[-1].start_pos - start_pos + positions[-1].length as "end",
        string_agg(coalesce(cui, '-'), ',' order by phrase_no, cand_no) as concepts from c where len(positions) > 0 group by 1, 2, 3""",
    "chunk_islands": """with p as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id)::int as i from events),
        q as (select *, case when event_type is not distinct from lag(event_type) over (partition by user_id order by i) and i > 1 then 0 else 1 end as starts from p),
        r as (select *, sum(starts) over (partition by user_id order by i) as run from q)
        select user_id, min(i)::int as "begin", (max(i) + 1)::int as "end", any_value(event_type) as chunk_type from r group by user_id, run""",
    "containment_suppression": f"""with {CANDS} select row_id, phrase_no, cand_no, span_no, b as "begin", e as "end" from s m where not exists (select 1 from s o where o.row_id = m.row_id
        and o.b <= m.b and o.e >= m.e and (o.e - o.b > m.e - m.b or (o.e - o.b = m.e - m.b and (o.phrase_no, o.cand_no, o.span_no) < (m.phrase_no, m.cand_no, m.span_no))))""",
    "score_threshold": f"""with {CANDS} select row_id, phrase_no, count(*)::int as n, string_agg(coalesce(cui, '-'), ',' order by cand_no) as concepts from c where -score / 1000.0 > 0.9 group by 1, 2""",
    "span_violations": f"""with {CANDS}, o as (select row_id, phrase_no, cand_no, bool_or(size < 0 or abs_pos < p) as bad from (select *, lag(abs_pos + size) over (partition by row_id, phrase_no, cand_no order by span_no) as p from s) group by 1, 2, 3)
        select c.row_id, c.phrase_no, c.cand_no, case when coalesce(len(positions), 0) = 0 then 'no spans' when bad then 'spans out of order' else 'more than one span' end as reason
        from c left join o using (row_id, phrase_no, cand_no) where coalesce(len(positions), 0) = 0 or bad or len(positions) > 1""",
    "best_candidates": f'with {BEST} select row_id, phrase_no, cand_no, abs_pos as "begin", size, score, cui from best',
    "last_phrase_wins": f'with {BEST} select row_id, phrase_no, cand_no, abs_pos as "begin", size from lastp',
    "overlap_resolution": "with recursive a as (select l_orderkey, (l_partkey % 60)::int as b, (l_quantity::int % 12 + 1)::int as z from lineitem), "
    + FOLD.format(key="l_orderkey", source="a") + ' select l_orderkey, b as "begin", z as size from kept',
    "bounds_filter": f'with {CANDS} select row_id, phrase_no, cand_no, b as "begin", e as "end" from s where b >= 0 and e > b and e < length',
    "candidate_filter": f"""with {CANDS}, d as (select row_id, phrase_no, cand_no, semtypes, case when text is null then null else {COVERED} end as v from c)
        select row_id, phrase_no, cand_no from d where len(v) >= 2 and len(list_intersect(semtypes, {C.SELECTED_SEMTYPES!r})) > 0 and
        case when list_contains(semtypes, 'gngm') then not regexp_full_match(v, '[A-Z]?[a-z]+') and lower(v) <> 'ii' else not starts_with(v, 'level') end""",
    "selected_spans": f'with recursive {SPANS} select row_id, "begin", "end", n::int as n from chosen',
    "multi_span_utterances": f"with recursive {SPANS} select row_id, count(*) as n from chosen group by 1 having count(*) > 1",
    "mention_pairs": f"""with recursive {SPANS} select x.row_id, x."begin" as begin_1, x."end" as end_1, y."begin" as begin_2, y."end" as end_2 from chosen x join chosen y on x.row_id = y.row_id and x."begin" < y."begin" """,
    "concept_cross": f"""with recursive {SPANS}, d as (select row_id, "begin", unnest(cuis) as cui from chosen) select x.cui as concept_1, y.cui as concept_2, count(*) as n from d x join d y on x.row_id = y.row_id and x."begin" < y."begin" group by 1, 2""",
}
