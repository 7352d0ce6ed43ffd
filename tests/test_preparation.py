import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.functions.text import clean_text
from spanloom.operators.compact import ConflictError, Policy, Snapshots, compact_directory, compact_records, first_deliveries, read_table, small_file_partitions, vacuum
from spanloom.operators.packed import explode_packed
from spanloom.plans.preparation import p5_found

CASES = [
    ("a,b;c|d", ["a", "b", "c", "d"]), ("'x, y' z", ["x, y", "z"]), ('"run ""b"", late",u', ['run "b", late', "u"]), ('["run \\"b\\"", "q"]', ['run "b"', "q"]),
    ('a"b"c', ["a", "b", "c"]), ('""', []), ("", []), ("  \t", []), (None, []), ('"open, x', ["open", "x"]), ("it's", ["it", "s"]), ("a,,a", ["a", "a"]),
    ("0 \"q\"", ["0", "q"]), ("é.ü-1，_x", ["é.ü-1", "_x"]), ("'only \"double\" inside'", ['only "double" inside']),
]


def test_packed_values(spark):
    df = spark.createDataFrame([(i, s, "clash") for i, (s, _) in enumerate(CASES)], "k int, v string, pos string")
    got = {}
    for r in explode_packed(df, "k", "v").orderBy("row_id", "pos").collect():
        got.setdefault(r.row_id, []).append((r.pos, r.item))
    assert got == {i: list(enumerate(items, 1)) for i, (_, items) in enumerate(CASES) if items}
    assert explode_packed(df.limit(0), "k", "v").count() == 0


def brute(packed):
    items, at = [], 0
    while at < len(packed):
        c = packed[at]
        if c == "'" and packed.find("'", at + 1) > 0:
            end = packed.find("'", at + 1)
            items.append(packed[at + 1 : end])
            at = end + 1
        elif c.isalnum() or c in "._-":
            end = at
            while end < len(packed) and (packed[end].isalnum() or packed[end] in "._-"):
                end += 1
            items.append(packed[at:end])
            at = end
        else:
            at += 1
    return [i for i in items if i]


def test_packed_against_brute_force(spark):
    found = []

    @settings(max_examples=300, database=None)
    @given(st.text("ab1._-' ,;|", max_size=25))
    def collect(text):
        found.append(text)

    collect()
    df = spark.createDataFrame(list(enumerate(found)), "k int, v string")
    got = {r.row_id: r.items for r in explode_packed(df, "k", "v").groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(found) if brute(t)}


def test_very_long_packed_value(spark):
    text = '"' + 'ab""\\"' * 20_000 + '"' + ",x" * 20_000
    assert explode_packed(spark.createDataFrame([(1, text)], "k int, v string"), "k", "v").count() == 20_001


def test_clean_text(spark):
    rows = [("a:b:c", "a : b:c"), ("x   y", "x y"), ("it’s", "it's"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(clean_text(F.col("a"))).collect()] == [b for _, b in rows]


RECORDS = [
    ("d/1", "f1", 1, "A", "x:y", 10), ("d/1", "f2", 1, "A", "x : y", 10), ("d/1", "f3", 1, None, None, 5), ("d/1", "f4", 1, None, None, 5), ("d/2", "f5", 1, "B", "z", 7),
    ("d/2", "f5", 2, "A", "z", 7), (None, None, 1, "C", "q", None), ("d/1", "f0", 9, "D", "", 1),
]


@pytest.mark.parametrize("most", [0, 1, 100])
def test_compaction_keeps_each_record_once(spark, tmp_path, most):
    df = spark.createDataFrame(RECORDS, "folder string, file_path string, rec_no int, id string, text string, n_bytes long")
    keep = first_deliveries(df, [F.col("id"), clean_text(F.col("text"))], ["file_path", "rec_no"])
    out = compact_records(df, f"file://{tmp_path}/t", "folder", "file_path", "n_bytes", keep, ("file_path", "rec_no"), Policy(max_small_files=most))
    got = sorted((str(r.file_path), r.rec_no, r.text) for r in out.collect())
    assert got == [("None", 1, "q"), ("f0", 9, ""), ("f1", 1, "x:y"), ("f3", 1, None), ("f5", 1, "z"), ("f5", 2, "z")]
    assert out.columns == df.columns


def test_compaction_of_files_without_a_folder(spark, tmp_path):
    rows = [(folder, f"{folder}{i}", i, 1) for folder in ("", None, "d", "__HIVE_DEFAULT_PARTITION__") for i in range(12)]
    df = spark.createDataFrame(rows, "folder string, file_path string, rec_no int, n_bytes long")
    keep = df.where("rec_no < 10").select("file_path", "rec_no")
    for kept, most in ((None, 12), (keep, 10)):
        out = compact_records(df, f"file://{tmp_path}/t{most}", "folder", "file_path", "n_bytes", kept, ("file_path", "rec_no"))
        assert sorted(map(str, out.collect())) == sorted(map(str, df.where(f"rec_no < {most}").collect()))


def test_query_keeps_records_of_files_without_a_folder(spark, tmp_path):
    rows = [(f"f{i}" if i < 12 else f"d/f{i}", 1, str(i), "x", 1) for i in range(24)] + [("f0", 2, "0", "x", 1)]
    df = spark.createDataFrame(rows, "file_path string, rec_no int, id string, text string, n_bytes long")
    df.write.parquet(f"{tmp_path}/annotated_texts.parquet")
    assert sorted(map(tuple, p5_found(spark, str(tmp_path)).collect())) == sorted((r[0], 1) for r in rows if r[1] == 1)


def test_compaction_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "folder string, file_path string, rec_no int, n_bytes long")
    assert compact_records(df, f"file://{tmp_path}/t", "folder", "file_path", "n_bytes").count() == 0
    assert small_file_partitions(df, Policy(), "folder", "file_path", "n_bytes").count() == 0


def sums(df):
    return df.agg(F.count("*"), F.sum("id"), F.countDistinct("id")).first()[:]


def test_directory_compaction_and_conflict(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(300).withColumn("p", F.when(F.col("id") < 200, "a").otherwise("b"))
    rows.where("p = 'a'").repartition(20).write.partitionBy("p").parquet(path)
    rows.where("p = 'b'").coalesce(1).write.mode("append").partitionBy("p").parquet(path)
    done = compact_directory(spark, path, "p")
    assert (done["version"], done["partitions"], done["files_before"], done["files_after"]) == (1, 1, 20, 1) and done["largest_bytes"] > 0
    assert sums(read_table(spark, path)) == sums(read_table(spark, path, 0)) == (300, 44850, 300)
    assert compact_directory(spark, path, "p")["partitions"] == 0
    with pytest.raises(ConflictError):
        Snapshots(spark, path).commit(0)
    assert vacuum(spark, path) == 20 and vacuum(spark, path) == 0
    assert sums(read_table(spark, path)) == (300, 44850, 300) and len(list(tmp_path.rglob("*.parquet"))) < 12
    more = spark.range(300, 420).withColumn("p", F.lit("a"))
    more.repartition(12).write.mode("append").partitionBy("p").parquet(path)
    assert sums(read_table(spark, path))[0] == 420
    again = compact_directory(spark, path, "p")  # files of the first compaction and new ones
    assert (again["files_before"], again["files_after"]) == (13, 1) and sums(read_table(spark, path)) == (420, 420 * 419 // 2, 420)
    vacuum(spark, path)
    assert sums(read_table(spark, path)) == (420, 420 * 419 // 2, 420)


def test_directory_of_which_all_files_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(100).withColumn("p", F.lit(7)).repartition(10).write.partitionBy("p").parquet(path)
    compact_directory(spark, path, "p")
    assert vacuum(spark, path) == 10 and sums(read_table(spark, path)) == (100, 4950, 100)
    assert compact_directory(spark, path, "p")["partitions"] == 0 and read_table(spark, f"{tmp_path}/none") is None


@pytest.mark.parametrize("event", ["late", "other", "crash"])
def test_directory_compaction_beside_other_writers(spark, tmp_path, monkeypatch, event):
    path = f"file://{tmp_path}/t"
    rows = spark.range(200).withColumn("p", F.lit("a/b c%é"))
    rows.repartition(20).write.partitionBy("p").parquet(path)
    files = lambda: sorted(str(x) for x in tmp_path.rglob("p=*/*.parquet"))
    before, commit = files(), Snapshots.commit

    def meanwhile(self, base, *args, **facts):
        if event == "late":  # a writer that knows nothing of snapshots
            spark.range(200, 210).withColumn("p", F.lit("a/b c%é")).write.mode("append").partitionBy("p").parquet(path)
        elif event == "other":  # another compactor
            commit(self, base)
        else:
            raise MemoryError("the driver dies")
        return commit(self, base, *args, **facts)

    monkeypatch.setattr(Snapshots, "commit", meanwhile)
    if event == "late":
        compact_directory(spark, path, "p")
    else:
        with pytest.raises(ConflictError if event == "other" else MemoryError):
            compact_directory(spark, path, "p")
        assert sums(spark.read.parquet(path))[0] == 200 and (files() == before or event == "crash")
    monkeypatch.undo()
    n = 210 if event == "late" else 200
    assert sums(read_table(spark, path)) == (n, n * (n - 1) // 2, n)
    vacuum(spark, path)
    assert sums(read_table(spark, path)) == (n, n * (n - 1) // 2, n) and (files() == before or event == "late")


def test_files_are_as_many_as_planned(spark, tmp_path):
    """More files of one partition than there are shuffle partitions, one a task."""
    df = spark.range(6_000).select(F.lit("d").alias("folder"), F.concat(F.lit("f"), F.col("id") % 600).alias("file_path"), F.col("id").cast("int").alias("rec_no"), F.lit(10).cast("bigint").alias("n_bytes"))
    out = compact_records(df, f"file://{tmp_path}/t", "folder", "file_path", "n_bytes", None, ("rec_no",), Policy(target_bytes=1_000))
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < 60 == len(list(tmp_path.rglob("_data/gen=*/plan_folder=*/*.parquet")))
    assert sorted(r.rec_no for r in out.collect()) == list(range(6_000))
