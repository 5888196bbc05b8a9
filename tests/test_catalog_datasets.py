import hashlib
import random
import re

from pyspark.sql import functions as F

from tunedata.operators import catalog as C
from tunedata.operators import datasets as D


def catalog(spark):
    rows = [("org/Red-1", 5, ["mlx"]), ("org/red-2", 9, []), ("org/red-3", 9, ["mlx", "x"]), ("org/blue", 99, ["mlx"])]
    return spark.createDataFrame(rows, "id string, downloads long, tags array<string>")


def ids(df):
    return [r.id for r in df.collect()]


def test_search(spark):
    c = catalog(spark)
    assert ids(C.search_datasets(c, "RED")) == ["org/red-2", "org/red-3", "org/Red-1"]
    assert ids(C.search_datasets(c, "red", limit=1)) == ["org/red-2"]
    assert ids(C.search_datasets(c, "  ")) == []
    assert ids(C.search_models(c, "red", "mlx")) == ["org/red-3", "org/Red-1"]
    assert ids(C.search_models(c, "red", "none")) == ["org/red-2", "org/red-3", "org/Red-1"]
    assert ids(C.search_models(c, "red", None)) == ["org/red-2", "org/red-3", "org/Red-1"]
    assert ids(C.search_models(c, "", "mlx")) == []


def test_search_is_one_top_k_pass(spark):
    plan = C.search_models(catalog(spark), "red", "mlx")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and plan.count("Scan") == 1


def test_artifacts(spark):
    full = [("a", f) for f in C.RELEASE_FILES] + [("a", f"adapters/{i:07d}_adapters.safetensors") for i in range(21)]
    part = [("b", f) for f in C.RELEASE_FILES[1:]] + [("b", "adapters/1.safetensors")] * 30
    df = spark.createDataFrame(full + part + [("c", "x/config.json")], "artifact string, path string")
    got = {r.artifact: (r.missing, r.n_checkpoints, r.complete) for r in C.artifact_status(df).collect()}
    assert got["a"] == ([], 21, True)
    assert got["b"] == (["model.safetensors"], 1, False)  # a file listed 30 times is one file
    assert got["c"][2] is False
    assert {r.artifact: r.is_model for r in C.valid_models(df).collect()} == {"a": True, "b": True, "c": False}


def test_preview(spark):
    df = spark.createDataFrame([(i, "é" * 400, None, [1, 2]) for i in range(20)], "i int, s string, n string, a array<int>")
    got = D.preview(df, order_by=["i"]).collect()
    assert len(got) == 8 and got[0].i == 0 and got[0].s == "é" * 300 and got[0].n == "None" and got[0].a == "[1,2]"


def test_ingest(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    n, preview, found = D.ingest(df, order_by=["id"])
    assert n == 1 and preview.count() == 1 and found.format == "text"


def test_split_is_stable_and_keeps_copies_together(spark):
    df = spark.range(2000).withColumn("k", (F.col("id") % 1000).cast("string"))
    split = D.train_validation_split(df, "k", 10)
    per_key = split.groupBy("k").agg(F.countDistinct("split").alias("n"))
    assert per_key.where("n > 1").count() == 0
    held = {r.k for r in split.where("split = 'validation'").collect()}
    assert held == {str(k) for k in range(1000) if int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 100 < 10}


def test_histogram_reads_whole_texts(spark):
    texts = ["", "a", "a b " * 60, " x\n" * 100, "w " * 250]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.bucket_start: r.n_rows for r in D.length_histogram(df, "text", 100).collect()}
    want = {}
    for t in texts:
        b = len(re.findall(r"\S+", t)) // 100 * 100
        want[b] = want.get(b, 0) + 1
    assert got == want


def test_duplicates_combine_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("t"))
    dups = D.duplicate_groups(df, "t", "id")
    r = dups.collect()
    assert [(x.first_id, x.copies, x.text_sha256) for x in r] == [(0, 334, hashlib.sha256(b"hot").hexdigest())]
    plan = dups._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "SortAggregate" not in plan


def test_pairs(spark):
    df = spark.createDataFrame([(1, "a", ["p", "q"], ["n"]), (2, "b", [], [])], "id int, anchor string, pos array<string>, neg array<string>")
    got = [tuple(r) for r in D.expand_pairs(df, "anchor", "pos", "neg", ["id"]).collect()]
    assert got == [(1, "a", "p", "n"), (1, "a", "q", None)]
    assert D.expand_pairs(df, "anchor", "pos").count() == 2


def test_every_labelled_text_of_a_key_with_both_sides_is_paired(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", None, "only good"]), f"t{i}", rng.choice([1, 0, 0, None])) for i in range(200)]
    rows = [(i, k, t, 1 if k == "only good" else q) for i, k, t, q in rows] + [(500, "one", "x", 1), *[(600 + i, "one", f"y{i}", 0) for i in range(50)]]
    df = spark.createDataFrame(rows, "id long, k string, text string, q int").repartition(4)
    got = D.preference_pairs(df, ["k"], "id", "text", F.col("q") == 1).collect()
    want = []
    for key in ("a", None, "one"):
        good = sorted(i for i, k, _, q in rows if k == key and q == 1)
        bad = sorted(i for i, k, _, q in rows if k == key and q == 0)
        want += [(key, n, good[n % len(good)], bad[n % len(bad)]) for n in range(max(len(good), len(bad)))]
    assert sorted(((r.k, r.pair, r.chosen_id, r.rejected_id) for r in got), key=repr) == sorted(want, key=repr)
    text = {i: t for i, _, t, _ in rows}
    assert all(r.chosen == text[r.chosen_id] and r.rejected == text[r.rejected_id] for r in got)
