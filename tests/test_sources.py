import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tunedata import detect, load_dataset
from tunedata.operators import configs as R
from tunedata.sources import files, ranges, recipes
from tunedata.sources.history import append_history, read_history
from tunedata.sources.session import case_sensitive, scratch_dir


def write(path, text):
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_jsonl_skips_blank_lines_and_keeps_unicode(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"soru":"ğ","cevap":"ı"}\n\n   \n{"soru":"b","cevap":"c"}\n')
    df = load_dataset(spark, path)
    assert rows(df) == [{"cevap": "ı", "soru": "ğ"}, {"cevap": "c", "soru": "b"}]
    assert detect(df).format == "alpaca"


def test_malformed_jsonl(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"a":1}\n{"a":\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        load_dataset(spark, path).collect()
    kept = load_dataset(spark, path, mode="PERMISSIVE", schema="a int, _corrupt_record string")
    assert [r["_corrupt_record"] for r in rows(kept)] == [None, '{"a":']


def test_keys_that_differ_by_case(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"Text":"x"}\n{"text":"y"}\n')
    assert sorted(load_dataset(spark, path).columns) == ["Text", "text"]
    with case_sensitive(spark):
        assert len(rows(load_dataset(spark, path))) == 2
    assert spark.conf.get("spark.sql.caseSensitive") == "false"


def test_json_layouts(spark, tmp_path):
    bare = write(tmp_path / "a.json", '[{"a":1},\n {"a":2}]')
    wrapped = write(tmp_path / "b.json", '{"zeta":{},"rows":[{"a":1},{"a":2}],"data":[{"b":9}]}')
    assert rows(load_dataset(spark, bare)) == rows(load_dataset(spark, wrapped)) == [{"a": 1}, {"a": 2}]
    for i, text in enumerate(['{"a":1}', "3", '"x"']):
        with pytest.raises(ValueError, match="list of records"):
            load_dataset(spark, write(tmp_path / f"bad{i}.json", text))


def test_delimited_quirks(spark, tmp_path):
    text = '"Ad, soyad", çıktı\n"say ""hi""","two\nlines"\n,""\nshort\n'
    got = rows(load_dataset(spark, write(tmp_path / "a.csv", text)))
    assert got == [
        {"Ad, soyad": 'say "hi"', " çıktı": "two\nlines"}, {"Ad, soyad": "", " çıktı": ""}, {"Ad, soyad": "short", " çıktı": ""},
    ]
    tsv = load_dataset(spark, write(tmp_path / "a.TSV", "prompt\tresponse\tlabel\na,b\tc\t1\n"))
    assert rows(tsv) == [{"prompt": "a,b", "response": "c", "label": "1"}]
    assert detect(tsv).format == "prompt_completion"  # cells are text, so never binary feedback


def test_dispatch_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported dataset format"):
        load_dataset(spark, str(tmp_path / "a.txt"))
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        load_dataset(spark, str(tmp_path / "none.jsonl"))


@pytest.mark.parametrize("cap,expected", [(None, 50), (0, 50), (1, 1), (7, 7), (500, 50)])
def test_caps(spark, tmp_path, cap, expected):
    path = write(tmp_path / "a.jsonl", "".join(f'{{"a":{i}}}\n' for i in range(50)))
    got = sorted(r["a"] for r in rows(load_dataset(spark, path, max_rows=cap)))
    assert got == list(range(expected))
    with pytest.raises(ValueError):
        load_dataset(spark, path, max_rows=-1)


@pytest.mark.parametrize("cap", [1, 9, 10, 11, 35, 40, 99])
def test_large_caps_keep_scan_partitions(spark, cap):
    df = spark.range(0, 40, 1, 4).withColumn("x", F.col("id") * 2)
    got = files.cap_rows(df, cap)
    assert [r.id for r in got.collect()] == list(range(min(cap, 40)))
    assert "SortMergeJoin [_part" not in got._jdf.queryExecution().executedPlan().toString()  # rows stay where they are


def test_splits_prune_partitions(spark, tmp_path):
    root = str(tmp_path)
    files.save_split(spark.range(3).toDF("a"), root, "org/ds")
    files.save_split(spark.range(5).toDF("a"), root, "org/ds", "test", "big")
    assert files.load_split(spark, root, "org/ds").count() == 3
    big = files.load_split(spark, root, "org/ds", "test", "big")
    assert big.count() == 5 and big.columns == ["a"]
    assert all("/config=big/split=test/" in f for f in big.inputFiles())
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        files.load_split(spark, root, "org/ds", "validation")


def test_training_set_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", "b")], "anchor string, positive string")
    for fmt in ("parquet", "json"):
        target = files.write_training_set(df, str(tmp_path / fmt), "embedding", fmt)
        assert target.endswith("task=embedding") and rows(spark.read.format(fmt).load(target)) == rows(df)
    with pytest.raises(ValueError):
        files.write_training_set(df, str(tmp_path), "embedding", "xml")


def test_several_files_first_row_is_of_the_first_file(spark, tmp_path):
    write(tmp_path / "b.jsonl", '{"image":"plain","text":"t"}\n')
    write(tmp_path / "a.jsonl", '{"image":"x.png","text":"t"}\n')
    df = load_dataset(spark, str(tmp_path), "jsonl")
    assert detect(df).confidence == 0.85
    with pytest.raises(ValueError, match="order_by"):
        detect(df.groupBy("image", "text").count())


RECIPE = """
recipe_version: 1
dataset: {source: org/dataset, local: false}
run:
  task: dpo
  learning_rate: 1.0e-5
  extra: {beta: 0.2}
  num_train_epochs: null
  no_such_field: 3
"""


def test_recipe_files(spark, tmp_path):
    write(tmp_path / "b.yaml", RECIPE)
    write(tmp_path / "a.yaml", "run: {task: kto, max_steps: 7}\n")
    got = {r.path.rsplit("/")[-1]: r for r in recipes.load_recipes(spark, str(tmp_path)).collect()}
    b = got["b.yaml"]
    assert (b.run.task, b.run.learning_rate, b.run.extra, b.source, b.is_local) == ("dpo", 1e-5, {"beta": "0.2"}, "org/dataset", False)
    a = got["a.yaml"]
    assert (a.run.max_steps, a.run.learning_rate, a.run.target_modules, a.source) == (7, 2e-4, ["q_proj", "k_proj", "v_proj", "o_proj"], "")
    assert [r.path.rsplit("/")[-1] for r in recipes.list_recipes(spark, str(tmp_path)).collect()] == ["a.yaml", "b.yaml"]
    assert recipes.list_recipes(spark, str(tmp_path / "none")).count() == 0


def test_documents_that_are_no_recipes(spark):
    df = spark.createDataFrame([("dataset: {}",), ("- 1",), ("a: [",), ("run: {task: sft}",)], "value string")
    with pytest.raises(Exception, match="missing `run`"):
        recipes.parse_recipes(df).collect()
    assert recipes.parse_recipes(df, strict=False).count() == 1


def test_recipe_round_trip(spark, tmp_path):
    runs = R.parse_configs(spark.createDataFrame([('{"task":"dpo","extra":{"beta":"0.2"}}',)], "config string")).select(
        F.lit(" my dpo run ").alias("name"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("saved_at"), "run",
        F.lit("org/x").alias("source"), F.lit(True).alias("is_local"),
    )
    unnamed = runs.withColumn("name", F.lit("  "))
    table = recipes.save_recipes(runs.union(unnamed), str(tmp_path / "r"))
    assert sorted(r.slug for r in table.collect()) == ["dpo-20240102-030405", "my-dpo-run"]
    back = recipes.parse_recipes(table, "document").first()
    assert back.run == runs.first().run and (back.source, back.is_local) == ("org/x", True)


def test_history_keeps_the_latest(spark, tmp_path):
    df = spark.createDataFrame([(1, "running"), (2, "running")], "job_id long, status string")
    append_history(df, str(tmp_path), F.lit("2024-01-01").cast("timestamp"))
    append_history(df.limit(1).withColumn("status", F.lit("finished")), str(tmp_path), F.lit("2024-01-02").cast("timestamp"))
    assert {r.job_id: r.status for r in read_history(spark, str(tmp_path)).collect()} == {1: "finished", 2: "running"}


def test_scratch_folders_are_new_and_leave_the_settings(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark, "x")
    assert path != scratch_dir(spark, "x") and "/tunedata-x-" in path
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def test_a_cluster_must_name_a_shared_folder():
    class Elsewhere:
        master = "local-cluster[3,2,1000]"

        def get(self, name, default=None):
            return default

        def getConf(self):
            return self

    session = Elsewhere()
    session.conf = session.sparkContext = session
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session, "x")


# --- run configurations -------------------------------------------------------------------------------


def args_of(spark, **run):
    df = R.parse_configs(spark.createDataFrame([(json.dumps(run),)], "config string"))
    got = R.build_trainer_args(df).collect()
    return got[0].args if got else None


def test_trainer_args(spark):
    args = args_of(spark, task="sft", num_train_epochs=3)
    assert "max_steps" not in args and float(args["num_train_epochs"]) == 3 and "gradient_checkpointing" not in args
    args = args_of(spark, task="sft", max_steps=50, num_train_epochs=0, gradient_checkpointing=True)
    assert args["max_steps"] == "50" and "num_train_epochs" not in args and args["gradient_checkpointing"] == "true"
    assert args_of(spark, task="dpo")["beta"] == "0.1"
    assert args_of(spark, task="dpo", extra={"beta": "0.3", "x": "y"})["beta"] == "0.3"
    # a task default overrides the run's own value
    assert float(args_of(spark, task="ocr_sft", learning_rate=1e-3)["learning_rate"]) == 5e-5
    with pytest.raises(Exception, match="Unknown task: no_such_task"):
        args_of(spark, task="no_such_task")


def test_only_accepted(spark):
    df = spark.sql("SELECT map('a', '1', 'b', '2') AS m, array('b') AS some, cast(NULL AS array<string>) AS any")
    some, everything = df.select(R.only_accepted(F.col("m"), F.col("some")), R.only_accepted(F.col("m"), F.col("any"))).first()
    assert some == {"b": "2"} and everything == {"a": "1", "b": "2"}


def test_form(spark):
    runs = R.parse_configs(spark.createDataFrame([('{"task":"dpo","extra":{"keep":"no"},"lora_r":8}',), ('{"task":"simpo"}',)], "config string"))
    form = F.struct(
        F.lit("o").alias("output_dir"), F.lit(3.9).alias("batch_size"), F.lit("4").alias("grad_accum"), F.lit("1e-4").alias("lr"),
        F.lit(10).alias("max_steps"), F.lit(0).alias("epochs"), F.lit(5).alias("warmup"), F.lit(1).alias("grad_ckpt"),
        F.lit(42.0).alias("seed"), F.lit(0.25).alias("beta"),
    )
    dpo, simpo = (r.run for r in runs.select(R.from_form(F.col("run"), form).alias("run")).collect())
    assert (dpo.batch_size, dpo.num_train_epochs, dpo.gradient_checkpointing, dpo.lora_r) == (3, None, True, 8)
    assert dpo.extra == {"beta": "0.25"} and simpo.extra == {}


def test_sweep(spark):
    runs = R.parse_configs(spark.createDataFrame([('{"task":"sft"}',)], "config string"))
    got = R.sweep(runs, {"learning_rate": [1e-4, 2e-4], "lora_r": [8, 16]}).orderBy("variant").collect()
    assert [(r.variant, r.run.learning_rate, r.run.lora_r) for r in got] == [(0, 1e-4, 8), (1, 1e-4, 16), (2, 2e-4, 8), (3, 2e-4, 16)]
    with pytest.raises(ValueError):
        R.sweep(runs, {"nope": [1]})


def test_log_files_keep_line_order_across_splits(spark, tmp_path):
    from tunedata.operators import logs as L
    from tunedata.sources.logs import load_logs

    texts = {name: [f"{name} line {i}: loss 1.{i}" if i % 3 else "" for i in range(n)] for name, n in (("a", 400), ("b.x", 7))}
    for name, lines in texts.items():
        write(tmp_path / f"{name}.log", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = load_logs(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = {}
        for r in df.orderBy("job_id", "seq").collect():
            got.setdefault(r.job_id, []).append(r.line)
        assert got == texts
        tails = {r.job_id: r.tail for r in L.log_tail(df, 3).collect()}
        assert tails == {k: "\n".join(v[-3:]) for k, v in texts.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_config_values(spark):
    def parse(text):
        return R.parse_configs(spark.createDataFrame([(text,)], "config string")).first().run

    run = parse('{"learning_rate":"1e-4","batch_size":4,"load_in_4bit":false,"extra":{"beta":0.1},"unknown":[1]}')
    assert (run.learning_rate, run.batch_size, run.load_in_4bit, run.extra) == (1e-4, 4, False, {"beta": "0.1"})
    assert (run.task, run.max_steps, run.num_train_epochs, run.use_lora) == ("sft", 100, None, True)
    with pytest.raises(Exception, match="Bad value for batch_size: many"):
        parse('{"batch_size":"many"}')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        parse('{"batch_size":')


@pytest.mark.parametrize("n", [1, 9, 10, 35, 99, 100, 500])
def test_a_cap_takes_the_first_rows_in_the_order_of_the_partitions(spark, n):
    df = spark.range(0, 100, 1, 7).where("id % 3 <> 1")  # a partition keeps its place when rows are filtered
    want = [r.id for r in df.collect()][:n]
    got = files.cap_rows(df, n)
    assert sorted(r.id for r in got.collect()) == sorted(want)


def test_a_cap_keeps_all_columns(spark):
    df = spark.createDataFrame([(1, "a", [1]), (2, None, None)], "_part int, `a.b` string, x array<int>")
    got = files.cap_rows(df.coalesce(1), 1)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, "a", [1])]


@pytest.mark.parametrize(("separator", "end"), [(",", "\n"), ("\t", "\n"), (",", "\r\n")])
def test_byte_ranges_of_quoted_files_equal_the_whole(spark, tmp_path, separator, end):
    rng = random.Random(12)

    def cell():
        text = "".join(rng.choices(["a", "b", " ", '"', "\n", separator, "é", "\n\n", '""'], k=rng.randint(0, 9)))
        return '"' + text.replace('"', '""') + '"' if rng.random() < 0.5 or set(text) & set('"\n' + separator) or text != text.strip() else text

    for n in range(3):
        rows = [separator.join(cell() or "x" for _ in range(3)) for _ in range(rng.choice([0, 1, 200]))]
        rows = [*rows, '"' + "line\n" * 400 + '"' + separator + "1" + separator + "2"]  # longer than several blocks
        (tmp_path / f"{n}.csv").write_bytes(end.join([separator.join(["n a", "b", "c"]), *rows, ""]).encode())
    path = str(tmp_path)
    whole = files.read_delimited(spark, path, separator)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        records = ranges.csv_records(spark, path, span=3)
        assert records.where("is_first").count() == 3
        got = ranges.read_delimited_ranges(spark, path, separator, whole.columns, span=3)
        assert got.columns == whole.columns
        found = sorted(tuple(x or "" for x in r) for r in got.collect())
        assert spark.read.text(path, lineSep="\n").rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == sorted(tuple(r) for r in whole.collect())


def test_an_empty_wrapped_list_has_no_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version": 1, "data": []}')
    df = load_dataset(spark, str(tmp_path / "a.json"))
    assert df.count() == 0 and df.columns == [] and detect(df).format == "unknown"
    (tmp_path / "b.json").write_text('{"data": [1, 2]}')
    with pytest.raises(ValueError, match="list of records"):
        load_dataset(spark, str(tmp_path / "b.json"))
