from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata import dims, load_dataset
from tunedata.operators.detect import (
    column_shapes,
    detect,
    detect_columns,
    evidence,
    report,
    shape_census,
    tasks_for_format,
    with_label,
)

FV = "array<struct<from:string,value:string>>"
RC = "array<struct<role:string,content:string>>"
FV_ROW = [("human", "hi"), ("gpt", "yo")]
RC_ROW = [("user", "hi"), ("assistant", "yo")]

# (columns as DDL, row, rule, format, confidence)
CASES = [
    ("image string, conversations " + FV, ("a.PNG", FV_ROW), "vision_chat", 0.9),
    ("image string, messages " + RC, ("http://x/y", RC_ROW), "vision_chat", 0.6),
    ("images string, messages " + RC, ("a.png", RC_ROW), "vision_chat", 0.9),
    ("img string, text string", (None, "t"), "image_text", 0.85),
    ("picture string, body string", ("none", "t"), "image_text", 0.55),
    ("image string, text string", ("scan.png", "t"), "image_text", 0.85),
    ("image string, other string, n int", ("a.png", "x", 1), "unknown", 0.0),
    ("audio string, sentence string", ("clip1.wav", "t"), "audio_text", 0.9),
    ("path string, sentence string", ("x.csv", "t"), "unknown", 0.0),
    ("file struct<bytes:string>, caption string", (("b",), "t"), "audio_text", 0.9),
    ("dialogue " + FV, (FV_ROW,), "sharegpt", 0.95),
    ("turns " + RC, (RC_ROW,), "chatml", 0.95),
    ("messages array<map<string,string>>", ([{"role": "user", "content": "x"}],), "chatml", 0.95),
    ("messages string", ('[{"role": "user"}]',), "text", 0.5),
    ("messages " + RC, ([],), "unknown", 0.0),
    ("prompt string, chosen string, rejected string", ("a", "b", "c"), "preference", 0.95),
    ("accepted string, bad string", ("a", "b"), "preference", 0.75),
    ("prompt string, chosen string", ("a", "b"), "grpo", 0.6),
    ("prompt string, completion string, label boolean", ("a", "b", True), "kto", 0.9),
    ("prompt string, response string, score int", ("a", "b", 1), "kto", 0.9),
    ("prompt string, response string, score int", ("a", "b", None), "prompt_completion", 0.9),
    ("prompt string, response string, score string", ("a", "b", "1"), "prompt_completion", 0.9),
    ("instruction string, output string, score int", ("a", "b", 1), "kto", 0.9),
    ("instruction string, input string, output string", ("a", "b", "c"), "alpaca", 0.95),
    ("question string, answer string", ("a", "b"), "alpaca", 0.95),
    ("soru string, `bağlam` string, cevap string", ("a", "b", "c"), "alpaca", 0.95),
    ("prompt string, answer string", ("a", "b"), "prompt_completion", 0.9),
    ("istem string, `yanıt` string", ("a", "b"), "prompt_completion", 0.9),
    ("query string, document string", ("a", "b"), "embedding_pairs", 0.8),
    ("anchor string, positive string", ("a", "b"), "embedding_pairs", 0.8),
    ("sentence1 string, sentence2 string, label int", ("a", "b", 1), "embedding_pairs", 0.8),
    ("prompt string, text string", ("a", "b"), "grpo", 0.6),
    ("prompt string, text string, id int", ("a", "b", 1), "text", 0.85),
    ("document string, label int", ("a", 1), "text", 0.85),
    ("text string, label int", ("a", 1), "text", 0.85),
    ("foo string, n int", ("a", 1), "text", 0.5),
    ("foo string, bar string", ("a", "b"), "unknown", 0.0),
    ("`ÇIKTI` string, talimat string", ("a", "b"), "unknown", 0.0),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    """All cases detected in one job, as a catalog of one-row datasets."""
    samples = [
        column_shapes(spark.createDataFrame([row], ddl)).withColumn("dataset", F.lit(i))
        for i, (ddl, row, *_) in enumerate(CASES)
    ]
    return {r.dataset: r for r in detect_columns(reduce(DataFrame.unionByName, samples), ["dataset"]).collect()}


@pytest.mark.parametrize("case", range(len(CASES)), ids=[c[0] for c in CASES])
def test_rules(verdicts, case):
    _, _, fmt, confidence = CASES[case]
    found = verdicts[case]
    assert (found.format, found.confidence) == (fmt, confidence)
    assert found.suggested_tasks == [t.id for t in dims.TASKS if fmt in t.detector_formats]


def test_every_rule_has_a_case(verdicts):
    assert {v.rule for v in verdicts.values()} == {f"R{i}" for i in range(1, 16)}


def test_detect_one_dataset(spark):
    found = detect(spark.createDataFrame([(FV_ROW,)], "dialogue " + FV))
    assert (found.format, found.confidence, found.mapping) == ("sharegpt", 0.95, {"conversations": "dialogue"})
    assert found.label == dims.FORMAT_LABELS["sharegpt"] and not found.needs_review


def test_messy_headers_keep_their_spaces(spark):
    df = spark.createDataFrame([("0", "t", "g", "c")], "`Unnamed: 0` string, talimat string, ` giriş` string, ` çıktı` string")
    found = detect(df)
    assert found.format == "alpaca"
    assert found.mapping == {"instruction": "talimat", "input": " giriş", "output": " çıktı"}
    assert "sft" in found.suggested_tasks
    assert report(found)["tasks"] == [dims.TASK_BY_ID["sft"].label]


def test_empty_and_unknown_notes(spark):
    empty = detect(spark.createDataFrame([], "text string"))
    assert (empty.format, empty.confidence, empty.notes) == ("unknown", 0.0, ["Dataset is empty."])
    unknown = detect(spark.createDataFrame([("a", "b")], "foo string, bar string"))
    assert unknown.notes == ["Could not classify columns: ['foo', 'bar']. Map fields manually."]
    single = detect(spark.createDataFrame([("a", 1)], "foo string, n int"))
    assert single.notes == ["Single text column `foo` assumed to be raw text."]


def test_sample_is_the_first_row_by_order(spark):
    rows = [(2, "a", "b", "yes"), (1, "a", "b", None)]
    df = spark.createDataFrame(rows, "id int, image string, text string, x string")
    assert detect(df.select("id", F.col("x").alias("img"), "text"), order_by=["id"]).confidence == 0.85
    assert detect(df.select("id", F.col("x").alias("img"), "text"), order_by=[F.col("id").desc()]).confidence == 0.55


def test_overrides_win(spark):
    df = spark.createDataFrame([("a", "b")], "foo string, bar string")
    found = detect(df, overrides={"instruction": "bar", "output": "foo"})
    assert found.format == "alpaca" and found.mapping == {"instruction": "bar", "output": "foo"}
    with pytest.raises(ValueError):
        detect(df, overrides={"instruction": "baz"})


@pytest.mark.parametrize(
    ("columns", "overrides", "expected"),
    [
        ("text string, content string", {"image": "text"}, ("image_text", {"image": "text", "text": "content"})),
        ("text string, content string, body string", {"image": "text", "label": "content"}, ("image_text", {"image": "text", "text": "content"})),
        ("text string, n int", {"image": "text"}, ("text", {"text": "text"})),
        ("foo string, n int", {"image": "n"}, ("text", {"text": "foo"})),
        ("img string, body string", {"text": "img"}, ("image_text", {"image": "img", "text": "body"})),
        ("clip struct<a:int>, sentence string, caption string", {"audio": "clip", "transcription": "caption"}, ("audio_text", {"audio": "clip", "text": "caption"})),
        ("input string, context string, output string", {"instruction": "input"}, ("alpaca", {"instruction": "input", "output": "output", "input": "context"})),
        ("question string, output string, context string", {"input": "question"}, ("alpaca", {"instruction": "question", "output": "output", "input": "context"})),
    ],
)
def test_fields_set_by_hand_leave_the_next_best(spark, columns, overrides, expected):
    df = spark.createDataFrame([tuple((1,) if "struct" in c else 1 if c.endswith(" int") else "a" for c in columns.split(", "))], columns)
    found = detect(df, overrides=overrides)
    assert (found.format, found.mapping) == expected


def test_many_datasets_at_once_with_a_wide_one(spark):
    """A dataset with most of the column rows is aggregated, not gathered."""
    wide = [("w", i, f"c{i}", "string") for i in range(20_000)] + [("w", 20_000, "Text ", "string"), ("w", 20_001, "TEXT", "string")]
    rows = wide + [("p", 0, "prompt", "string"), ("e", 0, "anchor", "string"), ("e", 1, "positive", "null")]
    df = spark.createDataFrame(rows, "dataset string, pos int, column string, shape string")
    got = {r.dataset: r for r in detect_columns(df, ["dataset"]).collect()}
    assert got["w"].format == "text" and got["w"].mapping == {"text": "TEXT"}  # the last of equal headers
    assert got["p"].format == "grpo" and got["e"].format == "embedding_pairs"


def test_exclusion_guards_cannot_hide_another_candidate():
    """The rules compare picked columns, which is exact as long as these word sets are disjoint."""
    s = {k: set(v) for k, v in dims.SYNONYMS.items()}
    assert not s["image"] & s["text"] and not s["audio"] & s["transcription"]
    assert not s["input"] & (s["instruction"] | s["output"])


def test_tasks_and_labels_by_join(spark):
    df = spark.createDataFrame([("a", "preference"), ("b", "nope")], "id string, format string")
    tasks = tasks_for_format(df).orderBy("position").collect()
    assert [r.task for r in tasks] == ["dpo", "orpo", "simpo"]
    labels = {r.id: r.format_label for r in with_label(df).collect()}
    assert labels == {"a": dims.FORMAT_LABELS["preference"], "b": "nope"}


def test_evidence_counts_every_row(spark):
    rows = [("a.png", [("user", "x")], 1), ("b", [], None), (None, None, 0), ("c.wav", [("user", "y")], 2)]
    got = {(r.column, r.test): r.share for r in evidence(spark.createDataFrame(rows, f"image string, messages {RC}, label int")).collect()}
    assert got["image", "media"] == 0.5 and got["image", "string"] == 0.75 and got["image", "audio"] == 0.25
    assert got["messages", "role_content_turns"] == 0.5 and got["label", "flag"] == 0.75 and got["label", "null"] == 0.25


def test_census_of_ragged_rows(spark):
    lines = [
        '{"prompt": "a", "response": "b", "score": null}',
        '{"score": 1, "response": "b", "prompt": "c"}',
        '{"Messages": [{"role": "user", "content": "x"}]}',
        '{"messages": [{"from": "user", "value": "x"}]}',
        "",
        "not json",
        "{}",
        '{"image": {"a": 1}, "text": "t"}',
        '{"n": 1.5, "flag": true, "only": "s"}',
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "row_id long, value string")
    got = {r.key_set: r for r in shape_census(df).collect()}
    pair = got['["prompt","response","score"]']
    assert (pair.n_rows, pair.first_row, pair.format) == (2, 0, "prompt_completion")  # row 0 has a null label
    assert got['["Messages"]'].format == "chatml" and got['["messages"]'].format == "sharegpt"
    assert got['["image","text"]'].confidence == 0.85
    assert got['["flag","n","only"]'].mapping == {"text": "only"}
    assert got["[]"].format == "unknown"
    assert got[None].format == "malformed" and got[None].first_row == 5


def test_parquet_chats_are_recognised(spark, tmp_path):
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame([(RC_ROW,)], f"messages {RC}").write.parquet(path)
    assert detect(load_dataset(spark, path)).format == "chatml"


def test_variant_and_typed_shapes_agree(spark):
    from tunedata.functions.shapes import shape_of, variant_shape

    rows = ['{"v":"a.jpeg"}', '{"v":"x"}', '{"v":1}', '{"v":true}', '{"v":1.5}', '{"v":{"a":1}}', '{"v":[]}', '{"v":null}',
            '{"v":[{"from":"a","value":"b"}]}', '{"v":[{"role":"a","content":"b"}]}', '{"v":["a"]}', '{"v":"s.OGG"}']
    types = ["string", "string", "int", "boolean", "double", "struct<a:int>", RC, "string", FV, RC, "array<string>", "string"]
    for text, ddl in zip(rows, types, strict=True):
        df = spark.createDataFrame([(text,)], "t string")
        typed = F.from_json("t", f"v {ddl}")["v"]
        untyped = F.from_json("t", "map<string,variant>")["v"]
        a, b = df.select(shape_of(typed, T._parse_datatype_string(f"v {ddl}")[0].dataType), variant_shape(untyped)).first()
        assert a == b, text
