import json

import pytest
from pyspark.sql import functions as F

from tunedata import dims
from tunedata.functions import chat
from tunedata.operators.chats import chat_pieces, count_chats
from tunedata.operators.detect import Detection, detect
from tunedata.operators.normalize import check_compatible, field_quality, is_compatible, normalize

RC = "array<struct<role:string,content:string>>"
FV = "array<struct<from:string,value:string>>"

SAMPLES = {
    "alpaca": ("instruction string, input string, output string", ("i", "", "o")),
    "sharegpt": ("conversations " + FV, ([("human", "h"), ("gpt", "g"), ("system", "s"), ("tool", "t")],)),
    "chatml": ("messages " + RC, ([("user", "u"), ("assistant", None)],)),
    "prompt_completion": ("prompt string, answer string", ("p", "a")),
    "preference": ("prompt string, chosen string, rejected string", ("p", "c", "r")),
    "kto": ("prompt string, completion string, label boolean", ("p", "c", True)),
    "grpo": ("prompt string", ("p",)),
    "text": ("text string", ("t",)),
    "embedding_pairs": ("anchor string, positive string", ("a", "b")),
    "audio_text": ("audio string, sentence string", ("c.wav", "s")),
    "vision_chat": ("images string, messages " + FV, ("a.png", [("human", "h"), ("bot", "b")])),
    "image_text": ("image string, text string", ("a.png", "t")),
}
ACCEPTED = {
    "sft": {"text", "alpaca", "sharegpt", "chatml", "prompt_completion"},
    "cpt": {"text", "image_text", "audio_text"},
    "dpo": {"preference"}, "orpo": {"preference"}, "simpo": {"preference"},
    "kto": {"kto"},
    "grpo": {"grpo", "prompt_completion", "kto", "preference"},
    "embedding": {"embedding_pairs"},
    "tts_sft": {"audio_text"}, "stt_sft": {"audio_text"},
    "ocr_sft": {"image_text"},
    "vlm_sft": {"vision_chat"},
}
EXPECTED = {
    ("sft", "alpaca"): {"text": "<|user|>\ni\n<|assistant|>\no\n"},
    ("sft", "sharegpt"): {"text": "<|user|>\nh\n<|assistant|>\ng\n<|system|>\ns\n<|user|>\nt\n"},
    ("sft", "chatml"): {"text": "<|user|>\nu\n<|assistant|>\nNone\n"},
    ("sft", "prompt_completion"): {"text": "<|user|>\np\n<|assistant|>\na\n"},
    ("dpo", "preference"): {"chosen": "c", "rejected": "r", "prompt": "p"},
    ("kto", "kto"): {"prompt": "p", "completion": "c", "label": True},
    ("embedding", "embedding_pairs"): {"anchor": "a", "positive": "b"},
    ("tts_sft", "audio_text"): {"audio": "c.wav", "text": "s"},
    ("cpt", "audio_text"): {"text": "s"},
    ("ocr_sft", "image_text"): {"image": "a.png", "text": "t"},
    ("vlm_sft", "vision_chat"): {
        "images": "a.png", "messages": [{"role": "user", "content": "h"}, {"role": "user", "content": "b"}],
    },
}


@pytest.fixture(scope="module")
def datasets(spark):
    found = {}
    for fmt, (ddl, row) in SAMPLES.items():
        df = spark.createDataFrame([row], ddl)
        found[fmt] = (df, detect(df))
        assert found[fmt][1].format == fmt
    return found


def test_compatibility_matrix(datasets):
    for task in dims.TASK_BY_ID:
        accepted = {fmt for fmt, (_, d) in datasets.items() if is_compatible(d, task)}
        assert accepted == ACCEPTED[task], task
        for fmt, (df, d) in datasets.items():
            if fmt not in accepted:
                with pytest.raises(ValueError):
                    normalize(df, d, task)


def test_normalized_rows(datasets):
    for (task, fmt), want in EXPECTED.items():
        df, found = datasets[fmt]
        assert normalize(df, found, task).first().asDict(recursive=True) == want, (task, fmt)


def test_declared_schema_is_what_normalize_yields(datasets):
    for task, spec in dims.TASK_BY_ID.items():
        for fmt in spec.detector_formats:
            df, found = datasets[fmt]
            assert set(normalize(df, found, task).columns) == set(spec.dataset_schema)


def test_errors():
    with pytest.raises(ValueError, match="raw text"):
        check_compatible(Detection("alpaca", 1, {"instruction": "i", "output": "o"}), "cpt")
    with pytest.raises(ValueError, match="Cannot build messages from format 'kto'"):
        check_compatible(Detection("kto", 1, {}), "sft")
    with pytest.raises(ValueError, match="Unknown task"):
        check_compatible(Detection("text", 1, {"text": "t"}), "nope")
    check_compatible(Detection("preference", 1, {"chosen": "c", "rejected": "r"}), "simpo")
    with pytest.raises(ValueError):
        check_compatible(Detection("preference", 1, {"chosen": "c", "rejected": "r"}), "grpo")


def test_alpaca_input_truthiness(spark):
    rows = [("i", None, "o"), ("i", "", "o"), ("i", "  ", "o"), ("i", "x", None)]
    df = spark.createDataFrame(rows, "instruction string, input string, output string")
    got = [r.text for r in normalize(df, Detection("alpaca", 1, {"instruction": "instruction", "input": "input", "output": "output"}), "sft").collect()]
    assert got == [
        "<|user|>\ni\n<|assistant|>\no\n", "<|user|>\ni\n<|assistant|>\no\n", "<|user|>\ni\n\n  \n<|assistant|>\no\n",
        "<|user|>\ni\n\nx\n<|assistant|>\nNone\n",
    ]


@pytest.mark.parametrize(
    "ddl,values,want",
    [("int", [0, 1, 2, None], [False, True, True, False]), ("string", ["", "0", None], [False, True, False]),
     ("double", [0.0, 0.5], [False, True]), ("boolean", [True, False, None], [True, False, False])],
)
def test_kto_label_truthiness(spark, ddl, values, want):
    df = spark.createDataFrame([(i, "p", "c", v) for i, v in enumerate(values)], f"i int, p string, c string, l {ddl}")
    found = Detection("kto", 1, {"prompt": "p", "completion": "c", "label": "l"})
    assert [r.label for r in normalize(df, found, "kto", keep=["i"]).orderBy("i").collect()] == want


def test_preference_without_prompt(spark):
    df = spark.createDataFrame([("a", "b")], "accepted string, bad string")
    assert normalize(df, detect(df), "dpo").first().asDict() == {"chosen": "a", "rejected": "b", "prompt": ""}


def test_headers_with_odd_characters(spark):
    df = spark.createDataFrame([("t", "c")], "talimat string, ` çıktı` string").withColumnRenamed("talimat", "Tali`mat.x")
    found = Detection("alpaca", 1, {"instruction": "Tali`mat.x", "output": " çıktı"})
    assert normalize(df, found, "sft").first().text == "<|user|>\nt\n<|assistant|>\nc\n"


def test_generic_render_of_nothing_and_of_values(spark):
    df = spark.createDataFrame([([],)], f"m {RC}")
    assert df.select(chat.render_generic(F.col("m"))).first()[0] == "\n"
    df = spark.createDataFrame([([("user", True), ("x", None)],)], "m array<struct<role:string,content:boolean>>")
    assert df.select(chat.render_generic(F.col("m"), df.schema["m"].dataType)).first()[0] == "<|user|>\nTrue\n<|x|>\nNone\n"


def test_vision_rows_decide_by_their_first_turn(spark):
    both = "array<struct<role:string,content:string,`from`:string,value:string>>"
    rows = [("a", [("user", "x", None, None)]), ("b", [(None, None, "gpt", "y")]), ("c", [])]
    df = spark.createDataFrame(rows, f"i string, m {both}")
    found = Detection("vision_chat", 0.9, {"images": "i", "messages": "m"})
    got = {r.images: [(m.role, m.content) for m in r.messages] for r in normalize(df, found, "vlm_sft").collect()}
    assert got == {"a": [("user", "x")], "b": [("assistant", "y")], "c": []}


def test_vision_turns_may_be_maps(spark):
    rows = [("a", [{"role": "user", "content": "x"}]), ("b", [{"from": "gpt", "value": "y"}]), ("c", [])]
    df = spark.createDataFrame(rows, "i string, m array<map<string,string>>")
    found = Detection("vision_chat", 0.9, {"images": "i", "messages": "m"})
    got = {r.images: [(m.role, m.content) for m in r.messages] for r in normalize(df, found, "vlm_sft").collect()}
    assert got == {"a": [("user", "x")], "b": [("assistant", "y")], "c": []}


# --- the Llama-3 layout -----------------------------------------------------------------------------

HEAD = "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
DATES = "Cutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n"


def turn(role, text):
    return f"<|start_header_id|>{role}<|end_header_id|>\n\n{text}<|eot_id|>"


def render(spark, messages, ddl=RC, **options):
    df = spark.createDataFrame([(messages,)], f"m {ddl}")
    renderer = chat.llama3(date_string="26 Jul 2024", **options)
    return df.select(chat.render_chat(F.col("m"), df.schema["m"].dataType, renderer)).first()[0]


def test_llama3_system_and_trimming(spark):
    got = render(spark, [("system", " be kind\n"), ("user", " hi\t"), ("assistant", "yo")])
    assert got == HEAD + DATES + "be kind<|eot_id|>" + turn("user", "hi") + turn("assistant", "yo")
    got = render(spark, [("user", "hi"), ("system", "late")], add_generation_prompt=True)
    assert got == HEAD + DATES + "<|eot_id|>" + turn("user", "hi") + turn("system", "late") + "<|start_header_id|>assistant<|end_header_id|>\n\n"


def test_llama3_falls_back_where_the_layout_fails(spark):
    assert render(spark, []) == "\n"
    assert render(spark, [(None, "x")]) == "<|None|>\nx\n"
    assert render(spark, [("system", "only")], tools=[{"name": "f"}]) == "<|system|>\nonly\n"


def test_llama3_tools(spark):
    tools = [{"name": "f", "parameters": {"é": 1}}]
    text = json.dumps(tools[0], indent=4, ensure_ascii=False) + "\n\n"
    got = render(spark, [("system", "s"), ("user", " q ")], tools=tools)
    assert got == HEAD + "Environment: ipython\n" + DATES + "s<|eot_id|>" + turn(
        "user", chat.TOOLS_IN_USER + chat.TOOLS_FORMAT + text + "q"
    )
    got = render(spark, [("user", "q")], tools=tools, tools_in_user_message=False)
    assert got == HEAD + "Environment: ipython\n" + DATES + chat.TOOLS_IN_SYSTEM + chat.TOOLS_FORMAT + text + "<|eot_id|>" + turn("user", "q")


def test_llama3_tool_calls_and_results(spark):
    ddl = (
        "array<struct<role:string,content:string,tool_calls:array<struct<function:struct<name:string,"
        "arguments:struct<q:string,n:int,l:array<double>,m:map<string,boolean>>>>>>>"
    )
    call = (("search", ('a"b', 2, [1.5], {"x": True})),)
    got = render(spark, [("user", "u", None), ("assistant", None, [call]), ("tool", 'r"1', None), ("ipython", None, None)], ddl)
    arguments = '{"q": "a\\"b", "n": 2, "l": [1.5], "m": {"x": true}}'
    assert got == HEAD + DATES + "<|eot_id|>" + turn("user", "u") + turn(
        "assistant", '{"name": "search", "parameters": ' + arguments + "}"
    ) + turn("ipython", '"r\\"1"') + turn("ipython", "None")
    assert render(spark, [("user", "u", None), ("assistant", "c", [call, call])], ddl) == "<|user|>\nu\n<|assistant|>\nc\n"


CHATS = {
    1: [("system", "s"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2")],
    2: [("user", "only")],
    3: [("system", " alone ")],
    4: [("user", "a"), ("tool", "b"), ("user", "c"), ("assistant", "d")],
    None: [("user", "x"), ("assistant", "y"), ("user", "z")],
    5: [("user", "a"), (None, "no role"), ("user", "c")],
}


def turns(spark):
    """Turn numbers start anywhere and skip: a first block may hold one turn only."""
    rows = [(k, 1 + 3 * k0 + i + (i > 1), r, t) for k0, (k, chat_) in enumerate(CHATS.items()) for i, (r, t) in enumerate(chat_)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


@pytest.mark.parametrize("size", [1, 2, 100])
def test_texts_of_pieces_join_to_the_whole(spark, size):
    pieces = chat_pieces(turns(spark), size=size)
    place, tools, date = chat.Place.of("place"), [{"name": "f"}], "26 Jul 2024"
    whole = spark.createDataFrame([(k, m) for k, m in CHATS.items()], f"conv_id long, messages {RC}")
    found = Detection("chatml", 0.95, {"messages": "messages"})
    question = F.lit("q?")

    def texts(df, place, keep):
        asked = None if place is None else place.with_question()
        return {
            "plain": normalize(df, found, "sft", None, keep),
            "llama3": normalize(df, found, "sft", chat.llama3(date_string=date, place=place), keep),
            "tools": normalize(df, found, "sft", chat.llama3(date_string=date, tools=tools, place=place), keep),
            "prompt": df.select(*keep, chat.build_prompt(F.col("messages"), question, chat.llama3(date_string=date, add_generation_prompt=True, place=asked), place).alias("text")),
            "bare": df.select(*keep, chat.build_prompt(F.col("messages"), question, place=place).alias("text")),
        }

    want = texts(whole, None, ["conv_id"])
    for name, df in texts(pieces, place, ["conv_id", "piece"]).items():
        joined = {}
        for r in sorted(df.collect(), key=lambda r: (repr(r.conv_id), r.piece)):
            joined[r.conv_id] = joined.get(r.conv_id, "") + r.text
        expected = {r.conv_id: r.text for r in want[name].collect()}
        if name == "prompt":  # a role that is null: the whole chat falls back
            assert joined[5] == expected[5] == "a\nno role\nc\nq?"
        assert joined == expected, name


def test_images_and_counts_go_by_chat(spark):
    pieces = chat_pieces(turns(spark), size=2)
    place = chat.Place.of("place")
    df = pieces.withColumn("image", F.when(place.starts, F.concat(F.lit("i"), F.coalesce(F.col("conv_id").cast("string"), F.lit("-")))))
    out = normalize(df, Detection("vision_chat", 0.9, {"images": "image", "messages": "messages"}), "vlm_sft", keep=["conv_id", "piece"])
    rows = sorted(out.collect(), key=lambda r: (repr(r.conv_id), r.piece))
    assert all((r.images is not None) == (r.piece == 0) for r in rows) and len(rows) > len(CHATS)
    for k, messages in CHATS.items():
        assert [(m.role, m.content) for r in rows if r.conv_id == k for m in r.messages] == messages
    assert pieces.agg(count_chats().alias("n")).first().n == len(CHATS)


def test_the_text_of_a_chat_moves_once(spark, tmp_path):
    turns(spark).write.parquet(str(tmp_path / "turns"))
    pieces = chat_pieces(spark.read.parquet(str(tmp_path / "turns")))
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning(_key" in x and "_block" not in x.split("),")[0]]
    assert len(moved) == 1  # the one-row-a-block side only


def test_prompt_building(spark):
    df = spark.createDataFrame([([("user", "a"), ("assistant", "b")],)], f"h {RC}")
    bare, full = df.select(
        chat.build_prompt(F.col("h"), F.lit("c")),
        chat.build_prompt(F.col("h"), F.lit("c"), chat.llama3(date_string="26 Jul 2024", add_generation_prompt=True)),
    ).first()
    assert bare == "a\nb\nc"
    assert full.endswith(turn("user", "c") + "<|start_header_id|>assistant<|end_header_id|>\n\n")


def test_field_quality(spark):
    df = spark.createDataFrame([("p", "c", True), ("", None, None)], "prompt string, completion string, label boolean")
    got = {r.field: (r.n_rows, r.n_null, r.n_empty) for r in field_quality(df, "kto").collect()}
    assert got == {"prompt": (2, 0, 1), "completion": (2, 1, 0), "label": (2, 1, 0)}
    with pytest.raises(ValueError):
        field_quality(df.drop("label"), "kto")


def test_projection_reaches_the_scan(spark, tmp_path):
    """Normalizing reads only the mapped columns and adds no shuffle and no Python."""
    path = str(tmp_path / "wide")
    spark.createDataFrame([("a", "b", "c", 1)], "instruction string, output string, junk string, n int").write.parquet(path)
    df = spark.read.parquet(path)
    out = normalize(df, detect(df), "sft")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "junk" not in plan and "Exchange" not in plan and "Python" not in plan
