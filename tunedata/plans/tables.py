"""Adapters: the driver's tables shaped as datasets, logs, runs, catalogs and manifests.

Every adapter reads its whole table. Groups are keyed finely enough that no key of the table
decides the size of a group: turns meet by (conversation, block of turns), replies meet their
question by (conversation, turn).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata import dims
from tunedata.functions.text import div
from tunedata.operators.chats import TURNS_PER_PIECE, chat_pieces
from tunedata.operators.datasets import preference_pairs

AS_OF = "2025-01-01 00:00:00"

# Header layouts for catalog detection: (header, sample), a sample being a string value or the
# shape code of some other value. Dataset i has layout i mod their number.
TEXT_SAMPLE, IMAGE_SAMPLE, AUDIO_SAMPLE, LINK_SAMPLE = "t:plain words", "t:scan.PNG", "t:clip.wav", "t:http://host/x"
LAYOUTS: tuple[tuple[tuple[str, str], ...], ...] = (
    (("image", IMAGE_SAMPLE), ("conversations", "from_value_turns")),
    (("image", LINK_SAMPLE), ("messages", "role_content_turns")),
    (("img", "null"), ("text", TEXT_SAMPLE)),
    (("picture", TEXT_SAMPLE), ("body", TEXT_SAMPLE)),
    (("image", IMAGE_SAMPLE), ("other", TEXT_SAMPLE), ("n", "int")),
    (("path", TEXT_SAMPLE), ("sentence", TEXT_SAMPLE)),
    (("audio", AUDIO_SAMPLE), ("sentence", TEXT_SAMPLE)),
    (("file", "object"), ("caption", TEXT_SAMPLE)),
    (("dialogue", "from_value_turns"),),
    (("turns", "role_content_turns"),),
    (("messages", TEXT_SAMPLE),),
    (("messages", "list"),),
    (("prompt", TEXT_SAMPLE), ("chosen", TEXT_SAMPLE), ("rejected", TEXT_SAMPLE)),
    (("accepted", TEXT_SAMPLE), ("bad", TEXT_SAMPLE)),
    (("prompt", TEXT_SAMPLE), ("chosen", TEXT_SAMPLE)),
    (("prompt", TEXT_SAMPLE), ("response", TEXT_SAMPLE), ("score", "int")),
    (("prompt", TEXT_SAMPLE), ("response", TEXT_SAMPLE), ("score", TEXT_SAMPLE)),
    (("instruction", TEXT_SAMPLE), ("output", TEXT_SAMPLE), ("score", "bool")),
    (("soru", TEXT_SAMPLE), ("bağlam", TEXT_SAMPLE), ("cevap", TEXT_SAMPLE)),
    (("istem", TEXT_SAMPLE), ("yanıt", TEXT_SAMPLE)),
    (("query", TEXT_SAMPLE), ("document", TEXT_SAMPLE)),
    (("sentence1", TEXT_SAMPLE), ("sentence2", TEXT_SAMPLE), ("label", "int")),
    (("prompt", TEXT_SAMPLE), ("text", TEXT_SAMPLE)),
    (("prompt", TEXT_SAMPLE), ("text", TEXT_SAMPLE), ("id", "int")),
    (("document", TEXT_SAMPLE), ("label", "int")),
    (("foo", TEXT_SAMPLE), ("n", "number")),
    (("foo", TEXT_SAMPLE), ("bar", TEXT_SAMPLE)),
    (("Unnamed: 0", TEXT_SAMPLE), ("talimat", TEXT_SAMPLE), (" giriş", TEXT_SAMPLE), (" çıktı", TEXT_SAMPLE)),
    (("Text", TEXT_SAMPLE), (" TEXT ", "null"), ("x", "int")),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- chats ---------------------------------------------------------------------------------


def chats(spark: SparkSession, sf_dir: str, size: int = TURNS_PER_PIECE) -> DataFrame:
    """(conv_id, piece, place, messages): role/content turns in order."""
    return chat_pieces(table(spark, sf_dir, "conversations"), size=size)


def sharegpt_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, piece, place, conversations): the same as from/value turns; system turns come from a `tool`."""
    speaker = F.create_map(*map(F.lit, ("user", "human", "assistant", "gpt", "system", "tool")))
    turns = F.transform(
        "messages", lambda m: F.struct(F.element_at(speaker, m["role"]).alias("from"), m["content"].alias("value"))
    )
    return chats(spark, sf_dir).select("conv_id", "piece", "place", turns.alias("conversations"))


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, instruction, input, output): a user turn, the reply that follows it, and
    the system text right before it, if any. One shuffle on (conversation, turn of the question)."""
    turns = table(spark, sf_dir, "conversations")
    asked_at = (
        F.when(F.col("role") == "user", F.col("turn"))
        .when(F.col("role") == "assistant", F.col("turn") - 1)
        .otherwise(F.col("turn") + 1)
    )

    def of(role: str):
        return F.max(F.when(F.col("role") == role, F.col("text")))

    met = turns.groupBy("conv_id", asked_at.alias("turn")).agg(
        of("user").alias("instruction"),
        F.coalesce(of("system"), F.lit("")).alias("input"),
        of("assistant").alias("output"),
    )
    return met.where(F.col("instruction").isNotNull() & F.col("output").isNotNull())


# --- documents -------------------------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", how)


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, prompt, pair, chosen, rejected): per language and source, every good text with a bad one."""
    pairs = preference_pairs(labelled(spark, sf_dir), ["lang", "source"], "doc_id", "text", F.col("quality") == 1)
    return pairs.select("lang", F.col("source").alias("prompt"), "pair", "chosen", "rejected")


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, pos, column, sample): one dataset per document, with the layout its id selects."""
    layouts = F.array(
        *[
            F.array(
                *[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), F.lit(s).alias("sample")) for i, (c, s) in enumerate(l)]
            )
            for l in LAYOUTS
        ]
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("dataset"))
    return docs.select("dataset", F.inline(F.get(layouts, (F.col("dataset") % len(LAYOUTS)).cast("int"))))


def ragged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, value): documents as JSON lines with one of five key sets."""
    docs = table(spark, sf_dir, "documents")
    layouts = [
        F.to_json(F.struct("text")),
        F.to_json(F.struct(F.col("source").alias("prompt"), F.col("text").alias("completion"), F.col("n_chars").alias("label"))),
        F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("lang", "text"))).otherwise(F.to_json(F.struct("text", "lang"))),
        F.to_json(F.struct(F.col("source").alias("instruction"), F.col("text").alias("output"))),
        F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))),
    ]
    value = F.lit(None).cast("string")
    for i, layout in enumerate(layouts):
        value = F.when(F.col("doc_id") % len(layouts) == i, layout).otherwise(value)
    return docs.select(F.col("doc_id").alias("row_id"), value.alias("value"))


def mixed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, label, text): media cells by language, integer labels for labelled documents only."""
    image = F.when(F.col("lang") == "en", F.concat("source", F.lit(".png"))).when(F.col("lang") != "fr", F.col("source"))
    return labelled(spark, sf_dir, "left").select(image.alias("image"), F.col("quality").alias("label"), "text")


# --- logs ------------------------------------------------------------------------------------


def log_lines(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """(job_id, seq, ts, line): loss lines with and without a step, and lines without a loss.

    `events` may be the same table as a stream.
    """
    n, x = (F.col("event_id") % 1000).cast("string"), F.col("value").cast("string")
    line = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("step "), n, F.lit(": loss "), x))
        .when(F.col("event_type") == "view", F.concat(F.lit("12/100 | Loss= "), x))
        .when(F.col("event_type") == "signup", F.concat(F.lit("{'loss': "), x, F.lit(", 'step': "), n, F.lit("}")))
        .when(F.col("event_type") == "error", F.concat(F.lit("step "), n, F.lit(": loss nan, was -"), x))
        .otherwise(F.concat(F.lit("saving state "), n))
    )
    rows = table(spark, sf_dir, "events") if events is None else events
    return rows.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", line.alias("line"))


def trainer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, seq, line): what a trainer reports per iteration, twenty iterations per job."""
    n, x = (F.col("event_id") % 20).cast("string"), F.col("value").cast("string")
    line = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("Iter "), n, F.lit(": Train loss "), x, F.lit(", Tokens/sec "), x))
        .when(F.col("event_type") == "view", F.concat(F.lit("Iter "), n, F.lit(": Val loss "), x, F.lit(", Val took 1s")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Iter "), n, F.lit(": Saved adapter weights to adapters.")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Peak mem "), x, F.lit(" GB | Peak mem 9.5 GB")))
        .otherwise(F.lit("no report"))
    )
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), line.alias("line"))


def log_chunks(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """(job_id, channel, seq, ts, chunk): the log lines as captured output that breaks anywhere."""
    line = F.col("line")
    chunk = (
        F.when(F.col("seq") % 5 == 0, line)
        .when(F.col("seq") % 5 == 1, F.concat(F.left(line, F.lit(3)), F.lit("\r"), line, F.lit("\n  \n"), F.left(line, F.lit(4))))
        .otherwise(F.concat(F.left(line, F.lit(5)), F.lit("\n"), F.substr(line, F.lit(6))))
    )
    channel = F.when(div(F.col("seq"), 2) % 2 == 0, "stdout").otherwise("stderr")
    return log_lines(spark, sf_dir, events).select("job_id", channel.alias("channel"), "seq", "ts", chunk.alias("chunk"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, ts, kind, error)."""
    kind = (
        F.when(F.col("event_type") == "view", "started")
        .when((F.col("event_type") == "click") & (F.col("user_id") % 3 == 0), "stop_requested")
        .when((F.col("event_type") == "purchase") & (F.col("user_id") % 4 != 0), "returned")
        .when((F.col("event_type") == "error") & (F.col("user_id") % 5 == 0), "failed")
        .otherwise("submitted")
    )
    error = F.when(kind == "failed", F.concat(F.lit("ZeroDivisionError: loss 7.5 in "), F.col("props")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "ts", kind.alias("kind"), error.alias("error"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, name)."""
    ids = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.min("event_id").alias("_first"))
    return ids.select("job_id", F.concat(F.lit("sft · model-"), F.col("_first").cast("string")).alias("name"))


# --- runs, catalogs, manifests ------------------------------------------------------------------


def task_of(key):
    """A task id from an integer column; one value in thirteen names no task."""
    ids = F.array(*[F.lit(t.id) for t in dims.TASKS], F.lit("no_such_task"))
    return F.get(ids, (key % (len(dims.TASKS) + 1)).cast("int"))


def run_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, config): runs as JSON with a few of their fields and a key no run has."""
    extra = F.when(F.col("p_size") % 5 == 0, F.create_map(F.lit("beta"), F.lit("0.3"), F.lit("note"), F.col("p_name")))
    config = F.struct(
        task_of(F.col("p_partkey")).alias("task"),
        F.concat(F.lit("org/"), "p_brand").alias("model_name"),
        (F.col("p_retailprice") / 1000000).alias("learning_rate"),
        F.col("p_size").alias("batch_size"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_size") / 10).alias("num_train_epochs"),
        F.when(F.col("p_size") % 2 == 0, True).alias("gradient_checkpointing"),
        extra.alias("extra"),
        F.col("p_type").alias("retired_option"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), F.to_json(config).alias("config"))


def form_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, form): what a form with sliders and number fields hands over."""
    form = F.struct(
        F.concat(F.lit("out/"), "p_brand").alias("output_dir"),
        (F.col("p_size") + F.lit(0.9)).alias("batch_size"),
        F.lit("4").alias("grad_accum"),
        (F.col("p_retailprice") / 1000000).cast("string").alias("lr"),
        F.col("p_partkey").alias("max_steps"),
        (F.col("p_size") % 4).alias("epochs"),
        F.lit(5).alias("warmup"),
        (F.col("p_size") % 2 == 1).alias("grad_ckpt"),
        F.lit(42.0).alias("seed"),
        (F.col("p_size") % 3 / 10).alias("beta"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), form.alias("form"))


def recipe_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, value): recipes as hand-written YAML; every fourth names no dataset."""
    dataset = F.when(
        F.col("p_partkey") % 4 != 0,
        F.concat(F.lit("dataset:\n  source: org/"), F.translate("p_name", " ", "-"), F.lit("\n  local: "), (F.col("p_size") % 2 == 0).cast("string"), F.lit("\n")),
    ).otherwise("")
    text = F.concat(
        F.lit("# saved run\n"),
        dataset,
        F.lit("run:\n  task: "), task_of(F.col("p_partkey")),
        F.lit("\n  lora_r: "), F.col("p_size").cast("string"),
        F.lit("\n  learning_rate: "), (F.col("p_retailprice") / 1000).cast("string"),
        F.lit("\n  target_modules: [q_proj, v_proj]\n  retired_option: [1, 2]\n"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"), text.alias("value"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entry, downloads, tags): parts as a model catalog; names repeat, so `entry` breaks ties."""
    return table(spark, sf_dir, "part").select(
        F.col("p_name").alias("id"),
        F.col("p_partkey").alias("entry"),
        F.floor("p_retailprice").cast("bigint").alias("downloads"),
        F.array("p_type", "p_brand").alias("tags"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact, path): nine artifacts of model files and checkpoints; a third lack one file."""
    n = div(F.col("page_id"), 9) % 27
    roots = F.array(*map(F.lit, ("model.safetensors", "config.json", "tokenizer.json")))
    path = F.when(n >= 3, F.format_string("adapters/%07d_adapters.safetensors", n * 100)).otherwise(F.get(roots, n.cast("int")))
    path = F.when((n == 1) & (F.col("page_id") % 3 == 0), F.lit("readme.md")).otherwise(path)
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("m"), F.col("page_id") % 9).alias("artifact"), path.alias("path"))
