"""One query per operator, over the test tables, projected to scalar columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata import dims
from tunedata.functions import chat
from tunedata.functions.shapes import shape_of
from tunedata.functions.text import div, is_blank
from tunedata.operators import catalog as C
from tunedata.operators import configs as R
from tunedata.operators import datasets as D
from tunedata.operators import logs as L
from tunedata.operators.chats import count_chats
from tunedata.operators.detect import (
    Detection,
    detect,
    detect_columns,
    evidence,
    header_key,
    report,
    shape_census,
    tasks_for_format,
    with_label,
)
from tunedata.operators.normalize import field_quality, normalize
from tunedata.plans import tables as A
from tunedata.sources import files, recipes
from tunedata.sources.history import append_history, read_history
from tunedata.sources.session import scratch_dir
from tunedata.streaming import logs as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DATE = "26 Jul 2024"
TOOLS = [{"name": "search", "parameters": {"q": {"type": "string"}}}]
CHAT = ("conv_id", "piece")


def place() -> chat.Place:
    return chat.Place.of("place")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def as_of() -> Column:
    return F.lit(A.AS_OF).cast("timestamp")


def stamp(name: str) -> Column:
    """A timestamp as text, so that it compares alike whatever the session's time zone."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def map_text(c: Column) -> Column:
    """A map as `key=value` text in key order."""
    entries = F.array_sort(F.map_entries(c))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def messages_text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")


CHATML = Detection("chatml", 0.95, {"messages": "messages"})
SHAREGPT = Detection("sharegpt", 0.95, {"conversations": "conversations"})
ALPACA = Detection("alpaca", 0.95, {"instruction": "instruction", "input": "input", "output": "output"})
PROMPT_COMPLETION = Detection("prompt_completion", 0.9, {"prompt": "instruction", "completion": "output"})
TEXT = Detection("text", 0.85, {"text": "text"})
PREFERENCE = Detection("preference", 0.95, {"prompt": "prompt", "chosen": "chosen", "rejected": "rejected"})
BARE_PREFERENCE = Detection("preference", 0.75, {"chosen": "chosen", "rejected": "rejected"})
KTO = Detection("kto", 0.9, {"prompt": "source", "completion": "text", "label": "quality"})
GRPO = Detection("grpo", 0.6, {"prompt": "text"})
PAIRS = Detection("embedding_pairs", 0.8, {"anchor": "title", "positive": "url"})
AUDIO = Detection("audio_text", 0.9, {"audio": "audio", "text": "text"})
IMAGE = Detection("image_text", 0.85, {"image": "image", "text": "text"})


# --- chats and normalization ----------------------------------------------------------------


@query
def chatml_sft_text(spark, sf):
    return normalize(A.chats(spark, sf), CHATML, "sft", keep=CHAT)


@query
def chatml_llama3_text(spark, sf):
    return normalize(A.chats(spark, sf), CHATML, "sft", chat.llama3(date_string=DATE, place=place()), CHAT)


@query
def chatml_llama3_pieces(spark, sf):
    """The same in pieces of at most three turns."""
    return normalize(A.chats(spark, sf, 3), CHATML, "sft", chat.llama3(date_string=DATE, place=place()), CHAT)


@query
def chat_llama3_tools_text(spark, sf):
    return normalize(A.chats(spark, sf), CHATML, "sft", chat.llama3(date_string=DATE, tools=TOOLS, place=place()), CHAT)


def _prompts(history: DataFrame) -> DataFrame:
    template = chat.llama3(date_string=DATE, add_generation_prompt=True, place=place().with_question())
    asked = F.concat(F.lit("And chat "), F.col("conv_id").cast("string"), F.lit("? "))
    return history.select(
        *CHAT,
        chat.build_prompt(F.col("messages"), asked, template, place()).alias("prompt"),
        chat.build_prompt(F.col("messages"), asked, place=place()).alias("bare_prompt"),
    )


@query
def chat_prompt_text(spark, sf):
    return _prompts(A.chats(spark, sf))


@query
def chat_prompt_pieces(spark, sf):
    """The same in pieces of at most three turns: the question and the assistant's header end the last."""
    return _prompts(A.chats(spark, sf, 3))


@query
def sharegpt_sft_text(spark, sf):
    return normalize(A.sharegpt_chats(spark, sf), SHAREGPT, "sft", keep=CHAT)


@query
def alpaca_sft_text(spark, sf):
    return normalize(A.exchanges(spark, sf), ALPACA, "sft", keep=["conv_id", "turn"])


@query
def prompt_completion_sft_text(spark, sf):
    return normalize(A.exchanges(spark, sf), PROMPT_COMPLETION, "sft", keep=["conv_id", "turn"])


@query
def text_sft_rows(spark, sf):
    return normalize(A.table(spark, sf, "documents"), TEXT, "sft", keep=["doc_id"])


@query
def text_cpt_rows(spark, sf):
    return normalize(A.table(spark, sf, "documents"), TEXT, "cpt", keep=["doc_id"])


@query
def preference_dpo_rows(spark, sf):
    return normalize(A.preferences(spark, sf), PREFERENCE, "dpo", keep=["lang", "pair"])


@query
def preference_orpo_rows_without_prompt(spark, sf):
    renamed = A.preferences(spark, sf).withColumnRenamed("prompt", "source")
    return normalize(renamed, BARE_PREFERENCE, "orpo", keep=["lang", "source", "pair"])


@query
def preference_simpo_rows(spark, sf):
    rows = normalize(A.preferences(spark, sf), PREFERENCE, "simpo", keep=["lang", "pair"])
    return rows.select("lang", "pair", "prompt", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


@query
def kto_rows(spark, sf):
    return normalize(A.labelled(spark, sf), KTO, "kto", keep=["doc_id"])


@query
def grpo_rows(spark, sf):
    return normalize(A.table(spark, sf, "benchmark"), GRPO, "grpo", keep=["item_id"])


@query
def embedding_rows(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    pages = A.table(spark, sf, "pages").select("page_id", "url", title.alias("title"))
    return normalize(pages, PAIRS, "embedding", keep=["page_id"])


def _with_media(spark, sf):
    name = F.col("doc_id").cast("string")
    return A.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("clip"), name, F.lit(".wav")).alias("audio"), F.concat(F.lit("scan"), name, F.lit(".png")).alias("image"), "text"
    )


@query
def audio_tts_rows(spark, sf):
    return normalize(_with_media(spark, sf), AUDIO, "tts_sft", keep=["doc_id"])


@query
def audio_stt_rows(spark, sf):
    return normalize(_with_media(spark, sf), AUDIO, "stt_sft", keep=["doc_id"])


@query
def image_ocr_rows(spark, sf):
    return normalize(_with_media(spark, sf), IMAGE, "ocr_sft", keep=["doc_id"])


@query
def vision_chat_rows(spark, sf):
    image = F.concat(F.lit("img"), F.col("conv_id").cast("string"), F.lit(".png"))
    df = A.sharegpt_chats(spark, sf).withColumn("image", F.when(place().starts, image))  # once a chat
    found = Detection("vision_chat", 0.9, {"images": "image", "messages": "conversations"})
    out = normalize(df, found, "vlm_sft", keep=CHAT)
    return out.select(*CHAT, "images", messages_text(F.col("messages")).alias("messages"))


@query
def kto_field_quality(spark, sf):
    rows = A.labelled(spark, sf, "left").withColumn("source", F.nullif("source", F.lit("src0")))
    return field_quality(normalize(rows, KTO, "kto"), "kto")


# --- detection --------------------------------------------------------------------------------


def _catalog_verdicts(spark, sf, **lookup):
    is_text = F.col("sample").startswith("t:")
    value = F.substr("sample", F.lit(3))
    coded = F.when(is_text, shape_of(value, T.StringType())).otherwise(F.col("sample"))
    return detect_columns(A.headers(spark, sf).withColumn("shape", coded), ["dataset"], **lookup)


@query
def detect_catalog(spark, sf):
    v = _catalog_verdicts(spark, sf)
    return v.select("dataset", "rule", "format", "confidence", map_text(F.col("mapping")).alias("mapping"))


OVERRIDES = {"image": "text", "label": "score"}


@query
def detect_with_overrides(spark, sf):
    """The catalog with two fields set by hand, in whatever datasets have such columns."""
    v = _catalog_verdicts(spark, sf, overrides=OVERRIDES)
    return v.select("dataset", "rule", "format", "confidence", map_text(F.col("mapping")).alias("mapping"))


@query
def detected_labels(spark, sf):
    labelled = with_label(_catalog_verdicts(spark, sf).select("format"))
    return labelled.groupBy("format", "format_label").agg(F.count(F.lit(1)).alias("n_datasets"))


@query
def compatible_tasks(spark, sf):
    pairs = tasks_for_format(_catalog_verdicts(spark, sf).select("dataset", "format"))
    return pairs.groupBy("task", "task_label", "position").agg(F.count(F.lit(1)).alias("n_datasets"))


@query
def normalized_headers(spark, sf):
    keyed = A.headers(spark, sf).select(header_key(F.col("column")).alias("header"), "pos", "column")
    return L.last_wins(keyed.withColumn("pos", F.col("pos").cast("bigint")), ["header"], "column", "pos")


@query
def ragged_census(spark, sf):
    census = shape_census(A.ragged_lines(spark, sf))
    return census.select("key_set", "n_rows", "first_row", "format", "confidence", map_text(F.col("mapping")).alias("mapping"))


@query
def detection_evidence(spark, sf):
    return evidence(A.mixed_columns(spark, sf))


@query
def detect_and_ingest(spark, sf):
    """Detection card of the conversations as one dataset, with its row count."""
    df = A.chats(spark, sf)
    n, _, found = D.ingest(df.select("conv_id", "messages"), order_by=["conv_id"])
    card = report(found)
    return df.groupBy().agg(
        count_chats().alias("n_rows"),
        F.lit(n).cast("bigint").alias("n_ingested"),
        F.lit(card["format"]).alias("format"),
        F.lit(card["confidence"]).alias("confidence"),
        F.lit(", ".join(card["mapping"])).alias("mapping"),
        F.lit(", ".join(card["tasks"])).alias("tasks"),
    )


@query
def dataset_preview(spark, sf):
    return D.preview(A.table(spark, sf, "documents"), order_by=["doc_id"])


# --- sources and sinks --------------------------------------------------------------------------


def _document_rows(df: DataFrame) -> DataFrame:
    """What a round trip must keep: ids, languages and the exact text (as its digest)."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.md5("text").alias("digest"))


def _documents(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", "lang", "text")


@query
def scan_jsonl(spark, sf):
    path = scratch_dir(spark, "jsonl")
    _documents(spark, sf).write.json(path)
    return _document_rows(files.load_dataset(spark, path, "jsonl"))


def _json_documents(spark, sf, wrap: bool) -> str:
    """Documents as JSON files of a hundred records, bare or inside an object."""
    path = scratch_dir(spark, "json")
    batch = div(F.col("doc_id"), 100)
    lists = _documents(spark, sf).groupBy(batch.alias("batch")).agg(
        F.to_json(F.collect_list(F.struct("doc_id", "lang", "text"))).alias("value")
    )
    value = F.concat(F.lit('{"version":2,"records":'), "value", F.lit(',"data":[]}')) if wrap else F.col("value")
    lists.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query
def scan_json_list(spark, sf):
    return _document_rows(files.load_dataset(spark, _json_documents(spark, sf, wrap=False), "json"))


@query
def scan_json_wrapper(spark, sf):
    return _document_rows(files.load_dataset(spark, _json_documents(spark, sf, wrap=True), "json"))


@query
def scan_csv(spark, sf):
    path = scratch_dir(spark, "csv")
    _documents(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return _document_rows(files.load_dataset(spark, path, "csv"))


@query
def scan_csv_ranges(spark, sf):
    """The same, each file read by as many tasks as it has byte ranges."""
    path = scratch_dir(spark, "csv")
    _documents(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return _document_rows(files.load_dataset(spark, path, "csv", ranges=True))


@query
def scan_tsv(spark, sf):
    path = scratch_dir(spark, "tsv")
    _documents(spark, sf).write.option("header", True).option("escape", '"').option("sep", "\t").csv(path)
    return _document_rows(files.load_dataset(spark, path, "tsv"))


@query
def scan_parquet(spark, sf):
    return _document_rows(files.load_dataset(spark, f"{sf}/documents.parquet"))


@query
def scan_split(spark, sf):
    root = scratch_dir(spark, "hub")
    split = D.train_validation_split(_documents(spark, sf), "doc_id", 20)
    for name in ("train", "validation"):
        files.save_split(split.where(F.col("split") == name).drop("split"), root, "org/docs", name)
    return _document_rows(files.load_split(spark, root, "org/docs", "validation"))


@query
def training_set_sink(spark, sf):
    rows = normalize(A.labelled(spark, sf), KTO, "kto", keep=["doc_id"])
    target = files.write_training_set(rows, scratch_dir(spark, "sink"), "kto")
    return spark.read.parquet(target).select("doc_id", "prompt", F.md5("completion").alias("digest"), "label")


@query
def capped_rows(spark, sf):
    capped = files.cap_rows(A.table(spark, sf, "events"), 500, order_by=["event_id"])
    return capped.select("event_id", "event_type")


@query
def capped_scan(spark, sf):
    return files.load_dataset(spark, f"{sf}/events.parquet", max_rows=700).select("event_id", "event_type")


@query
def nonblank_lines(spark, sf):
    lines = A.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kept = lines.where(~is_blank(F.col("line")))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


# --- logs ---------------------------------------------------------------------------------------


@query
def log_relines(spark, sf):
    return L.relines(A.log_chunks(spark, sf)).select("job_id", "channel", "line_no", "line")


@query
def log_loss_points(spark, sf):
    points = L.loss_points(A.log_lines(spark, sf))
    return points.withColumn("explicit_step", F.coalesce("explicit_step", F.lit(-1)))


@query
def log_loss_series(spark, sf):
    return L.loss_series(A.log_lines(spark, sf))


@query
def log_points_per_job(spark, sf):
    return L.points_per_job(L.loss_points(A.log_lines(spark, sf), ["job_id"]))


@query
def log_first_and_last(spark, sf):
    return L.first_and_last(L.loss_series(A.log_lines(spark, sf)))


@query
def log_every_kth_point(spark, sf):
    return L.every_kth(L.loss_points(A.log_lines(spark, sf)), 4).select("job_id", "seq", "kth", "loss")


@query
def log_loss_trajectory(spark, sf):
    return L.loss_trajectory(L.loss_points(A.log_lines(spark, sf)))


@query
def log_ring(spark, sf):
    return L.ring(A.log_lines(spark, sf), 50).select("job_id", "seq", "line")


@query
def log_ring_whole(spark, sf):
    """The ring as long as the log view keeps it."""
    return L.ring(A.log_lines(spark, sf)).select("job_id", "seq", F.md5("line").alias("digest"))


@query
def log_tails(spark, sf):
    return L.log_tail(A.log_lines(spark, sf), 20)


@query
def job_statuses(spark, sf):
    s = L.job_status(A.job_events(spark, sf), as_of())
    return s.select("job_id", "status", F.round("elapsed", 3).alias("elapsed"), "error")


@query
def job_snapshots(spark, sf):
    s = L.job_snapshots(A.jobs(spark, sf), A.log_lines(spark, sf), A.job_events(spark, sf), as_of(), tail=5)
    return s.select("job_id", "name", "status", F.round("elapsed", 3).alias("elapsed"), "n_points", "tail")


@query
def newest_job_snapshot(spark, sf):
    s = L.job_snapshots(A.jobs(spark, sf), A.log_lines(spark, sf), A.job_events(spark, sf), as_of(), tail=5, newest=True)
    return s.select("job_id", "name", "status", F.round("elapsed", 3).alias("elapsed"), "n_points", "tail")


@query
def newest_job_series(spark, sf):
    series = L.job_series(A.jobs(spark, sf), A.log_lines(spark, sf), A.job_events(spark, sf), newest=True)
    return series.select("job_id", "step", "loss")


@query
def job_series(spark, sf):
    series = L.job_series(A.jobs(spark, sf), A.log_lines(spark, sf), A.job_events(spark, sf))
    return series.select("job_id", "step", "loss")


@query
def job_listing(spark, sf):
    status = L.job_status(A.job_events(spark, sf), as_of())
    return L.job_listing(A.jobs(spark, sf).join(status, "job_id"))


@query
def run_history(spark, sf):
    """Snapshots appended in two runs and read back, the later one winning per job."""
    path = scratch_dir(spark, "history")
    status = L.job_status(A.job_events(spark, sf), as_of()).select("job_id", "status")
    early = L.job_status(A.job_events(spark, sf).where("kind = 'started'"), as_of()).select("job_id", "status")
    append_history(early, path, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    append_history(status, path, as_of())
    return read_history(spark, path).select("job_id", "status")


@query
def log_pattern_hits(spark, sf):
    hits = L.pattern_hits(A.trainer_lines(spark, sf))
    return hits.select(
        "job_id", "seq", "kind", F.col("pos").cast("bigint").alias("pos"), F.coalesce("iter", F.lit(-1)).alias("iter"),
        F.coalesce("value", F.lit("")).alias("value"),
    )


@query
def log_headlines(spark, sf):
    return L.log_headlines(A.trainer_lines(spark, sf))


@query
def checkpoint_table(spark, sf):
    return L.checkpoint_losses(A.trainer_lines(spark, sf))


@query
def eval_loss_series(spark, sf):
    return L.eval_losses(A.trainer_lines(spark, sf))


@query
def log_stalls(spark, sf):
    found = L.stalls(A.log_lines(spark, sf), 86_400, as_of=as_of())
    return found.select(
        "job_id", stamp("last_line_at"), F.coalesce(stamp("next_line_at"), F.lit("")).alias("next_line_at"),
        F.round("quiet", 3).alias("quiet"),
    )


# --- streams --------------------------------------------------------------------------------------


LATENESS, SLOT = "1 day", 31 * 86_400  # a replay of a month needs no release in between


def _drained(spark, sf, name: str, build) -> DataFrame:
    """All a stream over the events makes, late rows included; `build` gets the events and the clock."""
    own, base = S.stream_session(spark), scratch_dir(spark, name)
    clock = S.beat(own, f"{base}/clock", "1970-01-01")
    # the events as arriving files (a pattern, since the table may be one file)
    events = S.read_stream(own, f"{sf}/event*.parquet", A.table(spark, sf, "events").schema)
    stream = build(events, clock)
    S.run_to_end(stream, f"{base}/out", f"{base}/checkpoint", clock)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query
def streamed_lines(spark, sf):
    made = _drained(spark, sf, "lines", lambda events, clock: S.stream_lines(A.log_chunks(spark, sf, events), LATENESS, clock, slot_seconds=SLOT))
    return made.select("job_id", "channel", "line_no", "line")


@query
def streamed_loss_series(spark, sf):
    made = _drained(spark, sf, "series", lambda events, clock: S.stream_loss_series(A.log_lines(spark, sf, events), LATENESS, clock, slot_seconds=SLOT))
    return made.select("job_id", "seq", "step", "loss")


@query
def streamed_stalls(spark, sf):
    made = _drained(spark, sf, "stalls", lambda events, clock: S.stream_stalls(A.log_lines(spark, sf, events), clock, 86_400))
    return made.select("job_id", stamp("active_from"), stamp("last_line_at"), "n_lines")


# --- runs -----------------------------------------------------------------------------------------


def _runs(spark, sf):
    return R.parse_configs(A.run_json(spark, sf))


@query
def parsed_configs(spark, sf):
    r = _runs(spark, sf)
    return r.select(
        "run_id", "run.task", "run.model_name", "run.learning_rate", "run.batch_size", "run.num_train_epochs",
        "run.gradient_checkpointing", "run.max_steps", "run.seed", map_text(F.col("run.extra")).alias("extra"),
    )


@query
def config_round_trip(spark, sf):
    record = _runs(spark, sf).select("run_id", "run", R.config_record(F.col("run")).alias("record"))
    again = R.parse_configs(record, "record", "again")
    same = F.to_json("run") == F.to_json("again")
    return again.select("run_id", same.alias("same"), F.array_join("again.target_modules", ",").alias("target_modules"))


@query
def form_configs(spark, sf):
    df = _runs(spark, sf).join(A.form_values(spark, sf), "run_id")
    run = df.select("run_id", R.from_form(F.col("run"), F.col("form")).alias("run"))
    return run.select(
        "run_id", "run.task", "run.output_dir", "run.batch_size", "run.gradient_accumulation_steps", "run.learning_rate",
        "run.max_steps", "run.num_train_epochs", "run.gradient_checkpointing", "run.seed", map_text(F.col("run.extra")).alias("extra"),
    )


def _arg_rows(df: DataFrame, args: str) -> DataFrame:
    """A row for each argument of each run, and one for a run that is refused."""
    exploded = df.select("run_id", "refused", F.explode_outer(args).alias("arg", "_value"))
    number = F.when(F.col("_value").rlike("^[-+.0-9eE]+$"), F.col("_value").try_cast("double"))
    return exploded.select(
        "run_id", "arg", number.alias("number"), F.when(number.isNull(), F.col("_value")).alias("text"), "refused"
    )


@query
def trainer_arguments(spark, sf):
    return _arg_rows(R.build_trainer_args(_runs(spark, sf), strict=False), "args")


@query
def accepted_arguments(spark, sf):
    accepted = F.when(F.col("run_id") % 2 == 0, F.array(*map(F.lit, ("learning_rate", "seed", "beta"))))
    built = R.build_trainer_args(_runs(spark, sf), strict=False)
    return _arg_rows(built.select("run_id", "refused", R.only_accepted(F.col("args"), accepted).alias("args")), "args")


@query
def task_cards(spark, sf):
    """Info card of every task with the number of runs that chose it."""
    chosen = _runs(spark, sf).groupBy("run.task").agg(F.count(F.lit(1)).alias("n_runs"))
    cards = R.task_listing(spark).join(chosen, "task", "left")
    return cards.select(
        "task", "task_label", "trainer", "config", F.array_join("dataset_schema", ", ").alias("dataset_schema"), "notes",
        F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
    )


@query
def parsed_recipes(spark, sf):
    documents = A.recipe_yaml(spark, sf).repartition(spark.sparkContext.defaultParallelism)  # YAML costs more than a shuffle
    parsed = recipes.parse_recipes(documents, keep=["run_id"])
    return parsed.select(
        "run_id", "run.task", "run.lora_r", "run.learning_rate", "run.batch_size",
        F.array_join("run.target_modules", ",").alias("target_modules"), "source", "is_local",
    )


@query
def saved_recipes(spark, sf):
    named = _runs(spark, sf).select(
        F.when(F.col("run_id") % 3 == 0, F.concat(F.lit(" my run "), F.col("run_id").cast("string"))).otherwise("  ").alias("name"),
        (F.lit("2024-05-06 07:08:09").cast("timestamp") + F.make_interval(secs=F.col("run_id").cast("decimal(18,6)"))).alias("saved_at"),
        "run",
        F.lit("org/data").alias("source"),
        (F.col("run_id") % 2 == 0).alias("is_local"),
    )
    table = recipes.save_recipes(named, scratch_dir(spark, "recipes"))
    back = recipes.parse_recipes(table, "document", ["slug"])
    return back.select("slug", "run.task", "run.learning_rate", "source", "is_local")


@query
def sweep_variants(spark, sf):
    grid = {"learning_rate": [1e-4, 2e-4], "lora_r": [8, 16, 32], "max_steps": [50, 100]}
    swept = R.sweep(_runs(spark, sf), grid)
    return swept.select("run_id", "variant", "run.task", "run.learning_rate", "run.lora_r", "run.max_steps", "run.batch_size")


@query
def sweep_comparison(spark, sf):
    """Final loss of the jobs whose id is a run's."""
    runs = _runs(spark, sf).select(F.col("run_id").alias("job_id"), "run.learning_rate", "run.lora_r")
    compared = R.compare_final_loss(runs, L.first_and_last(L.loss_series(A.log_lines(spark, sf))))
    return compared.withColumns(
        {"last_step": F.coalesce("last_step", F.lit(-1)), "last_loss": F.coalesce("last_loss", F.lit(-1.0))}
    )


# --- catalogs and artifacts ---------------------------------------------------------------------------


@query
def dataset_search(spark, sf):
    found = C.search_datasets(A.catalog(spark, sf), "RED", tie_break=["entry"])
    return found.select("id", "entry", "downloads")


@query
def model_search_tagged(spark, sf):
    return C.search_models(A.catalog(spark, sf), "ring", "ECONOMY", tie_break=["entry"]).select("id", "entry", "downloads")


@query
def model_search_fallback(spark, sf):
    return C.search_models(A.catalog(spark, sf), "ring", "no-such-tag", tie_break=["entry"]).select("id", "entry", "downloads")


@query
def artifact_completeness(spark, sf):
    done = C.artifact_status(A.manifest(spark, sf))
    return done.select("artifact", F.array_join("missing", ",").alias("missing"), "n_checkpoints", "complete")


@query
def model_directories(spark, sf):
    return C.valid_models(A.manifest(spark, sf))


# --- dataset statistics ---------------------------------------------------------------------------------


@query
def validation_split(spark, sf):
    return D.train_validation_split(A.table(spark, sf, "documents"), "doc_id", 10).select("doc_id", "split")


@query
def length_histogram(spark, sf):
    return D.length_histogram(A.table(spark, sf, "documents"), "text", 50)


@query
def duplicate_texts(spark, sf):
    return D.duplicate_groups(A.table(spark, sf, "documents"), "text", "doc_id").select("text_sha256", "first_id", "copies")


@query
def multi_positive_pairs(spark, sf):
    lines = F.split("text", "\n")
    docs = A.table(spark, sf, "documents").select("doc_id", "source", lines.alias("positives"), F.array("lang", "source").alias("negatives"))
    return D.expand_pairs(docs, "source", "positives", "negatives", ["doc_id"])
