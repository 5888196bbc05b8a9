"""Format detection: header synonyms and value shapes -> format, confidence, mapping, tasks.

The rules run as one CASE over a (dataset, position, column, shape) table. One dataset is the
case of a single key, a catalog of many datasets or a census of ragged rows is the general one.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunedata import dims
from tunedata.functions import shapes as S
from tunedata.functions.text import column, is_blank, literal_map, sql_text, strip
from tunedata.sources.session import scratch_dir

# --- fixed values -----------------------------------------------------------------------
EMPTY_NOTE = "Dataset is empty."
IMAGE_TEXT_NOTE = "Image + text detected — suitable for OCR SFT or vision tasks."
AUDIO_TEXT_NOTE = "Audio + text detected — choose TTS (synthesis) or STT (recognition)."
NO_PROMPT_NOTE = "No explicit prompt column; chosen/rejected may embed the prompt."
PAIRS_NOTE = "Anchor/positive pair detected — embedding contrastive training."
GRPO_NOTE = "Bare prompts — usable for GRPO with a custom reward function."
TEXT_NOTE = "Raw text — suitable for CPT or completion-style SFT."
COLUMN_SLOT = "{column}"
SINGLE_COLUMN_NOTE = "Single text column `{column}` assumed to be raw text."
# --- end of fixed values ----------------------------------------------------------------

REVIEW_BELOW = 0.7
UNKNOWN_NOTE = "Could not classify the columns. Map fields manually."


@dataclass
class Detection:
    format: str
    confidence: float
    mapping: dict[str, str] = field(default_factory=dict)
    suggested_tasks: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    @property
    def label(self) -> str:
        return dims.FORMAT_LABELS.get(self.format, self.format)

    @property
    def needs_review(self) -> bool:
        """Too unsure to go on without a look at the mapping (see `overrides` of `detect`)."""
        return self.confidence < REVIEW_BELOW


def header_key(name: Column) -> Column:
    return F.lower(strip(name))


def tasks_for_format(datasets: DataFrame, format_col: str = "format") -> DataFrame:
    """One row per (dataset row, compatible task), with the task's listing position."""
    tasks = dims.tasks_df(datasets.sparkSession)
    pairs = tasks.select(F.explode("detector_formats").alias("_format"), "position", "task", "task_label")
    return datasets.join(F.broadcast(pairs), F.col(format_col) == F.col("_format")).drop("_format")


def with_label(datasets: DataFrame, format_col: str = "format") -> DataFrame:
    """Add `format_label`; an unlisted format is its own label."""
    labels = dims.labels_df(datasets.sparkSession).withColumnRenamed("format", "_format")
    joined = datasets.join(F.broadcast(labels), F.col(format_col) == F.col("_format"), "left").drop("_format")
    return joined.withColumn("format_label", F.coalesce("format_label", format_col))


# --- synonym lookup ------------------------------------------------------------------------


# A field looked up beside others never takes the column that they have taken.
BESIDE = {"text": ("image",), "transcription": ("audio",), "input": ("instruction", "output")}


def beside(canonical: str) -> str:
    return f"{canonical}_beside"


def _forced(overrides: Mapping[str, str], key: Column, name: Column) -> tuple[Column, list[tuple[str, str, int, bool]]]:
    """Further keys of a column, and what they stand for, where fields are set by hand.

    A column set for a field gets a key that ranks before all. If a lookup beside another field meets the
    column set for that field, it falls back to the best of the other columns: those have a key for it.
    """
    marks = {actual: f"\x00{i}" for i, actual in enumerate(dict.fromkeys(overrides.values()))}
    rows = [(marks[actual], canonical, -1, False) for canonical, actual in overrides.items()]
    ways = [key, F.try_element_at(literal_map(marks), name)]
    for canonical, others in BESIDE.items():
        taken = [overrides[c] for c in (canonical, *others) if c in overrides]
        if taken:
            words = dict.fromkeys((canonical, *dims.SYNONYMS[canonical]))
            ways.append(F.when(key.isin(*words) & ~name.isin(taken), F.concat(F.lit(f"\x01{canonical}\x01"), key)))
            rows += [(f"\x01{canonical}\x01{word}", beside(canonical), rank, False) for rank, word in enumerate(words)]
    return F.explode(F.array_compact(F.array(*ways))), rows


def find_columns(
    columns: DataFrame,
    keys: Sequence[str],
    *,
    position: str = "pos",
    name: str = "column",
    shape: str = "shape",
    overrides: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per dataset: `fields`, a map from canonical fields to the (name, shape) they resolve to.

    The best-ranked synonym wins; of headers equal after trimming and lower-casing, the last one.
    A dataset of any width is reduced map-side to one candidate per field before it moves, and
    only those candidates, as many as there are fields, are ever gathered.
    """
    spark = columns.sparkSession
    synonyms = F.broadcast(dims.synonyms_df(spark))
    key = header_key(F.col(name))
    if overrides:
        key, rows = _forced(overrides, key, F.col(name))
        known = dims.synonyms_df(spark)
        synonyms = F.broadcast(known.union(spark.createDataFrame(rows, known.schema)))
    keyed = columns.select(*keys, position, name, shape, key.alias("_key"))
    hits = keyed.join(synonyms, F.col("_key") == F.col("header_key"), "left")

    # a column stands for several fields but is counted once, with the first of them
    once = F.col("canonical").isNull() | F.col("is_first")
    text_column = F.when(once & S.is_string(F.col(shape)), F.col(name))
    best = F.min_by(F.struct(F.col(name).alias("name"), F.col(shape).alias("shape")), F.struct("rank", -F.col(position)))
    per_field = hits.groupBy(*keys, "canonical").agg(
        best.alias("_best"),
        F.count(F.when(once, F.col(name))).alias("_columns"),
        F.count(text_column).alias("_text_columns"),
        F.min(text_column).alias("_text_column"),
    )
    entry = F.when(F.col("canonical").isNotNull(), F.struct("canonical", "_best"))
    return per_field.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(entry)).alias("fields"),
        F.sum("_columns").alias("n_columns"),
        F.sum("_text_columns").alias("n_text_columns"),
        F.min("_text_column").alias("text_column"),
    )


# --- rules ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """All values are SQL over one (name, shape) column per canonical field and the column counts."""

    id: str
    format: str
    guard: str
    confidence: str
    mapping: Mapping[str, str] = field(default_factory=dict)
    note: str | None = None


def found(*fields: str) -> str:
    return " AND ".join(f"{f} IS NOT NULL" for f in fields)


def names(*fields: str) -> dict[str, str]:
    return {f: f"{f}.name" for f in fields}


def shape_in(canonical: str, *codes: str) -> str:
    return f"{canonical}.shape IN ({', '.join(map(repr, codes))})"


# An image path, or anything that is not a string.
IMAGE_IS_MEDIA = f"({shape_in('image', S.IMAGE_PATH)} OR NOT {shape_in('image', *S.STRINGS)})"

# In order of precedence: the first guard that holds decides.
RULES = (
    Rule("R1", "vision_chat", found("image", "conversations"), f"if({IMAGE_IS_MEDIA}, 0.9D, 0.6D)",
         {"images": "image.name", "messages": "conversations.name"}),
    Rule("R2", "image_text", found("image", "text_beside"), f"if({IMAGE_IS_MEDIA}, 0.85D, 0.55D)",
         {"image": "image.name", "text": "text_beside.name"}, IMAGE_TEXT_NOTE),
    Rule("R3", "audio_text", found("transcription_beside") + f" AND {shape_in('audio', S.AUDIO_PATH, S.OBJECT)}",
         "0.9D", {"audio": "audio.name", "text": "transcription_beside.name"}, AUDIO_TEXT_NOTE),
    Rule("R4", "sharegpt", shape_in("conversations", S.FROM_VALUE), "0.95D", names("conversations")),
    Rule("R5", "chatml", shape_in("conversations", S.ROLE_CONTENT), "0.95D", {"messages": "conversations.name"}),
    Rule("R6", "preference", found("chosen", "rejected", "prompt"), "0.95D", names("chosen", "rejected", "prompt")),
    Rule("R7", "preference", found("chosen", "rejected"), "0.75D", names("chosen", "rejected"), NO_PROMPT_NOTE),
    Rule("R8", "kto", found("prompt", "completion") + f" AND {shape_in('label', S.BOOL, S.INT)}", "0.9D",
         names("prompt", "completion", "label")),
    Rule("R9", "alpaca", found("instruction", "output"), "0.95D",
         {**names("instruction", "output"), "input": "input_beside.name"}),
    Rule("R10", "prompt_completion", found("prompt", "completion"), "0.9D", names("prompt", "completion")),
    Rule("R11", "embedding_pairs", "anchor.name <> positive.name", "0.8D", names("anchor", "positive"), PAIRS_NOTE),
    Rule("R12", "grpo", found("prompt") + " AND n_columns <= 2", "0.6D", names("prompt"), GRPO_NOTE),
    Rule("R13", "text", found("text"), "0.85D", names("text"), TEXT_NOTE),
    Rule("R14", "text", "n_text_columns = 1", "0.5D", {"text": "text_column"}, SINGLE_COLUMN_NOTE),
    Rule("R15", "unknown", "true", "0.0D", {}, UNKNOWN_NOTE),
)


def _verdict(rule: Rule) -> str:
    pairs = ", ".join(f"'{canonical}', {actual}" for canonical, actual in rule.mapping.items())
    mapping = f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL)" if pairs else "cast(map() as map<string,string>)"
    note = "cast(NULL as string)" if rule.note is None else sql_text(rule.note)
    return (
        f"named_struct('rule', '{rule.id}', 'format', '{rule.format}', 'confidence', {rule.confidence},"
        f" 'mapping', {mapping}, 'note', {note})"
    )


def classify(found_columns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First matching rule per dataset -> rule, format, confidence, mapping, suggested_tasks, notes."""
    branches = " ".join(f"WHEN {r.guard} THEN {_verdict(r)}" for r in RULES)
    tasks = F.from_json(F.lit(json.dumps(dims.formats_to_tasks())), "map<string,array<string>>")
    note = F.replace("_v.note", F.lit(COLUMN_SLOT), F.coalesce("text_column", F.lit("")))
    def pick(canonical: str) -> Column:
        return F.try_element_at("fields", F.lit(canonical))

    fields = [pick(canonical).alias(canonical) for canonical in dims.SYNONYMS]
    for canonical, others in BESIDE.items():
        taken = pick(canonical)["name"].isin(*[pick(c)["name"] for c in others])
        fields.append(F.when(taken, pick(beside(canonical))).otherwise(pick(canonical)).alias(beside(canonical)))
    flat = found_columns.select(*keys, "n_columns", "n_text_columns", "text_column", *fields)
    return flat.select(*keys, "text_column", F.expr(f"CASE {branches} END").alias("_v")).select(
        *keys, "_v.rule", "_v.format", "_v.confidence", "_v.mapping",
        F.element_at(tasks, F.col("_v.format")).alias("suggested_tasks"),
        F.array_compact(F.array(note)).alias("notes"),
    )


def detect_columns(columns: DataFrame, keys: Sequence[str], **lookup) -> DataFrame:
    """Detect many datasets at once from their (position, column, shape) rows."""
    return classify(find_columns(columns, keys, **lookup), keys)


# --- one dataset ----------------------------------------------------------------------------


def column_shapes(df: DataFrame) -> DataFrame:
    """(pos, column, shape) of every cell of `df`; meant for a sample row."""
    cells = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(f.name).alias("column"),
            S.shape_of(column(f.name), f.dataType).alias("shape"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.select(F.inline(F.array(*cells)))


def first_row(df: DataFrame, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """The sample row: first by `order_by`, or the first row of the first input file.

    With `order_by` each task keeps one row (top-1), so nothing is sorted or shuffled whole.
    """
    if order_by:
        return df.orderBy(*order_by).limit(1)
    files = df.inputFiles()
    if len(files) < 2 or "_metadata" in df.columns:
        return df.limit(1)
    path = F.col("_metadata.file_path")
    first = min(f.replace("file:///", "file:/") for f in files)
    try:
        sample = df.where(path == first).limit(1)
    except AnalysisException:  # not a bare file scan any more, so it has no file column
        raise ValueError("the rows come from several files: pass order_by to say which one is first") from None
    if sample.isEmpty():  # writers leave empty files: look for the first one with a row
        first = df.select(path.alias("path")).agg(F.min("path")).first()[0]
        sample = df.where(path == first).limit(1)
    return sample


def detect(
    df: DataFrame,
    order_by: Sequence[str | Column] | None = None,
    overrides: Mapping[str, str] | None = None,
) -> Detection:
    """Detect the format of a dataset from its schema and its first row.

    `overrides` maps canonical fields to columns by hand; they win over every synonym.
    """
    for canonical, actual in (overrides or {}).items():
        if canonical not in dims.SYNONYMS:
            raise ValueError(f"Unknown field {canonical!r}")
        if actual not in df.columns:
            raise ValueError(f"No column {actual!r}")
    if not df.columns:
        return Detection("unknown", 0.0, notes=[EMPTY_NOTE])
    sample = column_shapes(first_row(df, order_by)).withColumn("dataset", F.lit(0))
    verdict = detect_columns(sample, ["dataset"], overrides=overrides).collect()  # one row at most
    if not verdict:
        return Detection("unknown", 0.0, notes=[EMPTY_NOTE])
    v = verdict[0]
    notes = list(v.notes)
    if v.format == "unknown":
        notes = [f"Could not classify columns: {df.columns}. Map fields manually."]
    return Detection(v.format, v.confidence, dict(v.mapping), list(v.suggested_tasks), notes)


def report(detection: Detection) -> dict[str, object]:
    """The fields of a detection card: label, confidence, mapping, task labels, notes."""
    return {
        "format": detection.format,
        "format_label": detection.label,
        "confidence": detection.confidence,
        "mapping": [f"{canonical} ← {actual}" for canonical, actual in detection.mapping.items()],
        "tasks": [dims.TASK_BY_ID[t].label for t in detection.suggested_tasks],
        "notes": detection.notes,
    }


# --- evidence over all rows -----------------------------------------------------------------

EVIDENCE_TESTS = {
    "null": lambda s: s == S.NULL,
    "string": S.is_string,
    "media": S.is_media,
    "audio": S.is_audio,
    "from_value_turns": lambda s: s == S.FROM_VALUE,
    "role_content_turns": lambda s: s == S.ROLE_CONTENT,
    "flag": S.is_flag,
}


def evidence(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, test, n_rows, n_pass, share): how many rows pass each shape test.

    One map-side aggregation over fixed-width counters; cells are reduced to shapes in the scan.
    """
    names = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    coded = df.select(*[S.shape_of(column(n), types[n]).alias(f"s{i}") for i, n in enumerate(names)])
    counts = [
        F.count_if(test(F.col(f"s{i}"))).alias(f"s{i}_{label}")
        for i in range(len(names))
        for label, test in EVIDENCE_TESTS.items()
    ]
    totals = coded.agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    cells = [
        F.struct(
            F.lit(n).alias("column"), F.lit(label).alias("test"), F.col("n_rows"), F.col(f"s{i}_{label}").alias("n_pass")
        )
        for i, n in enumerate(names)
        for label in EVIDENCE_TESTS
    ]
    return totals.select(F.inline(F.array(*cells))).withColumn("share", F.try_divide("n_pass", "n_rows"))


# --- ragged JSON ----------------------------------------------------------------------------


def shape_census(lines: DataFrame, value: str = "value", row_id: str = "row_id") -> DataFrame:
    """Group ragged JSON rows by their set of keys, count them and detect each group.

    Rows are read as maps, since a reader with columns fills absent keys with nulls. Two phases: all rows
    are counted by their list of keys, which needs no look at a value; the shapes of values are read in
    the first row of each group only, found by its id (ids are unique). What moves grows with the variety
    of rows, not with their number; the groups go through the shared folder, so that Spark knows their
    size when it joins.
    Returns key_set (sorted keys as JSON), n_rows, first_row, and the detection of the first row.
    Lines that are no JSON object have a null key_set and format `malformed`.
    """
    rows = lines.select(F.col(row_id).alias("_id"), F.col(value).alias("_value"))
    rows = rows.where(~F.coalesce(is_blank(F.col("_value")), F.lit(False)))
    kinds = rows.groupBy(F.json_object_keys("_value").alias("keys")).agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first_row"))
    key_set = F.to_json(F.array_sort(F.array_distinct("keys")))
    groups = kinds.groupBy(key_set.alias("key_set")).agg(F.sum("n").alias("n_rows"), F.min("first_row").alias("first_row"))
    path = scratch_dir(lines.sparkSession, "census")
    groups.write.parquet(path)
    groups = lines.sparkSession.read.schema(groups.schema).parquet(path)

    first = rows.join(groups.select("first_row"), F.col("_id") == F.col("first_row"), "left_semi")
    cells = F.from_json("_value", "map<string,variant>")
    sample = first.select("_id", F.map_keys(cells).alias("keys"), F.transform(F.map_values(cells), S.variant_shape).alias("shapes"))
    columns = groups.join(sample, F.col("first_row") == F.col("_id"), "left").select(
        "key_set", "n_rows", "first_row", F.posexplode_outer(F.arrays_zip("keys", "shapes"))
    ).select("key_set", "n_rows", "first_row", "pos", F.col("col.keys").alias("column"), F.col("col.shapes").alias("shape"))
    found = detect_columns(columns, ["key_set", "n_rows", "first_row"])
    malformed = F.col("key_set").isNull()
    return found.withColumn("format", F.when(malformed, "malformed").otherwise(F.col("format"))).withColumn(
        "rule", F.when(~malformed, F.col("rule"))
    )
