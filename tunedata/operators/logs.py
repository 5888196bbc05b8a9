"""Training logs as tables: lines, loss series, tails, job status, checkpoint tables, stalls.

Lines are `(job_id, seq, ts, line)` with `seq` an integer that grows along a job. One job may hold
most of the table, so everything ordered runs on blocks of `seq` (see `blocks`), and everything
else is an aggregate with fixed-size state per job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunedata import dims
from tunedata.functions.text import div, is_blank, literal_map
from tunedata.operators.blocks import BLOCK, DEFAULT_SPAN, beyond_limit, in_blocks, join_blocks, last_rows, newest_rows, running_total

# --- fixed values: what a trainer's log lines look like ---------------------------------
LOSS = r"""(?i)loss["']?[:=\s]+([0-9]*\.?[0-9]+(?:e-?\d+)?)"""
STEP = r"""(?i)(?:step|it(?:er)?)["']?[:=\s/]+(\d+)"""
VAL_LOSS = r"Val loss ([0-9.]+)"
TOKENS_PER_SECOND = r"Tokens/sec ([0-9.]+)"
PEAK_MEMORY = r"Peak mem ([0-9.]+) GB"
ITER_VAL_LOSS = r"Iter (\d+): Val loss ([0-9.]+)"
ITER_TRAIN_LOSS = r"Iter (\d+): Train loss ([0-9.]+)"
ITER_SAVED = r"Iter (\d+): Saved adapter weights"
CHECKPOINT_NAME = "%07d_adapters.safetensors"
MISSING = "—"
RING_LINES = 2000
TAIL_LINES = 200
STALL_SECONDS = 120
STOP_LINE = "⏹ Stop requested — training will halt at the next step boundary."
# --- end of fixed values ----------------------------------------------------------------

AFTER_ALL = (1 << 63) - 1  # sequence number of a line that comes after all others of its time, or time after all
LOG_SPAN = 3_600_000_000  # logs ordered by time are cut into blocks of an hour


# --- chunks -> lines -----------------------------------------------------------------------


def relines(
    chunks: DataFrame,
    keys: Sequence[str] = ("job_id", "channel"),
    seq: str = "seq",
    text: str = "chunk",
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Cut captured output chunks into lines at \\n or \\r -> keys, seq, line_no, line.

    A line may span chunks; `seq` is that of the chunk that ends it and `line_no` counts the
    terminators before it. Blank lines and the unterminated end of a key are left out.
    Nearly every line lies in one chunk or in two that follow each other in a block, and is put
    together right there; only pieces of longer lines, or at the edge of a block, are grouped.
    """
    breaks = F.regexp_count(F.col(text), F.lit(r"[\n\r]"))
    numbered = running_total(
        chunks.select(*keys, seq, text), keys, [seq], breaks, "_before", span=span, exclusive=True, total_name="_total",
        keep_block=True,
    )
    in_block = W.partitionBy(*keys, BLOCK).orderBy(seq)
    parts = numbered.select(*keys, seq, BLOCK, "_before", "_total", F.split(text, r"[\n\r]", -1).alias("_parts"))
    parts = parts.withColumn("_breaks", F.size("_parts") - 1).withColumn("_end", F.element_at("_parts", -1))
    cut = parts.select(
        "*",
        F.lag("_end").over(in_block).alias("_previous_end"),
        F.lag("_breaks").over(in_block).alias("_previous_breaks"),
        F.lead("_breaks").over(in_block).alias("_next_breaks"),
    )
    first = F.element_at("_parts", 1)
    starts_whole = F.coalesce((F.col("_breaks") > 0) & (F.col("_previous_breaks") > 0), F.lit(False))
    end_is_used = F.coalesce((F.col("_breaks") > 0) & (F.col("_next_breaks") > 0), F.lit(False))

    inner = F.slice("_parts", 2, F.greatest(F.col("_breaks") - 1, F.lit(0)))
    ready = F.when(starts_whole, F.concat(F.array(F.concat("_previous_end", first)), inner)).otherwise(inner)
    offset = F.when(starts_whole, 0).otherwise(1)
    whole = cut.select(*keys, seq, (F.col("_before") + offset).alias("_at"), F.posexplode(ready).alias("_pos", "line"))
    whole = whole.select(*keys, seq, (F.col("_at") + F.col("_pos")).alias("line_no"), "line")

    head = F.when(~starts_whole, F.struct(F.col("_before").alias("line_no"), first.alias("piece")))
    tail = F.when(
        (F.col("_breaks") > 0) & ~end_is_used,
        F.struct((F.col("_before") + F.col("_breaks")).alias("line_no"), F.col("_end").alias("piece")),
    )
    pieces = cut.select(*keys, seq, "_total", F.inline(F.array_compact(F.array(head, tail))))
    joined = pieces.where(F.col("line_no") < F.col("_total")).groupBy(*keys, "line_no").agg(
        F.max(seq).alias(seq), F.array_sort(F.collect_list(F.struct(seq, "piece"))).alias("_pieces")
    )
    across = joined.select(*keys, seq, "line_no", F.array_join(F.col("_pieces.piece"), "").alias("line"))
    return whole.unionByName(across).where(~is_blank(F.col("line")))


# --- loss series ---------------------------------------------------------------------------


def loss_points(lines: DataFrame, keep: Sequence[str] = ("job_id", "seq"), line: str = "line") -> DataFrame:
    """Lines that report a loss -> keep, explicit_step (null when the line has none), loss."""
    text = F.col(line)
    likely = lines.where(F.contains(F.lower(text), F.lit("loss")))  # far cheaper than the pattern
    found = likely.select(*keep, F.regexp_extract(text, LOSS, 1).alias("_loss"), F.regexp_extract(text, STEP, 1).alias("_step"))
    step = F.nullif("_step", F.lit(""))  # a cast that fails costs an exception, a null nothing
    return found.where(F.col("_loss") != "").select(
        *keep, step.try_cast("bigint").alias("explicit_step"), F.col("_loss").try_cast("double").alias("loss")
    )


def infer_steps(
    points: DataFrame, key: str = "job_id", order: Sequence[str] = ("seq",), span: int = DEFAULT_SPAN
) -> DataFrame:
    """Add `step`: the explicit one, else one more than the previous point's, counting from 0.

    Inside a block the step is known from the block's last explicit step, or else relative to
    where the previous block ended; one row per block is then scanned per job to find that.
    """
    in_block = W.partitionBy(key, BLOCK).orderBy(*order)
    numbered = in_blocks(points, [key], order[0], span).withColumn("_n", F.row_number().over(in_block))
    # Between explicit steps, step and row number grow alike: their difference stays that of the last one.
    lead = F.last(F.col("explicit_step") - F.col("_n"), ignorenulls=True)
    known = F.col("_n") + lead.over(in_block.rowsBetween(W.unboundedPreceding, W.currentRow))
    local = numbered.withColumn("_known", known)

    ends = local.groupBy(key, BLOCK).agg(
        F.max("_n").cast("bigint").alias("_points"),
        F.max_by("_known", "_n").alias("_end"),
        # counting losses keeps both uses of `local` on the same columns, so Spark reuses its shuffle
        F.count("loss").alias("_losses"),
    ).where(F.col("_losses") >= 0)
    by_key = W.partitionBy(key).orderBy(BLOCK)
    earlier = by_key.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_seen", F.coalesce(F.sum("_points").over(earlier), F.lit(0)))
    # Carried step = last known block end + the points of the blocks after it.
    at_end = F.when(F.col("_end").isNotNull(), F.struct(F.col("_end").alias("end"), (F.col("_seen") + F.col("_points")).alias("seen")))
    ends = ends.withColumn("_anchor", at_end)
    anchor = F.last("_anchor", ignorenulls=True).over(earlier)
    ends = ends.withColumn("_last", anchor)
    carried = F.coalesce(F.col("_last.end") + F.col("_seen") - F.col("_last.seen"), F.col("_seen"))
    blocks = ends.select(key, BLOCK, carried.alias("_carried"))

    step = F.coalesce(F.col("_known"), F.col("_carried") + F.col("_n")).cast("bigint")
    return (
        join_blocks(local, blocks, [key])
        .withColumn("step", step)
        .drop(BLOCK, "_n", "_known", "_carried")
    )


def loss_series(
    lines: DataFrame, key: str = "job_id", order: Sequence[str] = ("seq",), span: int = DEFAULT_SPAN
) -> DataFrame:
    """key, order columns, step, loss: the loss curve of every job. Validation and training
    losses both count, as in the log they come from; `checkpoint_losses` keeps them apart."""
    points = infer_steps(loss_points(lines, [key, *order]), key, order, span)
    return points.select(key, *order, "step", "loss")


def points_per_job(series: DataFrame, key: str = "job_id") -> DataFrame:
    return series.groupBy(key).agg(F.count(F.lit(1)).alias("n_points"))


def first_and_last(series: DataFrame, key: str = "job_id", seq: str = "seq") -> DataFrame:
    """First and last (step, loss) of every job; fixed-width state, combined map-side."""
    return series.groupBy(key).agg(
        F.min_by("step", seq).alias("first_step"),
        F.min_by("loss", seq).alias("first_loss"),
        F.max_by("step", seq).alias("last_step"),
        F.max_by("loss", seq).alias("last_loss"),
    )


def every_kth(
    df: DataFrame, k: int, keys: Sequence[str] = ("job_id",), order: Sequence[str] = ("seq",), span: int = DEFAULT_SPAN
) -> DataFrame:
    """Rows 0, k, 2k, … of every key, with `kth` counting 0, 1, 2, …"""
    numbered = running_total(df, keys, order, F.lit(1), "_row", span=span, exclusive=True)
    return (
        numbered.where(F.col("_row") % k == 0).withColumn("kth", div(F.col("_row"), k)).drop("_row")
    )


def loss_trajectory(
    series: DataFrame,
    key: str = "job_id",
    order: Sequence[str] = ("seq",),
    k: int = 4,
    per_piece: int = 1000,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Every k-th loss to 3 decimals (half up), joined by arrows -> key, piece, trajectory.

    A job's trajectory is cut into pieces of `per_piece` losses, so that no cell grows with the
    job; most jobs have one piece, and the pieces of a longer one join by the same arrow.
    """
    sampled = every_kth(series, k, [key], order, span)
    shown = sampled.select(
        key,
        div(F.col("kth"), per_piece).alias("piece"),
        F.struct("kth", F.format_string("%.3f", "loss").alias("text")).alias("_point"),
    )
    grouped = shown.groupBy(key, "piece").agg(F.array_sort(F.collect_list("_point")).alias("_points"))
    return grouped.select(key, "piece", F.array_join(F.col("_points.text"), " → ").alias("trajectory"))


def last_wins(df: DataFrame, keys: Sequence[str], value: str, seq: str = "seq") -> DataFrame:
    """Keep the latest `value` of every key, as building a dictionary in order would."""
    return df.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


# --- tails ---------------------------------------------------------------------------------


def ring(lines: DataFrame, n: int = RING_LINES, key: str = "job_id", order: Sequence[str] = ("seq",)) -> DataFrame:
    """The last `n` lines of every job, one row each."""
    if beyond_limit(lines, n):
        return newest_rows(lines, [key], order, n)
    return last_rows(lines, [key], order, n).drop("_from_end")


def log_tail(
    lines: DataFrame,
    n: int = TAIL_LINES,
    key: str = "job_id",
    order: Sequence[str] = ("seq",),
    line: str = "line",
    span: int = 1 << 20,
) -> DataFrame:
    """The last `n` lines of every job (of the ring's, if that is shorter) joined by line breaks."""
    kept = last_rows(lines.select(key, *order, line), [key], order, min(n, RING_LINES), span)
    gathered = kept.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_from_end")).alias("at"), F.col(line).alias("line")))).alias("_l")
    )
    return gathered.select(key, F.array_join(F.col("_l.line"), "\n").alias("tail"), F.size("_l").cast("bigint").alias("n_lines"))


# --- job status ----------------------------------------------------------------------------


def job_status(events: DataFrame, as_of: Column, key: str = "job_id") -> DataFrame:
    """Fold (job_id, ts, kind, error) events into one row per job.

    Kinds: submitted, started, stop_requested, returned, failed. A failure wins over a stop; a
    stop counts if it was requested by the time the job returned. `as_of` stands in for now.
    """
    def at(kind: str, agg) -> Column:
        return agg(F.when(F.col("kind") == kind, F.col("ts").cast("timestamp")))

    folded = events.groupBy(key).agg(
        at("started", F.min).alias("started_at"),
        at("stop_requested", F.min).alias("_stop"),
        at("returned", F.max).alias("_returned"),
        at("failed", F.max).alias("_failed"),
        F.max_by("error", F.when(F.col("kind") == "failed", F.col("ts"))).alias("error"),
    )
    status = (
        F.when(F.col("_failed").isNotNull(), "failed")
        .when(F.col("_returned").isNotNull(), F.when(F.col("_stop") <= F.col("_returned"), "stopped").otherwise("finished"))
        .when(F.col("started_at").isNotNull(), "running")
        .otherwise("pending")
    )
    finished = F.coalesce(F.col("_failed"), F.col("_returned"))
    seconds = (F.unix_micros(F.coalesce(finished, as_of)) - F.unix_micros("started_at")) / 1e6
    return folded.select(
        key,
        status.alias("status"),
        "started_at",
        finished.alias("finished_at"),
        F.coalesce(seconds, F.lit(0.0)).alias("elapsed"),
        "error",
    )


def job_log(lines: DataFrame, events: DataFrame, key: str = "job_id") -> DataFrame:
    """The whole log of every job -> key, at, seq, line: its own lines and what its manager adds.

    A line is added when a stop is requested, after all output up to that time, and a failed job's error
    text after everything else. `at` is the time in microseconds; (at, seq) orders a job's log.
    """
    own = lines.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("seq").cast("bigint").alias("seq"), "line")
    last = F.lit(AFTER_ALL).alias("seq")
    stops = events.where(F.col("kind") == "stop_requested").select(
        key, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), last, F.lit(STOP_LINE).alias("line")
    )
    failed = (
        events.where((F.col("kind") == "failed") & F.col("error").isNotNull())
        .groupBy(key)
        .agg(F.max_by("error", "ts").alias("line"))
        .select(key, F.lit(AFTER_ALL).alias("at"), last, "line")
    )
    return own.unionByName(stops).unionByName(failed)


def _picked(
    jobs: DataFrame, lines: DataFrame, events: DataFrame, key: str, job_id: int | None, newest: bool
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The inputs of one job, or of all; rows of other jobs go before anything is aggregated."""
    if newest:
        jobs = newest_job(jobs, key)
        lines, events = (d.join(F.broadcast(jobs.select(key)), key, "left_semi") for d in (lines, events))  # one row
    elif job_id is not None:
        jobs, lines, events = (get_job(d, job_id, key) for d in (jobs, lines, events))
    return jobs, lines, events


def job_series(
    jobs: DataFrame, lines: DataFrame, events: DataFrame, key: str = "job_id", job_id: int | None = None, newest: bool = False
) -> DataFrame:
    """The loss points a snapshot shows -> key, at, seq, step, loss, one row a point, of all jobs or one.

    As in the snapshot, what an error text says of a loss counts too.
    """
    _, lines, events = _picked(jobs, lines, events, key, job_id, newest)
    return loss_series(job_log(lines, events, key), key, ("at", "seq"), LOG_SPAN)


def job_listing(jobs: DataFrame, key: str = "job_id", name: str = "name") -> DataFrame:
    """Newest first: the entry text of every job, `#id icon name`."""
    icon = F.coalesce(F.try_element_at(literal_map(dims.STATUS_ICONS), F.col("status")), F.lit(""))
    entry = F.concat(F.lit("#"), F.col(key).cast("string"), F.lit(" "), icon, F.lit(" "), F.col(name))
    return jobs.select(key, "status", entry.alias("entry")).orderBy(F.col(key).desc())


def newest_job(jobs: DataFrame, key: str = "job_id") -> DataFrame:
    return jobs.orderBy(F.col(key).desc()).limit(1)


def get_job(jobs: DataFrame, job_id: int, key: str = "job_id") -> DataFrame:
    return jobs.where(F.col(key) == job_id)


def job_snapshots(
    jobs: DataFrame,
    lines: DataFrame,
    events: DataFrame,
    as_of: Column,
    key: str = "job_id",
    tail: int = TAIL_LINES,
    job_id: int | None = None,
    newest: bool = False,
) -> DataFrame:
    """One row per job (or one job): status, elapsed, loss points and log tail (`job_series` has the points).

    `jobs` is (job_id, name). The four parts have one row per job each, so their joins carry no
    skew; picking a job filters the inputs before anything is aggregated.
    """
    jobs, lines, events = _picked(jobs, lines, events, key, job_id, newest)
    lines = job_log(lines, events, key)
    points = loss_points(lines, [key]).groupBy(key).agg(F.count(F.lit(1)).alias("n_points"))
    joined = (
        jobs.select(key, "name")
        .join(job_status(events, as_of, key), key, "left")
        .join(points, key, "left")
        .join(log_tail(lines, tail, key, ("at", "seq"), span=LOG_SPAN), key, "left")
    )
    return joined.select(
        key,
        "name",
        F.coalesce("status", F.lit("pending")).alias("status"),
        F.coalesce("elapsed", F.lit(0.0)).alias("elapsed"),
        F.coalesce("n_points", F.lit(0)).alias("n_points"),
        F.coalesce("tail", F.lit("")).alias("tail"),
    )


# --- log headlines and checkpoints ----------------------------------------------------------


# kind -> pattern, its iteration group, its value group, and text every hit contains
PATTERNS: dict[str, tuple[str, int | None, int | None, str]] = {
    "val_loss": (VAL_LOSS, None, 1, "Val loss "),
    "tokens_per_second": (TOKENS_PER_SECOND, None, 1, "Tokens/sec "),
    "peak_memory": (PEAK_MEMORY, None, 1, "Peak mem "),
    "iter_val_loss": (ITER_VAL_LOSS, 1, 2, ": Val loss "),
    "iter_train_loss": (ITER_TRAIN_LOSS, 1, 2, ": Train loss "),
    "iter_saved": (ITER_SAVED, 1, None, ": Saved adapter weights"),
}
HEADLINES = ("val_loss", "tokens_per_second", "peak_memory")
LOSSES = ("iter_val_loss", "iter_train_loss")


def pattern_hits(
    lines: DataFrame,
    keep: Sequence[str] = ("job_id", "seq"),
    line: str = "line",
    kinds: Sequence[str] = tuple(PATTERNS),
) -> DataFrame:
    """Every hit of the report patterns -> keep, kind, pos (within the line), iter, value.

    A plain substring test decides which patterns a line is matched against, if any.
    """
    text = F.col(line)

    def hits(kind: str) -> Column:
        pattern, iter_group, value_group, marker = PATTERNS[kind]
        iters = F.regexp_extract_all(text, F.lit(pattern), F.lit(iter_group or value_group))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group or iter_group))
        each = F.transform(
            iters if value_group is None else values,
            lambda x, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("pos"),
                (F.lit(None) if iter_group is None else F.get(iters, i) if value_group else x).try_cast("bigint").alias("iter"),
                (F.lit(None).cast("string") if value_group is None else x).alias("value"),
            ),
        )
        return F.when(F.contains(text, F.lit(marker)), each).otherwise(
            F.expr("cast(array() as array<struct<kind:string,pos:int,iter:bigint,value:string>>)")
        )

    reports = F.lit(False)
    for kind in kinds:
        reports = reports | F.contains(text, F.lit(PATTERNS[kind][3]))
    return lines.where(reports).select(*keep, F.inline(F.concat(*map(hits, kinds))))


def eval_losses(lines: DataFrame, key: str = "job_id", seq: str = "seq") -> DataFrame:
    """Validation and training losses as separate series -> key, seq, kind, step, loss."""
    hits = pattern_hits(lines, [key, seq], kinds=LOSSES)
    kind = F.when(F.col("kind") == "iter_val_loss", "val").otherwise("train")
    return hits.select(key, seq, kind.alias("kind"), F.col("iter").alias("step"), F.col("value").try_cast("double").alias("loss"))


def log_headlines(lines: DataFrame, key: str = "job_id", seq: str = "seq") -> DataFrame:
    """Per log: first and last validation loss, last tokens/sec (rounded), peak memory.

    Values keep the text they were printed with; a log without one shows a dash.
    """
    hits = pattern_hits(lines, [key, seq], kinds=HEADLINES)
    at = F.struct(seq, "pos")

    def of(kind: str, order: Column) -> Column:
        return F.when(F.col("kind") == kind, order)

    number = F.col("value").try_cast("double")
    largest_first = F.struct(number, -F.col(seq), -F.col("pos"))
    folded = hits.groupBy(key).agg(
        F.min_by("value", of("val_loss", at)).alias("val_first"),
        F.max_by("value", of("val_loss", at)).alias("val_last"),
        F.max_by("value", of("tokens_per_second", at)).alias("tps"),
        F.max_by("value", of("peak_memory", largest_first)).alias("mem"),
    )
    rounded = F.bround(F.col("tps").try_cast("double"), 0).cast("bigint").cast("string")
    reported = lines.select(key).distinct().join(folded, key, "left")
    return reported.select(
        key,
        *[F.coalesce(c, F.lit(MISSING)).alias(c) for c in ("val_first", "val_last")],
        F.coalesce(rounded, F.lit(MISSING)).alias("tps"),
        F.coalesce("mem", F.lit(MISSING)).alias("mem"),
    )


def checkpoint_losses(lines: DataFrame, key: str = "job_id", seq: str = "seq", once: bool = False) -> DataFrame:
    """Saved iterations with the last validation and training loss of the same iteration.

    -> key, iter, checkpoint, val_loss, train_loss, in order of key and iteration. An iteration saved
    n times is listed n times; `once` lists it once and adds `times_saved`.
    """
    hits = pattern_hits(lines, [key, seq], kinds=(*LOSSES, "iter_saved"))
    at = F.struct(seq, "pos")
    per_iter = hits.groupBy(key, "iter").agg(
        F.max_by("value", F.when(F.col("kind") == "iter_val_loss", at)).alias("val_loss"),
        F.max_by("value", F.when(F.col("kind") == "iter_train_loss", at)).alias("train_loss"),
        F.count_if(F.col("kind") == "iter_saved").alias("times_saved"),
    )
    saved = per_iter.where(F.col("times_saved") > 0).select(
        key,
        "iter",
        F.format_string(CHECKPOINT_NAME, "iter").alias("checkpoint"),
        F.coalesce("val_loss", F.lit(MISSING)).alias("val_loss"),
        F.coalesce("train_loss", F.lit(MISSING)).alias("train_loss"),
        "times_saved",
    )
    if once:
        return saved.orderBy(key, "iter")
    # repeated in two steps so that neither array grows with a count in the millions
    step = 1 << 16
    outer = saved.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("times_saved") - 1, F.lit(step))))
    left = F.least(F.lit(step), F.col("times_saved") - F.col("_from"))
    inner = outer.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), left)))
    return inner.drop("_from", "_copy", "times_saved").orderBy(key, "iter")


# --- stalls --------------------------------------------------------------------------------


def stalls(
    lines: DataFrame,
    quiet_seconds: int = STALL_SECONDS,
    key: str = "job_id",
    ts: str = "ts",
    as_of: Column | None = None,
) -> DataFrame:
    """Gaps of more than `quiet_seconds` without output -> key, last_line_at, next_line_at, quiet.

    Two lines that far apart never share a time slot of that width, so the lines are first
    reduced to one (min, max) per job and slot; the ordered scan sees slots, not lines.
    `as_of` also reports jobs quiet since their last line (next_line_at is null).
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = micros - F.pmod(micros, F.lit(quiet_seconds * 1_000_000))
    slots = lines.select(key, micros.alias("_t"), slot.alias("_slot")).groupBy(key, "_slot").agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last")
    )
    following = F.lead("_first").over(W.partitionBy(key).orderBy("_slot"))
    gaps = slots.select(key, "_last", following.alias("_next"))
    end = F.col("_next") if as_of is None else F.coalesce("_next", F.unix_micros(as_of))
    quiet = end - F.col("_last")
    return gaps.where(quiet > quiet_seconds * 1_000_000).select(
        key,
        F.timestamp_micros("_last").alias("last_line_at"),
        F.timestamp_micros("_next").alias("next_line_at"),
        (quiet / 1e6).alias("quiet"),
    )
