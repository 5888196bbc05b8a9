"""Log operators over streams: lines from chunks, loss series, stalls.

Output does not depend on how rows are dealt into micro-batches: rows wait, up to a stated lateness,
until their turn has come (see `ordered`), and what comes later still leaves as `late`. State is
kept by buckets of jobs, or by job for stalls: waiting rows, and a text tail, a counter or the open spells. What does not need state
(matching, parsing, dropping lines without a loss) runs before the shuffle. Streams need a session of
`stream_session`; at the end of a finite input, `run_to_end` lets all waiting rows go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tunedata.operators.logs import STALL_SECONDS, loss_points
from tunedata.streaming.ordered import END_OF_TIME, LATE, NONE, SEQ, beat, in_order, nullable, stream_session, timed

__all__ = ["beat", "read_stream", "refreshed", "run_to_end", "run_to_files", "stream_lines", "stream_loss_series", "stream_session", "stream_stalls", "upsert", "watch"]

MAX_BYTES_PER_TRIGGER = 1 << 30
REFRESH = "2 seconds"
SLOT_SECONDS = 60


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    format: str = "parquet",
    max_bytes: int = MAX_BYTES_PER_TRIGGER,
    max_files: int | None = None,
) -> DataFrame:
    """Files as they arrive, in micro-batches of `max_bytes` or, if given, `max_files`. The size of a
    batch bounds its memory and changes no result."""
    bound = ("maxFilesPerTrigger", max_files) if max_files else ("maxBytesPerTrigger", max_bytes)
    return spark.readStream.schema(schema).format(format).option(*bound).load(path)


def stream_lines(
    chunks: DataFrame,
    lateness: str,
    clock: str | None = None,
    keys: Sequence[str] = ("job_id", "channel"),
    seq: str = "seq",
    ts: str = "ts",
    text: str = "chunk",
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Complete lines of chunked output -> keys, seq, line_no, line, late (see `relines`).

    A late chunk leaves uncut as `line`, without a line number and with `late` true.
    """
    out = T.StructType().add(seq, "long").add("line_no", "long").add("line", "string")

    def cut(state: tuple, at: int, chunk: str) -> tuple[tuple, list[tuple]]:
        tail, line_no = state
        # one character ends a line; str.splitlines knows more terminators than these two
        *done, tail = (tail + chunk).replace("\r", "\n").split("\n")
        rows = [(at, line_no + i, line) for i, line in enumerate(done) if line.strip()]
        return (tail, line_no + len(done)), rows

    def late(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({seq: nullable(frame[SEQ]), "line_no": nullable([None] * len(frame)), "line": frame["content"].to_numpy()})

    chosen = chunks.where(F.col(text).isNotNull()).select(*keys, ts, F.col(seq).alias(SEQ), F.col(text).alias("content"))
    return in_order(chosen, keys, ts, lateness, clock, slot_seconds, out, cut, ("", 0), late)


def stream_loss_series(
    lines: DataFrame,
    lateness: str,
    clock: str | None = None,
    key: str = "job_id",
    seq: str = "seq",
    ts: str = "ts",
    line: str = "line",
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """The loss curve of every job as it grows -> key, seq, step, loss, late (see `loss_series`).

    A late point leaves with its explicit step, if it has one, and `late` true.
    """
    points = loss_points(lines, [key, seq, ts], line)
    out = T.StructType().add(seq, "long").add("step", "long").add("loss", "double")

    def advance(state: tuple, at: int, explicit: str | None, loss: float) -> tuple[tuple, list[tuple]]:
        step = state[0] + 1 if explicit is None else int(explicit)
        return (step,), [(at, step, loss)]

    def late(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({seq: nullable(frame[SEQ]), "step": nullable(frame["explicit_step"]), "loss": frame["loss"].to_numpy()})

    # numbers travel as text: a null would turn a column of whole numbers into floats
    points = points.select(key, ts, F.col(seq).alias(SEQ), F.col("explicit_step").cast("string"), "loss")
    return in_order(points, [key], ts, lateness, clock, slot_seconds, out, advance, (0,), late)


class Spells(StatefulProcessor):
    """Per job: the spells of activity that may still grow, as (start, end, lines) in microseconds."""

    def __init__(self, key: str, quiet: int, lateness: int):
        self.key, self.quiet, self.lateness = key, quiet, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")
        self.told = handle.getValueState("told", "until long, timer long")  # told up to this time; the timer that is set

    def _rows(self, key: tuple, spells: list, late: bool) -> pd.DataFrame:
        columns = list(zip(*spells, strict=True)) if spells else [(), (), ()]
        stamps = [pd.to_datetime(pd.Series(c, dtype="int64"), unit="us", utc=True) for c in columns[:2]]
        return pd.DataFrame({self.key: [key[0]] * len(spells), "active_from": stamps[0], "last_line_at": stamps[1], "n_lines": columns[2], LATE: late})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[-1]:  # marks of the clock
            return
        at = pd.concat([f["at_us"] for f in rows]).sort_values()
        at = at[at != NONE]
        until, timer = self.told.get() if self.told.exists() else (None, None)
        if until is not None and (at <= until).any():  # their spell has been told
            yield self._rows(key, [(t, t, 1) for t in at[at <= until]], True)
            at = at[at > until]
        if not len(at):
            return
        spells = [(int(a), int(b), int(n)) for a, b, n in self.open.get()] if self.open.exists() else []
        apart = np.flatnonzero(np.diff(at.to_numpy()) > self.quiet) + 1
        spells += [(int(x[0]), int(x[-1]), len(x)) for x in np.split(at.to_numpy(), apart)]
        merged: list[tuple[int, int, int]] = []
        for a, b, n in sorted(spells):  # a line between two spells may join them
            if merged and a - merged[-1][1] <= self.quiet:
                first, last, count = merged.pop()
                a, b, n = first, max(last, b), count + n
            merged.append((a, b, n))
        # what the job's own clock has left behind can no longer grow
        over = merged[-1][1] - self.quiet - self.lateness
        done = [s for s in merged[:-1] if s[1] <= over]
        left = merged[len(done) :]
        self.open.put(left)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = (left[-1][1] + self.quiet) // 1000 + 1
        self.handle.registerTimer(timer)
        self.told.update((done[-1][1] if done else until, timer))
        if done:
            yield self._rows(key, done, False)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        left = [(int(a), int(b), int(n)) for a, b, n in self.open.get()] if self.open.exists() else []
        if left:
            self.open.clear()
            self.told.update((left[-1][1], None))
            yield self._rows(key, left, False)

    def close(self) -> None:
        pass


def stream_stalls(
    lines: DataFrame,
    clock: str,
    quiet_seconds: int = STALL_SECONDS,
    lateness_seconds: int = STALL_SECONDS,
    key: str = "job_id",
    ts: str = "ts",
) -> DataFrame:
    """Jobs that went quiet -> key, active_from, last_line_at, n_lines, late, once per quiet spell.

    A spell is over when the job's own next line, more than `quiet_seconds` on, is followed up to
    `lateness_seconds`, or when a mark of `clock` says that time has passed the quiet. One timer per job
    waits for that. Lines of other jobs move no job's clock, so a fast job closes no slow one. A line
    that comes after its spell was told leaves alone with `late` true; a line without a time is left out.
    """
    types = {f.name: f.dataType for f in lines.schema.fields}
    out = T.StructType().add(key, types[key]).add("active_from", "timestamp").add("last_line_at", "timestamp").add("n_lines", "long").add(LATE, "boolean")
    ready = timed(lines.select(key, ts), [key], ts, "0 seconds", clock, data_drives=False)
    processor = Spells(key, quiet_seconds * 1_000_000, lateness_seconds * 1_000_000)
    return ready.transformWithStateInPandas(processor, out, "append", "eventTime")


# --- running -------------------------------------------------------------------------------------


def run_to_files(stream: DataFrame, path: str, checkpoint: str, refresh: str | None = None) -> StreamingQuery:
    """Append a stream to Parquet, exactly once. Without `refresh` it stops at the input's end."""
    trigger = {"processingTime": refresh} if refresh else {"availableNow": True}
    writer = stream.writeStream.format("parquet").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_to_end(stream: DataFrame, path: str, checkpoint: str, clock: str) -> None:
    """All of a finite input: what is there is read, then the clock ends and every waiting row leaves."""
    run_to_files(stream, path, checkpoint).awaitTermination()
    beat(stream.sparkSession, clock, END_OF_TIME)
    run_to_files(stream, path, checkpoint).awaitTermination()


def upsert(path: str) -> Callable[[DataFrame, int], None]:
    """For `watch`: keep each batch as the folder path/batch=<id>. A batch that is sent again after a
    failure replaces its own folder, so the table holds every row once (see `refreshed`)."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return keep


def refreshed(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The table `upsert` keeps, with the newest row of every key: of the last batch, then by `order`."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    columns = [c for c in schema.fieldNames() if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("batch", *order)).alias("_row"))
    return newest.select(*keys, "_row.*")


def watch(
    stream: DataFrame, on_refresh: Callable[[DataFrame, int], None], checkpoint: str, refresh: str = REFRESH
) -> StreamingQuery:
    """Hand every micro-batch to `on_refresh(batch, batch_id)`, for a display that follows along.

    After a failure Spark may hand over a batch again under the same id: `on_refresh` must replace, as
    `upsert` does, not append.
    """
    writer = stream.writeStream.foreachBatch(on_refresh).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=refresh).start()
