"""Rows of a stream in the order of their sequence numbers, whatever order and batches they arrive in.

A row waits in the state of its bucket of keys until the watermark says that nothing before it is still to
come. Many keys share a bucket, as every call for a group costs far more than a row. Waiting rows lie in
a map keyed by time slot; one event-time timer per slot takes that slot out, sorts it and hands it on. So a batch writes only its own rows, and a slot is read once. Rows that come after
their slot has left are handed over as late, never dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MARKS = "at timestamp"
END_OF_TIME = "9999-01-01 00:00:00"
NONE = -(1 << 63)  # stands for a missing number or time, as a null would turn the column into floats
LATE = "late"
# keys are dealt into so many groups of state; a group's rows of one time slot are in memory at once
BUCKETS = 1024
# Columns inside the processor; Spark hands rows over as named tuples, which know no leading underscore.
SEQ, BUCKET = "seq_no", "bucket_no"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams with timers, which need RocksDB; `spark` keeps its settings."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


# --- the clock -------------------------------------------------------------------------------


def beat(spark: SparkSession, clock: str, at: str) -> str:
    """Tell the streams that read `clock` that all rows up to the time `at` have been sent.

    Each call adds one mark to the folder. The first call makes the folder, so call it before a stream
    starts; a mark at `END_OF_TIME` ends the input.
    """
    spark.range(1).select(F.lit(at).cast("timestamp").alias("at")).coalesce(1).write.mode("append").parquet(clock)
    return clock


def _never_null(dtype: T.DataType) -> Column:
    return F.lit("").cast(dtype) if isinstance(dtype, T.StringType) else F.lit(0).cast(dtype)


def timed(
    rows: DataFrame, keys: Sequence[str], ts: str, lateness: str, clock: str | None, data_drives: bool = True, buckets: int | None = None
) -> GroupedData:
    """`rows` by key, or by so many buckets of keys, with `at_ms` and `at_us` in place of `ts`, under a watermark `lateness` behind the newest time.

    Marks of `clock` count as times seen and form a group of their own (the last part of the key is
    true). With `data_drives` false only marks move the watermark. Once it is set the time is a plain
    number, so Spark drops no row for it. A null key stops the job. No number is null, marks included:
    Spark hands whole numbers with a null among them to Python as floats.
    """
    dtype = {f.name: f.dataType for f in rows.schema.fields}
    at = F.col(ts).cast("timestamp")
    numbers = {name: F.coalesce(c, F.lit(NONE)) for name, c in (("at_ms", F.unix_millis(at)), ("at_us", F.unix_micros(at)))}
    for k in keys:
        complaint = F.raise_error(F.lit(f"{k} must not be null")).cast(dtype[k])
        numbers[k] = F.coalesce(F.col(k), complaint)
    seen = at if data_drives else F.timestamp_seconds(F.lit(0))
    marked = rows.withColumns(numbers | {"seen": seen, "is_mark": F.lit(False)}).drop(ts)
    if clock:
        marks = rows.sparkSession.readStream.schema(MARKS).parquet(clock)
        blank = {f.name: F.lit(NONE) if isinstance(f.dataType, T.LongType) else F.lit(None).cast(f.dataType) for f in marked.schema.fields}
        blank |= {k: _never_null(dtype[k]) for k in keys} | {"seen": F.col("at"), "is_mark": F.lit(True)}
        marked = marked.unionByName(marks.select(*[c.alias(name) for name, c in blank.items()]))
    marked = marked.withWatermark("seen", lateness).drop("seen")
    if not buckets:
        return marked.groupBy(*keys, "is_mark")
    return marked.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy(BUCKET, "is_mark")


# --- the processor -----------------------------------------------------------------------------


def _to_bytes(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_all().to_pandas()


def nullable(numbers: Sequence) -> pd.api.extensions.ExtensionArray:
    """Whole numbers, or their text, where `NONE` and None are missing."""
    return pd.array([None if x is None or int(x) == NONE else int(x) for x in numbers], dtype="Int64")


# (state of the key so far, number, other values of the row) -> (state, output rows)
Advance = Callable[..., tuple[tuple, list[tuple]]]


class InOrder(StatefulProcessor):
    """Feeds the rows of every key of a bucket to `advance` in the order of `seq_no`, each time slot as its time has come."""

    def __init__(self, keys: Sequence[str], values: Sequence[str], slot_ms: int, advance: Advance, start: tuple, late: Callable, made: list[str]):
        self.keys, self.values, self.slot_ms = list(keys), list(values), slot_ms
        self.advance, self.start = advance, start
        self.late, self.made = late, made

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, arrival long", "rows binary")
        self.arrivals = handle.getValueState("arrivals", "n long")
        # by key: its last number and state
        self.so_far = handle.getValueState("so_far", "states binary")

    def _out(self, source: pd.DataFrame, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        """`rows` with the keys of the `source` rows they come from."""
        rows = rows.assign(**{k: source[k].to_numpy() for k in self.keys}, **{LATE: late})
        return rows[[*self.keys, *self.made, LATE]]

    def _ids(self, frame: pd.DataFrame) -> list[tuple]:
        return list(zip(*(frame[k].tolist() for k in self.keys), strict=True))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[-1]:  # marks of the clock
            return
        frame = pd.concat(list(rows), ignore_index=True)
        slot = frame["at_ms"] // self.slot_ms
        gone = (frame[SEQ] == NONE) | ((slot + 1) * self.slot_ms <= timerValues.getCurrentWatermarkInMs())
        if gone.any():
            yield self._out(frame[gone], self.late(frame[gone]), True)
        frame, slot = frame[~gone], slot[~gone]
        if len(frame):
            (arrivals,) = self.arrivals.get() or (0,)  # every call is a round trip to the JVM, so `exists` is not asked first
            for at, part in frame[[*self.keys, SEQ, *self.values]].groupby(slot):
                self.waiting.updateValue((int(at), arrivals), (_to_bytes(part),))
                self.handle.registerTimer((int(at) + 1) * self.slot_ms)
            self.arrivals.update((arrivals + 1,))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        due = sorted(k for k in self.waiting.keys() if (k[0] + 1) * self.slot_ms <= until)
        if not due:  # taken with an earlier slot
            return
        known = self.so_far.get()
        states: dict[tuple, tuple] = pickle.loads(known[0]) if known else {}
        for slot in sorted({k[0] for k in due}):
            mine = [k for k in due if k[0] == slot]
            frame = pd.concat([_from_bytes(self.waiting.getValue(k)[0]) for k in mine], ignore_index=True)
            for k in mine:
                self.waiting.removeKey(k)
            frame = frame.sort_values(SEQ, kind="stable", ignore_index=True)
            ids, numbers = self._ids(frame), frame[SEQ].tolist()
            behind = [i in states and n <= states[i][0] for i, n in zip(ids, numbers, strict=True)]
            if any(behind):  # their time says later, their number earlier
                yield self._out(frame[behind], self.late(frame[behind]), True)
                frame = frame[[not x for x in behind]]
                ids, numbers = self._ids(frame), frame[SEQ].tolist()
            at, made = [], []
            for i, (owner, n, *values) in enumerate(zip(ids, numbers, *(frame[c].tolist() for c in self.values), strict=True)):
                _, state = states.get(owner, (None, self.start))
                state, rows = self.advance(state, n, *values)
                states[owner] = (n, state)
                made += rows
                at += [i] * len(rows)
            if made:
                yield self._out(frame.iloc[at], pd.DataFrame(made, columns=self.made), False)
        self.so_far.update((pickle.dumps(states),))

    def close(self) -> None:
        pass


def in_order(
    rows: DataFrame,
    keys: Sequence[str],
    ts: str,
    lateness: str,
    clock: str | None,
    slot_seconds: int,
    out: T.StructType,
    advance: Advance,
    start: tuple,
    late: Callable[[pd.DataFrame], pd.DataFrame],
    buckets: int = BUCKETS,
) -> DataFrame:
    """Run `advance` over every key's rows in the order of `seq_no` -> keys, the columns of `out`, late.

    `advance` gets the state of the key (`start` at first), the row's number and its other columns in order.
    Keys are dealt into `buckets`; more of them hold fewer rows in memory at once and cost more calls.

    A row waits until all of its slot of `slot_seconds` lies `lateness` behind the newest row or mark.
    Within a key, times must not fall as numbers grow; a row that breaks this, comes too late, or has no
    number or time is given to `late`, whose rows leave with `late` true.
    """
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([*[T.StructField(k, types[k]) for k in keys], *out.fields, T.StructField(LATE, T.BooleanType())])
    values = [f.name for f in rows.schema.fields if f.name not in {*keys, ts, SEQ}]
    numbered = rows.withColumn(SEQ, F.coalesce(F.col(SEQ).cast("bigint"), F.lit(NONE)))
    ready = timed(numbered, keys, ts, lateness, clock, buckets=buckets)
    processor = InOrder(keys, values, slot_seconds * 1000, advance, start, late, out.fieldNames())
    return ready.transformWithStateInPandas(processor, schema, "append", "eventTime")
