"""Streams against the batch operators: the same rows whatever their order and however they are dealt."""

import random

import pytest
from pyspark.sql import functions as F
from tests.test_logs import random_lines

from tunedata.operators import logs as L
from tunedata.streaming import logs as S
from tunedata.streaming import ordered


@pytest.fixture(scope="module")
def own(spark):
    return S.stream_session(spark)


def arriving(own, df, path, batches, shuffle=None, columns=None):
    """The rows as one file per micro-batch, in order or shuffled, as a stream."""
    rows = df.collect()
    random.Random(shuffle).shuffle(rows) if shuffle is not None else rows.sort(key=lambda r: r.seq)
    step = max(1, -(-len(rows) // batches))
    for i in range(0, len(rows), step):
        own.createDataFrame(rows[i : i + step], df.schema).coalesce(1).write.mode("append").parquet(path)
    return S.read_stream(own, path, df.schema, max_files=1)


def drained(spark, stream, tmp_path, clock):
    S.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "ck"), clock)
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def timed_lines(spark):
    rows = [(*r, 1_700_000_000 + 7 * i) for i, r in enumerate(random_lines(11, jobs=3, n=120))]
    return spark.createDataFrame(rows, "job_id long, seq long, line string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")


@pytest.mark.parametrize(("batches", "shuffle"), [(1, None), (3, 5), (8, 6)])
def test_loss_series_does_not_depend_on_batches(spark, own, tmp_path, batches, shuffle):
    df = timed_lines(spark)
    clock = S.beat(spark, str(tmp_path / "clock"), "1970-01-01")
    stream = S.stream_loss_series(arriving(own, df, str(tmp_path / "in"), batches, shuffle), "2 hours", clock)
    got = drained(spark, stream, tmp_path, clock)
    assert got.where("late").count() == 0
    want = sorted(tuple(r) for r in L.loss_series(df).select("job_id", "seq", "step", "loss").collect())
    assert sorted(tuple(r) for r in got.select("job_id", "seq", "step", "loss").collect()) == want


@pytest.mark.parametrize(("batches", "shuffle"), [(3, None), (8, 4)])
def test_lines_do_not_depend_on_batches(spark, own, tmp_path, batches, shuffle):
    rng = random.Random(3)
    rows = [(i % 2, "out", i, rng.choice(["a", "b\n", "\r\nc", " \n", "loss", None]), 1000 + i) for i in range(90)]
    df = spark.createDataFrame(rows, "job_id long, channel string, seq long, chunk string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    clock = S.beat(spark, str(tmp_path / "clock"), "1970-01-01")
    stream = S.stream_lines(arriving(own, df, str(tmp_path / "in"), batches, shuffle), "2 minutes", clock, slot_seconds=10)
    got = drained(spark, stream, tmp_path, clock)
    assert got.where("late").count() == 0
    columns = ["job_id", "channel", "seq", "line_no", "line"]
    want = sorted(tuple(r) for r in L.relines(df.where("chunk IS NOT NULL")).select(*columns).collect())
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want


def test_rows_leave_before_the_end_and_late_ones_are_kept(spark, own, tmp_path):
    schema = "job_id long, seq long, line string, ts timestamp"
    batches = [
        [(1, 0, "loss 1.0", 0), (1, 2, "loss 3.0", 20)],
        [(1, 1, "loss 2.0", 10), (1, 9, "loss 9.0", 1000)],  # out of order, within the lateness
        [(2, 3, "loss 4.0", 990)],
        [(1, 3, "step 7: loss 5.0", 30), (2, None, "loss 6.0", 1001), (2, 4, "loss 7.0", None)],  # late, without number, without time
    ]
    for rows in batches:
        df = spark.createDataFrame([(j, s, x, t) for j, s, x, t in rows], "job_id long, seq long, line string, t long")
        df.select("job_id", "seq", "line", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.stream_loss_series(S.read_stream(own, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, max_files=1), "60 seconds", slot_seconds=10)
    S.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = [tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()]
    assert sorted(r[:4] for r in got if not r[4]) == [(1, 0, 1, 1.0), (1, 1, 2, 2.0), (1, 2, 3, 3.0)]
    assert sorted((r[:4] for r in got if r[4]), key=repr) == [(1, 3, 7, 5.0), (2, 4, None, 7.0), (2, None, None, 6.0)]


def test_null_jobs_are_refused(spark, own, tmp_path):
    df = spark.createDataFrame([(None, 1, "loss 1.0", 5)], "job_id long, seq long, line string, t long").withColumn("ts", F.timestamp_seconds("t"))
    query = S.run_to_files(S.stream_loss_series(arriving(own, df, str(tmp_path / "in"), 1), "1 minute"), str(tmp_path / "out"), str(tmp_path / "ck"))
    with pytest.raises(Exception, match="must not be null"):
        query.awaitTermination()


def plain_spells(rows, quiet):
    out = []
    for job in {r[0] for r in rows}:
        times = sorted(r[2] for r in rows if r[0] == job)
        spell = [times[0], times[0], 0]
        for t in times:
            if t - spell[1] > quiet:
                out.append((job, *spell))
                spell = [t, t, 0]
            spell = [spell[0], t, spell[2] + 1]
        out.append((job, *spell))
    return sorted(out)


@pytest.mark.parametrize("shuffle", [None, 1])
def test_stalls_are_reported_once(spark, own, tmp_path, shuffle):
    rng = random.Random(8)
    rows, t = [], {1: 0, 2: 5000, 3: 90_000}  # job 3 is far ahead of the others
    for seq in range(60):
        job = rng.choice([1, 2, 3])
        t[job] += rng.choice([1, 60, 120, 121, 500])
        rows.append((job, seq, t[job]))
    df = spark.createDataFrame(rows, "job_id long, seq long, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    clock = S.beat(spark, str(tmp_path / "clock"), "1970-01-01")
    stream = S.stream_stalls(arriving(own, df, str(tmp_path / "in"), 4, shuffle), clock, lateness_seconds=120 if shuffle is None else 100_000)
    got = drained(spark, stream, tmp_path, clock)
    found = got.select("job_id", F.unix_seconds("active_from"), F.unix_seconds("last_line_at"), "n_lines", "late").collect()
    assert not any(r.late for r in found)
    assert sorted(tuple(r)[:4] for r in found) == plain_spells(rows, 120)


def test_a_fast_job_closes_no_slow_one(spark, own, tmp_path):
    rows = [(1, i, 100_000 + i) for i in range(3)] + [(2, 3, 10), (2, 4, 20)] + [(2, 5, 90), (2, 6, 10)]
    df = spark.createDataFrame(rows, "job_id long, seq long, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    clock = S.beat(spark, str(tmp_path / "clock"), "1970-01-01")
    got = drained(spark, S.stream_stalls(arriving(own, df, str(tmp_path / "in"), 7), clock), tmp_path, clock)
    assert sorted(tuple(r) for r in got.select("job_id", F.unix_seconds("last_line_at"), "n_lines").collect()) == [(1, 100_002, 3), (2, 90, 4)]


def test_watch_hands_over_batches_and_a_replay_changes_nothing(spark, own, tmp_path):
    df = spark.createDataFrame([(1, 0, "loss 1.0", 0), (1, 1, "loss 2.0", 5)], "job_id long, seq long, line string, t long").withColumn("ts", F.timestamp_seconds("t"))
    kept, batches = str(tmp_path / "kept"), []

    def keep(batch, i):
        batches.append((i, batch.collect()))
        S.upsert(kept)(batch, i)

    clock = S.beat(spark, str(tmp_path / "clock"), "1970-01-01")
    stream = S.stream_loss_series(arriving(own, df, str(tmp_path / "in"), 1), "1 second", clock)
    S.beat(spark, clock, "2030-01-01")
    query = S.watch(stream, keep, str(tmp_path / "ck"), "0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    newest = S.refreshed(spark, kept, stream.schema, ["job_id"], ["seq"])
    want = [(1, 1, 2, 2.0)]
    assert [(r.job_id, r.seq, r.step, r.loss) for r in newest.collect()] == want
    for i, rows in batches:  # Spark sends a batch again after a failure
        S.upsert(kept)(spark.createDataFrame(rows, stream.schema), i)
    assert [(r.job_id, r.seq, r.step, r.loss) for r in newest.collect()] == want
    assert spark.read.parquet(kept).count() == 2


def test_jobs_share_groups_of_state(spark, own, tmp_path, monkeypatch):
    """One call serves many jobs: there are as many groups as buckets, and jobs of a bucket do not mix."""
    monkeypatch.setattr(ordered.in_order, "__defaults__", (2,))
    rows = [(j, s, f"step {9 * j}: loss {j}.5" if s == 2 else f"loss {j}.{s}", 1000 + s) for j in range(300) for s in range(5)]
    df = spark.createDataFrame(rows, "job_id long, seq long, line string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    clock = S.beat(spark, str(tmp_path / "clock"), "1970-01-01")
    stream = S.stream_loss_series(arriving(own, df, str(tmp_path / "in"), 2, 3), "2 hours", clock)
    query = S.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    held = [p.stateOperators[0].customMetrics for p in query.recentProgress if p.stateOperators]
    assert max(int(m["numRegisteredTimers"]) for m in held if "numRegisteredTimers" in m) <= 3
    S.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "ck"), clock)
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert got.where("late").count() == 0
    want = sorted(tuple(r) for r in L.loss_series(df).select("job_id", "seq", "step", "loss").collect())
    assert sorted(tuple(r) for r in got.select("job_id", "seq", "step", "loss").collect()) == want
