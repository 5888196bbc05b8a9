"""Log operators against plain Python loops, with tiny blocks so that every scan crosses many."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tunedata.operators import blocks
from tunedata.operators import logs as L
from tunedata.operators.blocks import running_total

LOSS, STEP = re.compile(L.LOSS.replace("(?i)", ""), re.I), re.compile(L.STEP.replace("(?i)", ""), re.I)

LINES = [
    "step 10: loss 1.2345", "{'loss': 1.23, 'step': 10}", "10/100 | loss: 1.23", "loss=-1.0", "loss nan",
    "Iter 20: Val loss 4.570", "loss: 2e-3", "loss .5", "step 99: no number", "", "LOSS = 3 it/7", 'loss": 0.25e-1 "step": 3',
]


def python_series(lines):
    step, out = 0, []
    for seq, line in lines:
        loss = LOSS.search(line)
        if loss:
            explicit = STEP.search(line)
            step = int(explicit.group(1)) if explicit else step + 1
            out.append((seq, step, float(loss.group(1))))
    return out


def random_lines(seed, jobs=5, n=400):
    """One job holds most of the lines; sequence numbers are shared and have gaps."""
    rng = random.Random(seed)
    rows, seq = [], 0
    for _ in range(n):
        seq += rng.choice([1, 1, 2, 9])
        job = 0 if rng.random() < 0.6 else rng.randrange(1, jobs)
        rows.append((job, seq, rng.choice(LINES)))
    return rows


def by_job(rows):
    jobs = {}
    for job, *rest in rows:
        jobs.setdefault(job, []).append(tuple(rest))
    return jobs


def lines_df(spark, rows):
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    return spark.createDataFrame(shuffled, "job_id long, seq long, line string")


@pytest.mark.parametrize("seed,span", [(1, 7), (2, 1), (3, 1 << 16)])
def test_loss_series_equals_the_loop(spark, seed, span):
    rows = random_lines(seed)
    got = {}
    for r in L.loss_series(lines_df(spark, rows), span=span).orderBy("job_id", "seq").collect():
        got.setdefault(r.job_id, []).append((r.seq, r.step, r.loss))
    want = {j: s for j, ls in by_job(rows).items() if (s := python_series(ls))}
    assert got == want


def test_loss_series_scans_once_and_reuses_its_shuffle(spark, tmp_path):
    path = str(tmp_path / "l")
    lines_df(spark, random_lines(1)).write.parquet(path)
    df = L.loss_series(spark.read.parquet(path))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") >= 1 and plan.count("FileScan") == 1


def test_first_points_of_the_fake_trainer(spark):
    rows = [(1, i, f"step {i + 1}: loss {1.0 - i / 10:.4f}") for i in range(3)]
    series = L.loss_series(lines_df(spark, rows))
    r = L.first_and_last(series).first()
    assert (r.first_step, r.first_loss, r.last_step) == (1, 1.0, 3)
    assert L.points_per_job(series).first().n_points == 3


def test_running_total(spark):
    df = spark.createDataFrame([("b", 1, 5), ("b", 9, 6), ("a", 2, 7)], "k string, seq long, v long")
    got = running_total(df, ["k"], ["seq"], F.col("v"), "t", span=2, exclusive=True, total_name="all").orderBy("seq").collect()
    assert [(r.t, r["all"]) for r in got] == [(0, 11), (0, 7), (5, 11)]
    with pytest.raises(Exception, match="k must not be null"):
        running_total(df.withColumn("k", F.nullif("k", F.lit("b"))), ["k"], ["seq"], F.col("v"), "t").collect()


@pytest.mark.parametrize("n", [1, 3, 5000])
def test_ring_and_tail(spark, n):
    rows = random_lines(4)
    df = lines_df(spark, rows)
    want = {j: ls[-min(n, L.RING_LINES):] for j, ls in by_job(rows).items()}
    tails = {r.job_id: r.tail for r in L.log_tail(df, n).collect()}
    assert tails == {j: "\n".join(t for _, t in ls) for j, ls in want.items()}
    kept = {}
    for r in L.ring(df, n).orderBy("seq").collect():
        kept.setdefault(r.job_id, []).append((r.seq, r.line))
    assert kept == {j: ls[-n:] for j, ls in by_job(rows).items()}


def test_trajectory_takes_every_fourth_point(spark):
    rows = random_lines(5)
    points = L.loss_points(lines_df(spark, rows))
    pieces = {}
    for r in L.loss_trajectory(points, per_piece=3, span=5).orderBy("piece").collect():
        pieces.setdefault(r.job_id, []).append(r.trajectory)
    want = {}
    for job, ls in by_job(rows).items():
        # Spark rounds the printed value half up; Python rounds the binary one
        shown = [str(Decimal(repr(loss)).quantize(Decimal("0.001"), ROUND_HALF_UP)) for *_, loss in python_series(ls)[::4]]
        if shown:
            want[job] = " → ".join(shown)
    assert {j: " → ".join(p) for j, p in pieces.items()} == want


def python_relines(chunks):
    buffer, out, n = "", [], 0
    for chunk in chunks:
        *done, buffer = re.split(r"[\n\r]", buffer + chunk)
        out += [(n + i, line) for i, line in enumerate(done) if line.strip()]
        n += len(done)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_relines_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    parts = ["a", "bc", "\n", "\r", "\r\n", " ", "loss 1.5\n", "x\ny\nz", "", "\n\n", "\xa0\n", "é "]
    rows = []
    for seq in range(300):
        chunk = "".join(rng.choice(parts) for _ in range(rng.randrange(4)))
        rows.append((0 if rng.random() < 0.6 else 1, rng.choice(["out", "err"]), seq, chunk))
    df = spark.createDataFrame(rows, "job_id long, channel string, seq long, chunk string")
    got = {}
    for r in L.relines(df.repartition(3), span=11).orderBy("line_no").collect():
        got.setdefault((r.job_id, r.channel), []).append((r.line_no, r.line))
    grouped = {}
    for job, channel, _, chunk in rows:
        grouped.setdefault((job, channel), []).append(chunk)
    assert got == {k: python_relines(c) for k, c in grouped.items()}


def events(spark, rows):
    return spark.createDataFrame(rows, "job_id long, ts string, kind string, error string").withColumn("ts", F.to_timestamp("ts"))


STATUS_ROWS = [
    (1, "2024-01-01 00:00:00", "submitted", None),
    (2, "2024-01-01 00:00:00", "started", None),
    (3, "2024-01-01 00:00:00", "started", None),
    (3, "2024-01-01 00:00:07.5", "returned", None),
    (4, "2024-01-01 00:00:00", "started", None),
    (4, "2024-01-01 00:00:01", "stop_requested", None),
    (4, "2024-01-01 00:00:02", "returned", None),
    (5, "2024-01-01 00:00:00", "started", None),
    (5, "2024-01-01 00:00:01", "stop_requested", None),
    (5, "2024-01-01 00:00:03", "failed", "Traceback\nZeroDivisionError: loss 9.0"),
    (6, "2024-01-01 00:00:00", "started", None),
    (6, "2024-01-01 00:00:02", "returned", None),
    (6, "2024-01-01 00:00:09", "stop_requested", None),
]


def test_job_status(spark):
    as_of = F.lit("2024-01-01 00:01:00").cast("timestamp")
    got = {r.job_id: (r.status, r.elapsed) for r in L.job_status(events(spark, STATUS_ROWS), as_of).collect()}
    assert got == {
        1: ("pending", 0.0), 2: ("running", 60.0), 3: ("finished", 7.5), 4: ("stopped", 2.0), 5: ("failed", 3.0),
        6: ("finished", 2.0),  # stopped after it had returned
    }


def test_snapshots_carry_the_error_as_one_line(spark):
    as_of = F.lit("2024-01-01 00:01:00").cast("timestamp")
    jobs = spark.createDataFrame([(i, f"job{i}") for i in range(1, 8)], "job_id long, name string")
    lines = spark.createDataFrame([(5, 0, "step 1: loss 2.0"), (5, 1, "oops"), (3, 0, "x")], "job_id long, seq long, line string")
    lines = lines.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    ev = events(spark, STATUS_ROWS)
    got = {r.job_id: r for r in L.job_snapshots(jobs, lines, ev, as_of, tail=2).collect()}
    assert len(got) == 7 and got[7].status == "pending" and got[7].tail == "" and got[7].n_points == 0
    assert (got[5].status, got[5].n_points, got[5].tail) == ("failed", 2, f"{L.STOP_LINE}\nTraceback\nZeroDivisionError: loss 9.0")
    assert [r.job_id for r in L.job_snapshots(jobs, lines, ev, as_of, newest=True).collect()] == [7]
    assert [r.tail for r in L.job_snapshots(jobs, lines, ev, as_of, job_id=3).collect()] == ["x"]
    assert got[4].tail == L.STOP_LINE  # stopped without a line of its own
    series = L.job_series(jobs, lines, ev, job_id=5)
    assert [(r.step, r.loss) for r in series.orderBy("at", "seq").collect()] == [(1, 2.0), (2, 9.0)]
    listing = L.job_listing(jobs.join(L.job_status(ev, as_of), "job_id")).collect()
    assert listing[0].entry == "#6 ✅ job6" and [r.job_id for r in listing] == [6, 5, 4, 3, 2, 1]


TRAINER_LOG = [
    "Iter 1: Val loss 4.570, Val took 3s", "Iter 100: Train loss 3.1, Learning Rate 1e-4, Tokens/sec 812.5, Peak mem 9.5 GB",
    "Iter 100: Val loss 2.90", "Iter 100: Saved adapter weights to a.", "Iter 200: Train loss 2.7, Tokens/sec 1001.5, Peak mem 10.25 GB",
    "Iter 200: Saved adapter weights to b.", "Iter 200: Saved adapter weights to b.", "Iter 100: Val loss 2.80", "val loss 1.0",
]


def test_headlines_and_checkpoints(spark):
    rows = [(1, i, line) for i, line in enumerate(TRAINER_LOG)] + [(2, 0, "nothing")]
    df = lines_df(spark, rows)
    got = {r.job_id: tuple(r)[1:] for r in L.log_headlines(df).collect()}
    assert got == {1: ("4.570", "2.80", "1002", "10.25"), 2: ("—", "—", "—", "—")}
    table = [tuple(r) for r in L.checkpoint_losses(df).orderBy("iter").collect()]
    assert table == [
        (1, 100, "0000100_adapters.safetensors", "2.80", "3.1"),
        (1, 200, "0000200_adapters.safetensors", "—", "2.7"),
        (1, 200, "0000200_adapters.safetensors", "—", "2.7"),
    ]
    assert [r.times_saved for r in L.checkpoint_losses(df, once=True).orderBy("iter").collect()] == [1, 2]
    evals = [(r.kind, r.step, r.loss) for r in L.eval_losses(df).orderBy("seq").collect()]
    assert evals == [("val", 1, 4.57), ("train", 100, 3.1), ("val", 100, 2.9), ("train", 200, 2.7), ("val", 100, 2.8)]


def test_rounding_is_half_even(spark):
    rows = [(1, 0, "Tokens/sec 2.5"), (2, 0, "Tokens/sec 3.5")]
    got = {r.job_id: r.tps for r in L.log_headlines(lines_df(spark, rows)).collect()}
    assert got == {1: "2", 2: "4"}


def test_stalls_equal_the_loop(spark):
    rng = random.Random(6)
    rows, t = [], -500.0  # some lines lie before 1970
    for _ in range(300):
        t += rng.choice([0.0, 1.0, 50.0, 119.999, 120.0, 120.001, 300.0])
        rows.append((rng.randrange(2), t))
    df = spark.createDataFrame(rows, "job_id long, t double").withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))
    got = sorted((r.job_id, round(r.quiet, 3)) for r in L.stalls(df).collect())
    want = []
    for job in (0, 1):
        times = [x for j, x in rows if j == job]
        want += [(job, round(b - a, 3)) for a, b in zip(times, times[1:], strict=False) if b - a > 120.0000001]
    assert got == sorted(want)
    open_ended = L.stalls(df, as_of=F.timestamp_micros(F.lit(int((t + 500) * 1e6)))).where("next_line_at IS NULL")
    assert open_ended.count() == 2


@pytest.mark.parametrize("n", [1, 7, 40, 10_000])
def test_long_tails_rank_only_the_last_blocks(spark, tmp_path, monkeypatch, n):
    rows = random_lines(5, jobs=4, n=300) + [(None, 1, "x"), (None, 70, "y")]
    spark.createDataFrame(rows, "job_id long, seq long, line string").repartition(6).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    kept = blocks.in_last_blocks(df, ["job_id"], ["seq"], n, span=16)
    want = {(job, *r) for job, lines in by_job(rows).items() for r in sorted(lines)[-n:]}
    got = {tuple(r) for r in kept.collect()}
    assert want <= got and len(got) <= len(want) + 5 * 16
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # the semi-join comes before any shuffle


def test_the_whole_ring_needs_no_session_setting(spark):
    n = 2100
    lines = spark.range(n).selectExpr("id % 2 AS job_id", "id * 40 AS seq", "concat('l', id) AS line").union(spark.sql("SELECT 7L, 1L, 'only'"))
    lines = lines.union(spark.range(5000).selectExpr("9L", "id", "concat('m', id)"))
    got = L.ring(lines).groupBy("job_id").agg(F.count("*"), F.min("seq")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1050, 0), (1, 1050, 40), (7, 1, 1), (9, 2000, 3000)]


def test_checkpoints_come_in_order(spark):
    rows = [(j, s, f"Iter {i}: Saved adapter weights to x") for s, (j, i) in enumerate([(2, 300), (1, 200), (1, 100), (2, 100), (1, 100)])]
    df = spark.createDataFrame(rows, "job_id long, seq long, line string").repartition(3)
    assert [(r.job_id, r.iter) for r in L.checkpoint_losses(df).collect()] == [(1, 100), (1, 100), (1, 200), (2, 100), (2, 300)]
    assert [(r.job_id, r.iter, r.times_saved) for r in L.checkpoint_losses(df, once=True).collect()] == [(1, 100, 2), (1, 200, 1), (2, 100, 1), (2, 300, 1)]


def test_a_stop_request_is_a_line_of_the_log(spark):
    """It stands after the output of its time and before what the job still prints."""
    lines = spark.createDataFrame([(1, 0, "a", 10), (1, 1, "b", 20), (1, 2, "c", 20), (1, 3, "d", 30)], "job_id long, seq long, line string, t long")
    ev = spark.createDataFrame([(1, 20, "stop_requested", None), (1, 99, "failed", "boom"), (1, 31, "stop_requested", None)], "job_id long, t long, kind string, error string")
    lines, ev = (d.withColumn("ts", F.timestamp_seconds("t")) for d in (lines, ev))
    log = L.job_log(lines, ev).orderBy("at", "seq").collect()
    assert [r.line for r in log] == ["a", "b", "c", L.STOP_LINE, "d", L.STOP_LINE, "boom"]


def test_a_long_ring_ranks_only_the_block_it_cuts(spark, tmp_path):
    """Keys of up to n rows and later blocks stay where they are; numbers and keys may be null."""
    n, span = 1200, 500
    rows = [(1, i) for i in range(5000)] + [(2, 3 * i) for i in range(n)] + [(3, i) for i in range(n + 1)] + [(4, 7), (4, None)]
    rows += [(None, i) for i in range(2 * n)] + [(5, i) for i in range(1000)] + [(5, None)] * 300
    df = spark.createDataFrame([(j, s, f"line {s}") for j, s in rows], "job_id long, seq long, line string")
    want = []
    for job in {j for j, _ in rows}:
        own = sorted((s for j, s in rows if j == job), key=lambda s: (s is None, -(s or 0)))
        want += [(job, s, f"line {s}" if s is not None else "line None") for s in own[:n]]
    got = blocks.newest_rows(df, ["job_id"], ["seq"], n, span)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, L.ring(df, n).collect()), key=repr) == sorted(want, key=repr)
    ranked = blocks.last_rows(df, ["job_id"], ["seq"], n).where("job_id = 1").collect()
    assert sorted(r._from_end for r in ranked) == list(range(1, n + 1)) and all(r.seq == 5000 - r._from_end for r in ranked)
    df.where("job_id = 2 or job_id = 4").write.parquet(str(tmp_path / "short"))
    whole = L.ring(spark.read.parquet(str(tmp_path / "short")), n)
    whole.collect()
    final = whole._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert whole.count() == n + 2 and "Window" not in final and "Sort" not in final
