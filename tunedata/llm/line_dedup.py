"""Line dedup: a suffix array over line ids by distributed prefix doubling finds repeated runs of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunedata.llm import bytes_ as B
from tunedata.llm.tables import dropped, fresh, maybe_in, saved, table, text_of

# a repeated run counts from so many words on
LEAST_WORDS = 50
NEWLINE = B.class_table(b"\n")
LINES = "uid long, pos int, line int, h1 long, h2 long, ahead int, back int"


def _lines(uids: np.ndarray, rows: list[bytes], least: int) -> pa.RecordBatch:
    """Every line with a word: its place among such lines, its number, two hashes, and how many such
    lines from it on (ahead) or up to it (back) hold `least` words; 0 if its text has too few."""
    owners, numbers, h1s, h2s, sizes = [], [], [], [], []
    seen = np.zeros(len(rows), np.int64)
    for rows_of, pieces in B.slices(rows, cutter=B.line_cut):
        words = B.Words(pieces)
        if not len(words):
            for r, p in zip(rows_of, pieces, strict=True):
                seen[r] += p.count(b"\n")
            continue
        breaks = np.flatnonzero(words.blob == 10)
        start = np.concatenate([[0], breaks[:-1] + 1])
        line_of = np.searchsorted(breaks, words.start)
        size = np.bincount(line_of, minlength=breaks.size)
        full = np.flatnonzero(size)
        ends = np.cumsum([len(p) + 1 for p in pieces])
        piece = np.searchsorted(ends - 1, breaks)
        first = np.searchsorted(piece, np.arange(len(pieces)))
        owner = np.array(rows_of, np.int64)[piece]
        # lines before this piece in the same text
        before = np.empty(len(pieces), np.int64)
        for k, (r, p) in enumerate(zip(rows_of, pieces, strict=True)):
            before[k] = seen[r]
            seen[r] += p.count(b"\n")
        number = np.arange(breaks.size) - first[piece] + before[piece]
        place = np.arange(len(words)) - np.searchsorted(line_of, line_of)
        mixed = B.mix(words.hashes() + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
        upto = np.cumsum(size)
        h2 = sums[upto] - sums[upto - size]
        owners.append(owner[full])
        numbers.append(number[full])
        h1s.append(words.hashes_of(start[full], breaks[full]).view(np.int64))
        h2s.append(h2[full].view(np.int64))
        sizes.append(size[full])
    if not owners:
        owners = numbers = h1s = h2s = sizes = [np.zeros(0, np.int64)]
    owner, size = np.concatenate(owners), np.concatenate(sizes)
    upto = np.cumsum(size)
    first = np.searchsorted(owner, np.arange(len(rows)))
    last = np.searchsorted(owner, np.arange(len(rows)), "right") - 1
    at = np.arange(owner.size)
    end = np.searchsorted(upto, upto - size + least)
    ahead = np.where(end <= last[owner], end - at + 1, 0)
    begin = np.searchsorted(upto, upto - least, "right")  # first line that is needed to reach `least` at `at`
    back = np.where((upto >= least) & (begin >= first[owner]), at - begin + 1, 0)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(uids[owner]),
            pa.array((at - first[owner]).astype(np.int32)),
            pa.array(np.concatenate(numbers).astype(np.int32)),
            pa.array(np.concatenate(h1s)),
            pa.array(np.concatenate(h2s)),
            pa.array(ahead.astype(np.int32)),
            pa.array(back.astype(np.int32)),
        ],
        ["uid", "pos", "line", "h1", "h2", "ahead", "back"],
    )


def lines_of(rows: DataFrame, least: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.batches_in_parts(batches, "text"):
            yield _lines(batch.column(0).to_numpy(), B.texts(batch.column(1)), least)

    return rows.select("uid", text_of(rows).alias("text")).mapInArrow(B.freed(read), LINES)


def _ranks(values: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct repeated keys with `rank`, a number that grows with their order over all partitions."""
    ordered = values.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return saved(ordered.withColumn("rank", F.monotonically_increasing_id()), name)


def suffix_ranks(lines: DataFrame, longest: int) -> list[DataFrame]:
    """Tables (uid, pos, rank) for runs of 1, 2, 4, ... lines, up to `longest`.

    Rank k orders all suffixes of the line sequences by their first 2**k lines; two suffixes share it
    exactly if those lines are equal. Each round pairs a rank with the rank 2**k lines on in the same
    text and sorts the distinct pairs over the cluster. Suffixes whose run occurs once leave: their
    place is settled, and no repeated run begins there.
    """
    repeated = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    ids = _ranks(repeated, ["h1", "h2"], "line-ids")
    level = saved(lines.join(ids, ["h1", "h2"]).select("uid", "pos", "rank"), "line-ranks")
    levels, span = [level], 1
    dropped(ids)
    while span * 2 <= longest:
        following = Window.partitionBy("uid").orderBy("pos").rangeBetween(span, span)
        pairs = level.withColumn("next", F.first("rank").over(following)).where("next is not null")
        pairs = saved(pairs, "line-pairs")
        repeated = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        names = repeated.select(F.col("rank").alias("a"), F.col("next").alias("b"))
        ids = _ranks(names, ["a", "b"], "line-ids")
        found = pairs.withColumnsRenamed({"rank": "a", "next": "b"}).join(ids, ["a", "b"])
        level = saved(found.select("uid", "pos", "rank"), "line-ranks")
        dropped(pairs, ids)
        levels.append(level)
        span *= 2
        if not level.limit(1).count():
            break
    return levels


def _order(start: str) -> Column:
    """Reading order: by document id (null last), then row, then place."""
    return F.struct(F.col("doc_id").isNull(), "doc_id", "uid", F.col(start))


def repeated_runs(rows: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(uid, lines): numbers of the lines in later copies of repeated runs of `least` words or more.

    A line belongs to such a run exactly if a shortest run around it does: one that begins at some
    line, or ends at this one, and reaches `least` words just there. The run of m lines at a place is
    the interval of suffixes that share m lines, named by the ranks of its first and last 2**k lines,
    2**k <= m. The first member of the interval in reading order stays, all others go.
    """
    lines = saved(lines_of(rows, least), "lines")
    levels = suffix_ranks(lines, least)
    ranks = levels[0].withColumn("k", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        ranks = ranks.unionByName(level.withColumn("k", F.lit(k)))
    runs = (
        lines.where("ahead > 0")
        .select("uid", F.col("pos").alias("start"), F.col("ahead").alias("m"))
        .union(lines.where("back > 0").select("uid", F.expr("pos - back + 1"), "back"))
        .join(levels[0].select("uid", F.col("pos").alias("start")), ["uid", "start"], "left_semi")
        .distinct()
        .withColumn("k", F.floor(F.log2("m") + 1e-9).cast("int"))
    )
    head = ranks.select("k", "uid", F.col("pos").alias("start"), F.col("rank").alias("a"))
    tail = ranks.select("k", "uid", F.col("pos").alias("_tail"), F.col("rank").alias("b"))
    runs = (
        runs.join(head, ["k", "uid", "start"])
        .withColumn("_tail", (F.col("start") + F.col("m") - F.pow(F.lit(2), "k")).cast("int"))
        .join(tail, ["k", "uid", "_tail"])
        .join(rows.select("uid", "doc_id"), "uid")
        .select("uid", "doc_id", "start", "m", "a", "b")
    )
    runs = saved(runs, "line-runs")
    firsts = runs.groupBy("m", "a", "b").agg(F.min(_order("start")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    later = runs.join(firsts.where("_n > 1"), ["m", "a", "b"]).where(_order("start") > F.col("_first"))
    gone = later.select("uid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1)).alias("pos")).distinct()
    numbers = lines.join(gone, ["uid", "pos"]).groupBy("uid").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    numbers = saved(numbers, "line-cuts")
    dropped(lines, runs, *levels)
    return numbers


def without_lines(text: pa.Array, lines: pa.Array) -> pa.Array:
    """Texts less the lines of the given numbers."""
    out = []
    for t, gone in zip(B.texts(text), lines.to_pylist(), strict=True):
        gone = set(gone)
        out.append(b"\n".join([x for i, x in enumerate(t.split(b"\n")) if i not in gone]).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """`docs` with later copies of repeated line runs cut from `text`, and `removed_lines`, their numbers.

    Lines are split at \\n and compared byte by byte; lines without a word neither count nor break a
    run, and stay. The first copy in order of doc_id (null last; repeated rows in table order) stays
    whole, also against copies in the same text. Every row stays, with empty text if all its lines
    go; null texts and texts of fewer than `least` words are as before. A column `removed_lines` is
    replaced, all others pass unchanged, whatever their names. An empty table gives an empty table.
    Texts stay where they are read: only those that may lose lines are joined with their cuts.
    """
    names = [c for c in docs.columns if c != "removed_lines"]
    uid, found = fresh(docs, "uid", "lines")
    rows = saved(docs.withColumn(uid, F.monotonically_increasing_id()), "line-docs")
    cuts = repeated_runs(rows.select(F.col(uid).alias("uid"), "doc_id", "text"), least)
    maybe = maybe_in(F.col(uid), cuts.select(F.col("uid").alias("id")))
    joined = rows.where(maybe).join(cuts.select(F.col("uid").alias(uid), F.col("lines").alias(found)), uid, "left")
    none = F.array().cast("array<int>")
    lines = F.coalesce(found, none)
    cut = F.when(F.size(lines) > 0, F.arrow_udf(B.in_parts(without_lines), "string")(text_of(joined), lines)).otherwise(F.col("text"))
    joined = joined.withColumn("text", cut).withColumn("removed_lines", lines).select(*names, "removed_lines")
    whole = rows.where(~maybe).withColumn("text", F.col("text").cast("string")).withColumn("removed_lines", none)
    return whole.select(*names, "removed_lines").union(joined)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", "text")
