"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunedata.llm import bytes_ as B
from tunedata.llm.tables import dropped, fresh, maybe_in, saved, table, text_of

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 3
IDF_BUCKETS = 1 << 16
# how far frequency can lower a shingle's weight: a shingle in every text weighs 1 less this
IDF_RANGE = 0.1
# a bucket's members are compared with so many of its members in turn, each of another class
STARS = 3
# texts with a common rare shingle are compared in blocks of so many on either side
BLOCK = 4096
CHUNK = 1 << 16
SHINGLED = "uid long, doc_id long, n int, h1 long, h2 long, shingles binary"


def _shingles(words: B.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, hash) of every run of `SHINGLE` words, or of all words of a shorter piece."""
    factor = np.uint64(0x9E3779B97F4A7C15)
    owner, at = words.owner(), np.arange(len(words))
    left = words.first[owner + 1] - at
    size = np.minimum(SHINGLE, words.count)[owner]
    begins = np.flatnonzero(left >= size)
    code = np.zeros(begins.size, np.uint64)
    for k in range(SHINGLE):
        there = size[begins] > k
        step = hashes[np.minimum(begins + k, hashes.size - 1)]
        code = np.where(there, code * factor + step, code)
    return owner[begins], B.mix(code)


def _overlapping(rows: list[bytes]) -> Iterator[tuple[int, bytes, bool]]:
    """(row, piece, whether more follows): pieces of a long text repeat the last words of the one before."""
    for i, text in enumerate(rows):
        if len(text) <= B.SLICE_BYTES:
            yield i, text, False
            continue
        tail, at = b"", 0
        for piece in B.cut(text, B.SLICE_BYTES):
            at += len(piece)
            whole = tail + piece
            yield i, whole, at < len(text)
            tail = b" ".join(whole.split()[1 - SHINGLE :]) + b" "


def _signed(uids: np.ndarray, ids: pa.Array, rows: list[bytes]) -> pa.RecordBatch:
    """Per text: number of words, two hashes of its word sequence, and its shingles as sorted 32-bit numbers."""
    found: list[list[np.ndarray]] = [[] for _ in rows]
    n, h1, h2 = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)

    def take(owners: list[int], pieces: list[bytes]) -> None:
        words = B.Words(pieces, lower=True)
        if not len(words):
            return
        hashes = words.hashes()
        piece, code = _shingles(words, hashes)
        short = (code >> np.uint64(32)).astype(np.uint32)
        order = np.argsort((piece.astype(np.uint64) << np.uint64(32)) | short)
        short, edges = short[order], np.searchsorted(piece, np.arange(len(pieces) + 1))
        place = np.arange(len(words)) - words.first[words.owner()] + n[owners][words.owner()]
        for into, salt in ((h1, 0x9E3779B97F4A7C15), (h2, 0xD1342543DE82EF95)):
            each = B.mix(hashes + place.astype(np.uint64) * np.uint64(salt))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
            np.add.at(into, owners, sums[words.first[1:]] - sums[words.first[:-1]])
        np.add.at(n, owners, words.count)
        for k, row in enumerate(owners):
            found[row].append(short[edges[k] : edges[k + 1]])

    owners, pieces, size = [], [], 0
    for row, piece, more in _overlapping(rows):
        if pieces and (size + len(piece) > B.SLICE_BYTES or owners[-1] == row):
            take(owners, pieces)
            owners, pieces, size = [], [], 0
        owners.append(row)
        pieces.append(piece)
        size += len(piece) + 1
        if more:
            take(owners, pieces)
            owners, pieces, size = [], [], 0
    if pieces:
        take(owners, pieces)
    packed = [np.sort(np.concatenate(x)).tobytes() if len(x) > 1 else (x[0].tobytes() if x else b"") for x in found]
    return pa.RecordBatch.from_arrays(
        [pa.array(uids), ids, pa.array(n.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(packed)],
        ["uid", "doc_id", "n", "h1", "h2", "shingles"],
    )


def shingled(rows: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.batches_in_parts(batches, "text"):
            yield _signed(batch.column(0).to_numpy(), batch.column(1), B.texts(batch.column(2)))

    return rows.select("uid", F.col("doc_id").cast("long"), text_of(rows).alias("text")).mapInArrow(B.freed(read), SHINGLED)


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all rows, and where each row's begin (one more at the end)."""
    raw = column.cast(pa.large_binary()).to_pylist()
    edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])])
    return np.frombuffer(b"".join(raw), np.uint32), edges


def _runs(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of every run of equal (owner, value)."""
    new = np.ones(values.size, bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, values.size))


def shingle_weights(signed: DataFrame) -> np.ndarray:
    """Weight of a single shingle by the bucket its hash falls in: 1, less up to `IDF_RANGE` for frequent ones.

    Buckets count texts per distinct shingle over the whole corpus. A shingle of frequency share s
    weighs by log(1/s) against log of the number of buckets, which is what a rare one gets at any
    size of corpus: the share of a bucket does not grow with the input. The table has exactly
    `IDF_BUCKETS` numbers; every task counts its part and sends no more than that.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDF_BUCKETS, np.int64)
        for batch in B.batches_in_parts(batches, "shingles"):
            values, edges = _unpacked(batch.column(0))
            owner = np.repeat(np.arange(edges.size - 1), np.diff(edges))
            first, _ = _runs(values, owner)
            total += np.bincount(values[first] % IDF_BUCKETS, minlength=IDF_BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counted = signed.select("shingles").mapInArrow(B.freed(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    share = np.zeros(IDF_BUCKETS)
    for row in counted.collect():
        share[row.bucket] = row.n
    share /= max(1.0, share.sum())
    idf = -np.log(np.maximum(share, 1 / IDF_BUCKETS)) / np.log(IDF_BUCKETS)
    return (1 - IDF_RANGE + IDF_RANGE * idf).astype(np.float32)


def _uniforms(values: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Five numbers in (0, 1) for every shingle, from the k-th hash."""
    one = B.mix(values + np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64)))
    two = one * np.uint64(0xD6E8FEB86659FD93)
    two ^= two >> np.uint64(29)
    low = np.uint64((1 << 21) - 1)
    cut = lambda x, s: ((x >> np.uint64(s)) & low).astype(np.float32) * np.float32(2.0**-21) + np.float32(2.0**-22)
    return cut(one, 0), cut(one, 21), cut(one, 42), cut(two, 42), cut(two, 21)


def samples(values: np.ndarray, weights: np.ndarray, edges: np.ndarray, k: int) -> np.ndarray:
    """The k-th consistent sample of every row: a hash of the chosen shingle and its quantised weight.

    Two rows agree with probability equal to their weighted Jaccard similarity. With r and c drawn
    from Gamma(2, 1) and beta uniform per shingle: t = floor(log w / r + beta), and the shingle of least
    log c - r (t - beta) - r is chosen. Every row must have a shingle.
    """
    u1, u2, u3, u4, beta = _uniforms(values.astype(np.uint64), k)
    r = -np.log(u1 * u2)
    t = np.floor(np.log(weights) / r + beta)
    score = np.log(-np.log(u3 * u4)) - r * (t - beta) - r
    bits = score.view(np.int32)
    bits = np.where(bits < 0, ~bits, bits | np.int32(-(1 << 31))).view(np.uint32)
    key = (bits.astype(np.uint64) << np.uint64(32)) | values
    least = np.minimum.reduceat(key, edges[:-1])
    at = np.flatnonzero(key == np.repeat(least, np.diff(edges)))
    return B.mix((values[at].astype(np.uint64) << np.uint64(16)) ^ t[at].astype(np.int64).view(np.uint64) ^ np.uint64(k << 56))


def _weighted(values: np.ndarray, owner: np.ndarray, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per row, their owner, and term frequency times the weight of the shingle."""
    first, times = _runs(values, owner)
    return values[first], owner[first], table_[values[first] % IDF_BUCKETS] * times.astype(np.float32)


def band_keys(signed: DataFrame, weights: np.ndarray, bands: int, rows: int) -> DataFrame:
    """(uid, doc_id, n, h1, h2, bands): one key per band, of `rows` samples each; none without words."""
    shared = signed.sparkSession.sparkContext.broadcast(weights)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.batches_in_parts(batches, "shingles"):
            values, edges = _unpacked(batch.column(5))
            owner = np.repeat(np.arange(edges.size - 1), np.diff(edges))
            values, owner, weight = _weighted(values, owner, shared.value)
            held = np.flatnonzero(np.bincount(owner, minlength=edges.size - 1))
            edges = np.append(np.searchsorted(owner, held), owner.size)
            keys = np.zeros((held.size, bands), np.uint64)
            at = 0
            while at < held.size:  # groups of rows of about `CHUNK` shingles stay in cache
                to = max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK, "right")) - 1)
                to = min(to, held.size)
                part = slice(edges[at], edges[to])
                here = edges[at : to + 1] - edges[at]
                for k in range(bands * rows):
                    band = keys[at:to, k // rows]
                    band[:] = B.mix(band * np.uint64(31) + samples(values[part], weight[part], here, k))
                at = to
            out: list = [[] for _ in range(batch.num_rows)]
            for row, key in zip(held.tolist(), keys.view(np.int64).tolist(), strict=True):
                out[row] = key
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(out, pa.list_(pa.int64()))], ["uid", "doc_id", "n", "h1", "h2", "bands"]
            )

    out = saved(signed.mapInArrow(B.freed(read), "uid long, doc_id long, n int, h1 long, h2 long, bands array<long>"), "dup-bands")
    shared.destroy()
    return out


def weighted_jaccard(a: bytes, b: bytes, table_: np.ndarray) -> float:
    left, right = (np.frombuffer(x, np.uint32) for x in (a, b))
    v, _, w = _weighted(left, np.zeros(left.size, np.int8), table_)
    x, _, y = _weighted(right, np.zeros(right.size, np.int8), table_)
    at = np.minimum(np.searchsorted(x, v), max(0, x.size - 1))
    common = np.minimum(w, y[at])[x[at] == v].sum(dtype=np.float64) if x.size else 0.0
    both = w.sum(dtype=np.float64) + y.sum(dtype=np.float64) - common
    return float(common / both) if both else 0.0


def verified(pairs: DataFrame, signed: DataFrame, weights: np.ndarray, similarity: float) -> DataFrame:
    """The pairs (a, b) of row ids whose weighted Jaccard similarity is at least `similarity`."""
    table_ = signed.sparkSession.sparkContext.broadcast(weights)

    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right = (x.cast(pa.large_binary()).to_pylist() for x in (a, b))
        return pa.array([weighted_jaccard(x, y, table_.value) >= similarity for x, y in zip(left, right, strict=True)])

    near = signed.select("uid", "shingles").where(maybe_in(F.col("uid"), pairs.select(F.explode(F.array("a", "b")).alias("id"))))
    left = near.select(F.col("uid").alias("a"), F.col("shingles").alias("_a"))
    right = near.select(F.col("uid").alias("b"), F.col("shingles").alias("_b"))
    joined = pairs.join(left, "a").join(right, "b")
    out = saved(joined.where(F.arrow_udf(B.in_parts(similar), "boolean")("_a", "_b")).select("a", "b"), "dup-verified")
    table_.destroy()
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, comp): least id reachable over the links, for every id that has one.

    Each round takes the least label among neighbours, then the label of that label, until none changes.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "dup-links")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "dup-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("_near"))
        moved = labels.join(near, "id").select("id", F.col("comp").alias("_was"), F.least("comp", "_near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("_next"))
        moved = moved.join(jump, "comp", "left").select("id", "_was", F.least("comp", F.coalesce("_next", "comp")).alias("comp"))
        moved = saved(moved, "dup-labels")
        dropped(labels)
        labels = moved.select("id", "comp")
        if not moved.where("comp <> _was").limit(1).count():
            dropped(both)
            return labels


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Classes `comps` (id, comp) after more links: only links between different classes count, each pair of classes once."""
    of = lambda end: comps.select(F.col("id").alias(end), F.col("comp").alias(f"_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(*_pair(F.coalesce("_a", "a"), F.coalesce("_b", "b"))).where("a <> b").distinct()
    tops = components(ends)
    moved = comps.join(tops.select(F.col("id").alias("comp"), F.col("comp").alias("_top")), "comp", "left")
    new = tops.join(comps, "id", "left_anti")
    out = saved(moved.select("id", F.coalesce("_top", "comp").alias("comp")).unionByName(new), "dup-labels")
    dropped(tops)
    return out


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _open(members: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their class so far, and the buckets that still hold several."""
    known = members.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    several = known.groupBy("band", "key").agg((F.min("comp") < F.max("comp")).alias("_open")).where("_open")
    return known, several.drop("_open")


def _rare_shingles(texts: DataFrame, weights: np.ndarray, similarity: float) -> DataFrame:
    """(id, comp, shingle, rest, whole): the rarest shingles of every text, as many as decide a link.

    `rest` is the weight of the shingle and of all more frequent ones (ties by hash), `whole` that of the
    text. Two texts share no more than the smaller `rest` of the first shingle they have in common,
    counted from the rarest; a similar pair therefore has one whose `rest` is `similarity` of the
    whole. A shingle of one text only makes no pair.
    """
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.batches_in_parts(batches, "shingles"):
            values, edges = _unpacked(batch.column(2))
            owner = np.repeat(np.arange(edges.size - 1), np.diff(edges))
            values, owner, weight = _weighted(values, owner, shared.value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner)),
                    batch.column(1).take(pa.array(owner)),
                    pa.array(values.astype(np.int64)),
                    pa.array(weight.astype(np.float64)),
                ],
                ["id", "comp", "shingle", "weight"],
            )

    each = texts.select("id", "comp", "shingles").mapInArrow(B.freed(read), "id long, comp long, shingle long, weight double")
    each = saved(each, "dup-rare")
    shared.destroy()
    times = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"))
    text = Window.partitionBy("id")
    rest = F.sum("weight").over(text.orderBy(F.desc("times"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = each.join(times, "shingle").select(
        "id", "comp", "shingle", "times", rest.alias("rest"), F.sum("weight").over(text).alias("whole")
    )
    out = saved(ranked.where((F.col("times") > 1) & (F.col("rest") >= (similarity - 1e-6) * F.col("whole"))).drop("times"), "dup-rare")
    dropped(each)
    return out


def exact_pairs(texts: DataFrame, weights: np.ndarray, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of `texts` (id, comp, shingles) in different classes that may be similar; no
    similar pair is missing.

    Texts meet by their rare shingles. At a shingle, those outside its most frequent class are set
    against all, in blocks of about `BLOCK` on either side, and a pair becomes a row only if both have
    enough weight left from that shingle on.
    """
    rare = _rare_shingles(texts, weights, similarity)
    out = _met_pairs(rare, similarity)
    dropped(rare)
    return out


def _enough(similarity: float) -> Column:
    """Whether a text and another (names with _ before) have enough weight left from a common shingle on."""
    return F.least("rest", "_rest") >= (similarity / (1 + similarity) - 1e-6) * (F.col("whole") + F.col("_whole"))


def _rare_stars(rare: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Distinct pairs of texts that may be similar: at every shingle, all against one text of its most
    frequent class and one of its least frequent class; the turn decides which."""
    head = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("_h"), "id", "comp", "rest", "whole")).alias("_c")
    per_class = rare.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("_n"), head)
    ends = F.struct("_n", F.xxhash64("comp", F.lit(turn)).alias("_h"), "_c")
    centers = per_class.groupBy("shingle").agg(F.count(F.lit(1)).alias("_k"), F.array(F.max(ends)["_c"], F.min(ends)["_c"]).alias("_cs"))
    centers = centers.where("_k > 1").select("shingle", F.explode("_cs").alias("_c"))
    centers = centers.select("shingle", *[F.col(f"_c.{c}").alias(f"_{c}") for c in ("id", "comp", "rest", "whole")])
    met = rare.join(centers, "shingle").where((F.col("comp") != F.col("_comp")) & _enough(similarity))
    return met.select(*_pair(F.col("id"), F.col("_id"))).distinct()


def _met_pairs(rare: DataFrame, similarity: float) -> DataFrame:
    """The pairs of `exact_pairs`, from the rare shingles of the texts."""
    per_class = rare.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("_n"))
    met = per_class.groupBy("shingle").agg(
        F.max(F.struct("_n", "comp"))["comp"].alias("_main"), F.sum("_n").alias("_all"), F.max("_n").alias("_most"), F.count(F.lit(1)).alias("_k")
    )
    met = met.where("_k > 1").select(
        "shingle", "_main", F.ceil(F.col("_all") / BLOCK).alias("_right"), F.ceil((F.col("_all") - F.col("_most")) / BLOCK).alias("_left")
    )
    rows = saved(rare.join(met, "shingle"), "dup-met")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).alias(n[1])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(n[1])
    left = rows.where("comp <> _main").select("shingle", "id", "comp", "rest", "whole", mine("_left"), "_right")
    left = left.select("shingle", "id", "comp", "rest", "whole", "l", every("_right"))
    right = rows.select("shingle", mine("_right"), "_left", *[F.col(c).alias(f"_{c}") for c in ("id", "comp", "rest", "whole")])
    right = right.select("shingle", "r", "_id", "_comp", "_rest", "_whole", every("_left"))
    found = left.join(right, ["shingle", "l", "r"]).where((F.col("comp") != F.col("_comp")) & _enough(similarity))
    out = saved(found.select(*_pair(F.col("id"), F.col("_id"))).distinct(), "dup-pairs")
    dropped(rows)
    return out


def linked_by_rare(texts: DataFrame, comps: DataFrame, signed: DataFrame, weights: np.ndarray, similarity: float) -> DataFrame:
    """Classes `comps` (id, comp) after every link between the `texts` (id, comp, shingles).

    A group of m similar texts has up to m * m links, but m - 1 join it. So all texts of a rare shingle are first
    compared with two of them, in `STARS` turns, each at most two rows per text and shingle; only texts that
    are then still in different classes are set against each other (`exact_pairs`).
    """
    rare = _rare_shingles(texts, weights, similarity)
    steps = []
    for turn in range(STARS + 1):
        if turn:  # classes so far
            known = rare.drop("comp").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        else:
            known = rare
        pairs = _rare_stars(known, similarity, turn) if turn < STARS else _met_pairs(known, similarity)
        todo = pairs
        for done in steps:
            todo = todo.join(done, ["a", "b"], "left_anti")
        todo = saved(todo, "dup-pairs")
        if turn == STARS:
            dropped(pairs)
        steps.append(todo)
        if todo.limit(1).count():
            links = verified(todo, signed, weights, similarity)
            comps = merged(comps, links)
            dropped(links)
    dropped(rare, *steps)
    return comps


def classes(
    rows: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, per_band: int = ROWS
) -> DataFrame:
    """(uid, doc_id, first): `first` is the uid of the class's first row in order of doc_id, null last.

    Rows with equal word sequences (A-Z lower-cased) are one class before anything else. Their
    representatives meet in buckets of band keys. Every member of a bucket is compared with the
    bucket's first; where that leaves a bucket with more than one connected class, all are compared with
    the first member outside the classes of the centers so far, up to `STARS` times: one row a member
    each time, whatever the size of the bucket. Buckets of up to `STARS` members are so compared
    completely. The texts of larger ones that still hold several classes then meet by rare shingles,
    which finds every class they form (`linked_by_rare`). Comparisons are of whole shingle sets.
    """
    signed = saved(shingled(rows), "dup-shingles")
    weights = shingle_weights(signed)
    keyed = band_keys(signed, weights, bands, per_band)
    # rows without words are classes of their own
    same = [F.col("h1"), F.col("h2"), F.when(F.col("n") == 0, F.col("uid")).otherwise(-1).alias("alone")]
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    exact = saved(
        keyed.groupBy(*same).agg(F.min(F.struct(order.alias("_o"), F.col("bands"))).alias("_f")).select(
            "h1", "h2", "alone", F.col("_f._o").alias("order"), F.col("_f._o.uid").alias("id"), F.col("_f.bands").alias("bands")
        ),
        "dup-exact",
    )
    members = exact.select("id", "order", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("order", "id")).alias("_c"))
    buckets = buckets.where("n > 1").select("band", "key", "n", F.col("_c.id").alias("center"))
    members = saved(members.join(buckets, ["band", "key"]).select("band", "key", "n", "center", "id"), "dup-members")
    tried = saved(members.where("id <> center").select(*_pair(F.col("id"), F.col("center"))).distinct(), "dup-pairs")
    steps, links = [tried], verified(tried, signed, weights, similarity)
    comps = components(links)
    dropped(links)
    centers = members.select("band", "key", F.array("center").alias("centers")).distinct()
    for _ in range(1, STARS):
        known, open_ = _open(members, comps)
        # the least member outside the classes of the centers so far
        held = centers.select("band", "key", "centers", F.explode("centers").alias("id")).join(comps, "id", "left")
        held = held.groupBy("band", "key").agg(F.first("centers").alias("centers"), F.collect_set(F.coalesce("comp", "id")).alias("_held"))
        known = known.join(open_, ["band", "key"]).join(held, ["band", "key"])
        outside = known.where(~F.array_contains("_held", F.col("comp"))).groupBy("band", "key").agg(F.min("id").alias("_center"))
        known = known.join(outside, ["band", "key"]).join(comps.select(F.col("id").alias("_center"), F.col("comp").alias("_comp")), "_center", "left")
        known = saved(known.withColumn("_comp", F.coalesce("_comp", "_center")), "dup-open")
        star = known.where("comp <> _comp").select(*_pair(F.col("id"), F.col("_center"))).distinct()
        for done in steps:
            star = star.join(done, ["a", "b"], "left_anti")
        star = saved(star, "dup-pairs")
        centers = saved(known.select("band", "key", F.concat("centers", F.array("_center")).alias("centers")).distinct(), "dup-centers")
        dropped(known)
        steps.append(star)
        if not star.limit(1).count():
            break
        links = verified(star, signed, weights, similarity)
        comps = merged(comps, links)
        dropped(links)
    known, open_ = _open(members.where(F.col("n") > STARS), comps)
    left = saved(known.join(open_, ["band", "key"]).select("id", "comp").distinct(), "dup-open")
    if left.limit(1).count():
        texts = left.join(signed.select(F.col("uid").alias("id"), "shingles"), "id")
        comps = linked_by_rare(texts, comps, signed, weights, similarity)
    best = (
        exact.join(comps, "id", "left")
        .withColumn("comp", F.coalesce("comp", "id"))
        .select("h1", "h2", "alone", "order", "comp")
    )
    heads = best.groupBy("comp").agg(F.min("order").alias("_head")).select("comp", F.col("_head.uid").alias("first"))
    named = best.join(heads, "comp").select("h1", "h2", "alone", "first")
    out = saved(
        keyed.select("uid", "doc_id", "h1", "h2", same[2]).join(named, ["h1", "h2", "alone"]).select("uid", "doc_id", "first"),
        "dup-classes",
    )
    dropped(signed, keyed, exact, members, left, *steps)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept) per row: the id of the first document of its class, and whether it is that row.

    Classes are connected by weighted Jaccard similarity of at least `similarity` over runs of
    `SHINGLE` words; shorter texts are one shingle. Null texts and texts without words are alone.
    Repeated rows are one class, of equal ids the first row counts as the first. Very long texts are cut
    into overlapping pieces and compared whole. An empty table gives no rows; other columns are not read.
    """
    rows = saved(docs.select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id()), "dup-docs")
    found = classes(rows, similarity)
    dropped(rows)
    heads = found.where("uid = first").select("first", F.col("doc_id").alias("class_id"))
    return found.join(heads, "first").select("doc_id", "class_id", (F.col("uid") == F.col("first")).alias("kept"))


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` less all rows but the first of each class; columns of any name and texts as before.

    Texts stay where they are read: only rows that may be among those that go are joined with them.
    """
    names = docs.columns
    (uid,) = fresh(docs, "uid")
    rows = saved(docs.withColumn(uid, F.monotonically_increasing_id()), "dup-docs")
    found = classes(rows.select(F.col(uid).alias("uid"), "doc_id", "text"), similarity)
    gone = saved(found.where("uid <> first").select(F.col("uid").alias("id")), "dup-gone")
    dropped(found)
    maybe = maybe_in(F.col(uid), gone)
    left = rows.where(maybe).join(gone.withColumnRenamed("id", uid), uid, "left_anti")
    return rows.where(~maybe).select(*names).union(left.select(*names))


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
