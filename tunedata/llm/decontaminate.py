"""Benchmark decontamination: an FM-index per shard of training text, searched for test phrases."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm import bytes_ as B
from tunedata.llm.tables import fresh, table, text_of

WINDOW = 10
# test text sent to the tasks at a time; a larger benchmark is searched for in several passes
ITEM_BLOCK_BYTES = 16 << 20
SAMPLE_STEP = 8
BREAKS = B.class_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def suffix_array(seq: np.ndarray, alphabet: int) -> np.ndarray:
    """Order of all suffixes of `seq`, in which 0 ends a document and compares by position.

    The first sort packs as many symbols as fit one number; prefix doubling then goes on among the
    suffixes that are still tied.
    """
    n = seq.size
    rank0 = seq.astype(np.int64)
    ends = np.flatnonzero(seq == 0)
    rank0 += ends.size - 1
    rank0[ends] = np.arange(ends.size)
    top = alphabet + ends.size + 1
    width = max(1, min(4, int(62 // max(1, math.log2(top + 1)))))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key *= top + 1
        key[: n - k] += rank0[k:] + 1
    order = np.argsort(key)
    ordered = key[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    heads = np.flatnonzero(fresh)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    h = width
    tied = _tied(fresh)
    while tied.size:
        who = order[tied]
        after = np.where(who + h < n, rank[np.minimum(who + h, n - 1)], -1)
        by = np.lexsort((after, rank[who]))
        who, after = who[by], after[by]
        order[tied] = who
        first = rank[who]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (after[1:] != after[:-1])])
        at = np.flatnonzero(new)
        rank[who] = np.repeat(tied[at], np.diff(np.append(at, who.size)))
        tied = tied[_tied(new)]
        h *= 2
    return order


def _tied(fresh: np.ndarray) -> np.ndarray:
    """Places in groups of two or more, given where groups begin."""
    alone = fresh & np.append(fresh[1:], True)
    return np.flatnonzero(~alone)


class Wavelet:
    """Wavelet matrix: symbol counts before a place, and the symbol at a place, in one step per bit."""

    def __init__(self, seq: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            count = np.zeros(seq.size + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(seq.size - int(count[-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first `at` places."""
        low = np.zeros(at.size, np.int64)
        for ones, zeros, b in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            bit = (symbol >> b) & 1
            at = np.where(bit, zeros + ones[at], at - ones[at])
            low = np.where(bit, zeros + ones[low], low - ones[low])
        return at - low

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, its occurrences before it)."""
        symbol, low = np.zeros(at.size, np.int64), np.zeros(at.size, np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit, zeros + ones[at], at - ones[at])
            low = np.where(bit, zeros + ones[low], low - ones[low])
        return symbol, at - low


class FMIndex:
    """Backward search and location over a sequence of symbols 1..alphabet-1 with document ends 0."""

    def __init__(self, seq: np.ndarray, alphabet: int):
        order = suffix_array(seq, alphabet)
        self.size = seq.size
        self.wavelet = Wavelet(seq[order - 1], alphabet)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=alphabet))])
        place = np.arange(seq.size)
        # sampled suffixes: every few words, and the first word after a document end
        kept = (place % SAMPLE_STEP == 0) | (seq[place - 1] == 0)
        self.sampled = kept[order]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each phrase (one per row)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        found = np.zeros(len(phrases), bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text position of each suffix, by stepping back to a sampled one."""
        at, steps, out = at.copy(), np.zeros(at.size, np.int64), np.empty(at.size, np.int64)
        open_ = np.arange(at.size)
        while open_.size:
            done = self.sampled[at[open_]]
            hit = open_[done]
            out[hit] = self.samples[self.sample_rank[at[hit]]] + steps[hit]
            open_ = open_[~done]
            symbol, count = self.wavelet.step(at[open_])
            at[open_] = self.before[symbol] + count
            steps[open_] += 1
        return out


@dataclass
class Phrases:
    """Distinct windows of the items, grouped by length, each with the items that hold it."""

    hashes: list[np.ndarray]
    items: list[list[list[str]]]


def phrases_of(ids: list[str], texts: list[bytes], window: int) -> Phrases:
    found: dict[int, dict[bytes, set[str]]] = {}
    for name, text in zip(ids, texts, strict=True):
        h = B.Words([text], BREAKS, lower=True).hashes()
        length = min(window, h.size)
        for i in range(h.size - length + 1 if length else 0):
            found.setdefault(length, {}).setdefault(h[i : i + length].tobytes(), set()).add(name)
    lengths = sorted(found)
    return Phrases(
        [np.frombuffer(b"".join(found[n]), np.uint64).reshape(-1, n) for n in lengths],
        [[sorted(x) for x in found[n].values()] for n in lengths],
    )


def _overlapped(rows: list[bytes], overlap: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Shards of about `SLICE_BYTES`: (row, words before, bytes before, piece). A long text goes in
    pieces that repeat the last `overlap` words of the one before, so that no window is cut."""
    shard, size = [], 0
    for i, text in enumerate(rows):
        words = start = at = 0
        for piece in B.cut(text, B.SLICE_BYTES) if len(text) > B.SLICE_BYTES else (text,):
            whole = text[start : at + len(piece)]
            if shard and size + len(whole) > B.SLICE_BYTES:
                yield shard
                shard, size = [], 0
            shard.append((i, words, start, whole))
            size += len(whole) + 1
            at += len(piece)
            if at < len(text):
                seen = B.Words([whole], BREAKS, lower=True)
                kept = min(overlap, len(seen))
                words += len(seen) - kept
                start = start + int(seen.start[len(seen) - kept]) if kept else at
    if shard:
        yield shard


def _hits(shard: list[tuple[int, int, int, bytes]], phrases: Phrases) -> tuple[list[tuple], np.ndarray]:
    """Occurrences as (row, first word, end word, first byte, end byte, items), and words per piece."""
    words = B.Words([p for *_, p in shard], BREAKS, lower=True)
    if not len(words):
        return [], words.count
    codes, example = words.distinct(hashes := words.hashes())
    known = hashes[example]
    by = np.argsort(known)
    # a document end after every piece
    place = np.arange(len(words)) + words.owner()
    seq = np.zeros(len(words) + len(shard), np.int64)
    seq[place] = codes + 1
    index = FMIndex(seq, example.size + 1)
    out = []
    for wanted, items in zip(phrases.hashes, phrases.items, strict=True):
        spot = np.minimum(np.searchsorted(known[by], wanted), known.size - 1)
        code = by[spot]
        there = np.flatnonzero((known[code] == wanted).all(1))
        low, high = index.search(code[there] + 1)
        count = high - low
        which = np.repeat(there, count)
        rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = index.locate(rows)
        word = np.searchsorted(place, at)
        piece = np.searchsorted(words.first, word, "right") - 1
        starts = np.concatenate([[0], np.cumsum([len(p) + 1 for *_, p in shard])])
        n = wanted.shape[1]
        for q, w, p in zip(which.tolist(), word.tolist(), piece.tolist(), strict=True):
            row, before, offset, _ = shard[p]
            first = before + w - int(words.first[p])
            shift = offset - int(starts[p])
            out.append((row, first, first + n, int(words.start[w]) + shift, int(words.end[w + n - 1]) + shift, items[q]))
    return out, words.count


def _merged(hits: list[tuple]) -> list[list[int]]:
    """Spans of one document that touch or overlap by words, joined."""
    spans: list[list[int]] = []
    for _, first, end, a, b, _ in sorted(hits, key=lambda x: x[1:3]):
        if spans and first <= spans[-1][1]:
            if end > spans[-1][1]:
                spans[-1][1], spans[-1][3] = end, b
        else:
            spans.append([first, end, a, b])
    return spans


SPAN = pa.struct([("word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
LEAKS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(SPAN)), ("items", pa.list_(pa.string()))])
LEAKS_SQL = "n_words long, spans array<struct<word long, end_word long, start long, end long>>, items array<string>"


NO_ID = "\0"  # no text of a table holds this character alone


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, name: str = "leaks") -> DataFrame:
    """`docs` with `leaks` (or another `name`): n_words, spans (by word, and by byte of the UTF-8 text) and items.

    A window is `window` consecutive words of an item, or the whole of a shorter one; words are
    lower-cased in A-Z. Each Arrow batch is indexed in shards of bounded size, and every window of the
    items is searched in every shard; nothing is shuffled. Null and empty texts have no words, null or
    wordless items no windows, and without items nothing leaks; repeated rows and items count alike. An
    item without an id has its passages found, but no place among `items`. A column of the name `leaks`
    is replaced; all others pass unchanged. An empty table gives an empty table.

    Items reach the tasks in blocks of about `ITEM_BLOCK_BYTES`, one pass over the documents a block.
    """
    items = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / ITEM_BLOCK_BYTES))
    out, found = docs, fresh(docs, *[f"leaks{n}" for n in range(blocks)])
    for n in range(blocks):
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == n).orderBy("id", "text").collect()
        phrases = phrases_of([NO_ID if r.id is None else r.id for r in block], [r.text.encode() for r in block], window)
        out = out.withColumn(found[n], _search(docs, phrases, window)(text_of(docs)))
    every = [F.col(x) for x in found]
    if blocks == 1:
        return out.withColumn(name, every[0]).drop(*found)
    return out.withColumn(
        name,
        F.struct(
            every[0]["n_words"].alias("n_words"),
            _union(F.array_sort(F.flatten(F.array(*[e["spans"] for e in every])))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.array(*[e["items"] for e in every])))).alias("items"),
        ),
    ).drop(*found)


def _union(spans):
    """Sorted spans of several passes, joined where they touch."""
    empty = F.slice(spans, F.lit(1), F.lit(0))

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(
            last["word"].alias("word"),
            F.greatest(last["end_word"], x["end_word"]).alias("end_word"),
            last["start"].alias("start"),
            F.greatest(last["end"], x["end"]).alias("end"),
        )
        touching = (F.size(done) > 0) & (x["word"] <= last["end_word"])
        return F.when(touching, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(x))
        )

    return F.aggregate(spans, empty, add)


def _search(docs: DataFrame, phrases: Phrases, window: int):
    shared = docs.sparkSession.sparkContext.broadcast(phrases)  # of one block of items

    def leaks(column: pa.Array) -> pa.Array:
        rows = B.texts(column)
        n_words, found = [0] * len(rows), [[] for _ in rows]
        for shard in _overlapped(rows, window - 1):
            hits, counts = _hits(shard, shared.value)
            for (row, before, *_), n in zip(shard, counts.tolist(), strict=True):
                n_words[row] = before + n
            for hit in hits:
                found[hit[0]].append(hit)
        keys = ("word", "end_word", "start", "end")
        return pa.array(
            [
                {
                    "n_words": n,
                    "spans": [dict(zip(keys, s, strict=True)) for s in _merged(hits)],
                    "items": sorted({i for h in hits for i in h[5]} - {NO_ID}),
                }
                for n, hits in zip(n_words, found, strict=True)
            ],
            LEAKS,
        )

    return F.arrow_udf(B.in_parts(leaks), LEAKS_SQL)


def without_spans(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts less the bytes of their spans."""
    out = []
    for t, cuts in zip(B.texts(text), spans.to_pylist(), strict=True):
        at, parts = 0, []
        for s in cuts:
            parts.append(t[at : s["start"]])
            at = s["end"]
        out.append(b"".join([*parts, t[at:]]).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def remove_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with the leaked spans cut out of `text`; all other texts and all columns are as before, whatever their names."""
    names = docs.columns
    (leaks,) = fresh(docs, "leaks")
    step = find_leaks(docs, items, window, leaks)
    spans = F.col(f"{leaks}.spans")
    cut = F.when(F.size(spans) > 0, F.arrow_udf(B.in_parts(without_spans), "string")(text_of(step), spans)).otherwise(F.col("text"))
    return step.withColumn("text", cut).select(*names)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(
        "leaks.spans", F.lit(0).cast("long"), lambda a, x: a + x["end_word"] - x["word"]
    )
    return found.select(
        "doc_id",
        F.col("leaks.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leaks.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
