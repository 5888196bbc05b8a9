"""LM scoring: prediction by partial matching over bytes, trained on the corpus itself."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunedata.llm import bytes_ as B
from tunedata.llm.tables import dropped, held_out, saved, table, text_of

FOLDS, ORDER = 10, 5
# symbols: 0 before a text, byte + 1, and the end of a text
START, END, BITS, SYMBOLS = 0, 257, 9, 257
BLOCK_BYTES = 16 << 20
# a table of so many n-grams (12 bytes each) may be sent to every worker; a larger one goes by the shuffle
MOST_SHARED = 4_000_000
ADDED = 0.1

BLOCKS = "block long, docs binary, grams array<long>, gram_counts array<long>, words array<long>, word_counts array<long>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def gram_keys(pieces: list[bytes], first: list[bool], last: list[bool], lead: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, key) of every symbol of the pieces with the `ORDER` symbols before it, 9 bits each.

    `first` and `last` tell whether a piece begins and ends its text; `lead` holds the bytes before it.
    """
    parts, skip, size = [], [], []
    for p, a, z, before in zip(pieces, first, last, lead, strict=True):
        head = np.zeros(ORDER, np.uint64)
        if not a:
            head[ORDER - len(before) :] = B.LOWER[np.frombuffer(before, np.uint8)].astype(np.uint64) + 1
        body = B.LOWER[np.frombuffer(p, np.uint8)].astype(np.uint64) + np.uint64(1)
        parts += [head, body, np.full(int(z), END, np.uint64)]
        size.append(ORDER + body.size + int(z))
    seq = np.concatenate(parts)
    key = seq.copy()
    for k in range(1, ORDER + 1):
        key[k:] |= seq[:-k] << np.uint64(BITS * k)
    skip = np.ones(seq.size, bool)
    begins = np.cumsum(size) - size
    for k in range(ORDER):
        skip[begins + k] = False
    owner = np.repeat(np.arange(len(pieces)), size)
    return owner[skip], key[skip].view(np.int64)


def _cut(rows: list[bytes]) -> Iterator[tuple[list[int], list[bytes], list[bool], list[bool], list[bytes]]]:
    """Slices with what `gram_keys` needs to treat the pieces of a long text as one text."""
    done = [0] * len(rows)
    for owners, pieces in B.slices(rows):
        first, last, lead = [], [], []
        for r, p in zip(owners, pieces, strict=True):
            first.append(done[r] == 0)
            lead.append(rows[r][max(0, done[r] - ORDER) : done[r]])
            done[r] += len(p)
            last.append(done[r] == len(rows[r]))
        yield owners, pieces, first, last, lead


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if key.size else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if key.size else count


def _distinct(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each stands in a training text (maybe never)."""
    found = [_counted([part], [np.full(part.size, n, np.int64)]) for n, part in ((1, keys[train]), (0, keys[~train]))]
    return _counted([f[0] for f in found], [f[1] for f in found])


def _block(number: int, ids: list, held: np.ndarray, rows: list[bytes]) -> pa.RecordBatch:
    grams, words = ([], []), ([], [])
    for owners, pieces, first, last, lead in _cut(rows):
        train = ~held[owners]
        piece, key = gram_keys(pieces, first, last, lead)
        got = _distinct(key, train[piece])
        grams[0].append(got[0])
        grams[1].append(got[1])
        found = B.Words(pieces, lower=True)
        if len(found):
            got = _distinct(found.hashes().view(np.int64), train[found.owner()])
            words[0].append(got[0])
            words[1].append(got[1])
    empty = [np.zeros(0, np.int64)]
    gram, gram_n = _counted(grams[0] or empty, grams[1] or empty)
    word, word_n = _counted(words[0] or empty, words[1] or empty)
    texts = pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(held), pa.array(rows, pa.large_binary())], ["doc_id", "held_out", "text"]
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(texts)
    values = [gram, gram_n, word, word_n]
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([sink.getvalue().to_pybytes()]), *[_one_list(v) for v in values]],
        ["block", "docs", "grams", "gram_counts", "words", "word_counts"],
    )


def _one_list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(values, pa.int64()))


def blocks_of(docs: DataFrame, folds: int) -> DataFrame:
    """The corpus as blocks of about `BLOCK_BYTES` of text: the texts, and the distinct n-grams and words of
    each block with their counts in training texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, rows, size = [], [], [], 0
        for batch in batches:
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), B.texts(batch.column(2)), strict=True):
                if rows and size + len(t) > BLOCK_BYTES:
                    yield _block(number, ids, np.array(held, bool), rows)
                    number += 1
                    ids, held, rows, size = [], [], [], 0
                ids.append(i)
                held.append(h)
                rows.append(t)
                size += len(t)
        if rows:
            yield _block(number, ids, np.array(held, bool), rows)

    columns = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), folds), text_of(docs))
    return columns.mapInArrow(read, BLOCKS)


def _pairs(blocks: DataFrame, keys: str, counts: str) -> DataFrame:
    zipped = F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(counts).alias("n"))).alias("x")
    return blocks.select("block", zipped).select("block", "x.key", "x.n")


def log_probabilities(grams: DataFrame) -> DataFrame:
    """(key, value): log10 of the probability of the last symbol of each n-gram after the others.

    The trie is one table per order, keyed by a context with its next symbol; order j comes from order
    j + 1 by leaving out the oldest symbol. A context seen `total` times with `kinds` different symbols
    escapes with kinds / (total + kinds) (method C). What is left to the shorter context excludes the
    symbols of the longer: its total and kinds are reduced by theirs. Symbols seen nowhere share the
    last escape evenly. All steps are joins by key and sums per context of at most 257 symbols.
    """
    levels = [grams.select("key", F.col("n").alias("c"))]
    for j in range(ORDER - 1, -1, -1):
        shorter = F.col("key").bitwiseAND(F.lit((1 << BITS * (j + 1)) - 1))
        levels.insert(0, saved(levels[0].groupBy(shorter.alias("key")).agg(F.sum("c").alias("c")), "lm-order"))
    context = Window.partitionBy(F.shiftright("key", BITS))
    seen = F.col("c") > 0
    own = {"total": F.sum("c").over(context), "kinds": F.sum(seen.cast("long")).over(context)}
    below = saved(
        levels[0].withColumns(own).withColumn("rest", F.lit(1.0) / F.greatest(SYMBOLS - F.col("kinds"), F.lit(1))), "lm-level"
    )
    made = [below]
    for j in range(1, ORDER + 1):
        short = below.select(*[F.col(c).alias(f"_{c}") for c in ("key", "c", "total", "kinds", "rest")])
        step = levels[j].withColumns(own).withColumn("_key", F.col("key").bitwiseAND(F.lit((1 << BITS * j) - 1)))
        step = step.join(short, "_key").withColumn("_excluded", F.sum(F.when(seen, F.col("_c")).otherwise(0)).over(context))
        total, kinds = F.col("_total") - F.col("_excluded"), F.col("_kinds") - F.col("kinds")
        rest = F.when(F.col("_c") > 0, (F.col("_c") - 0.5) / total).otherwise(
            F.when(total > 0, kinds / total / 2).otherwise(1.0) * F.col("_rest")
        )
        below = saved(step.select("key", "c", "total", "kinds", F.when(~seen, rest).alias("rest")), "lm-level")
        made.append(below)
    escape = F.when(F.col("total") > 0, F.col("kinds") / F.col("total") / 2).otherwise(1.0)
    p = F.when(seen, (F.col("c") - 0.5) / F.col("total")).otherwise(escape * F.col("rest"))
    out = saved(below.select("key", F.log10(p).cast("float").alias("value")), "lm-costs")
    dropped(*made, *levels[:-1])
    return out


class Lookup:
    """Values by key, through one hash table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.index, self.values = pd.Index(keys), values

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        return self.values[self.index.get_indexer(wanted)]


@lru_cache(maxsize=1)
def _shared_lookup(shared: Broadcast) -> Lookup:
    """Built once in a worker process."""
    return Lookup(*shared.value)


def _scored(block: pa.Table, known: pa.Table, grams: Lookup | None, train_tokens: float, distinct: float, ends: float) -> pa.Table:
    kind, key, value = (known.column(c).to_numpy() for c in ("kind", "key", "value"))
    grams, words = grams or Lookup(key[kind == 0], value[kind == 0]), Lookup(key[kind == 1], value[kind == 1])
    log_of = lambda c: np.log10((c + ADDED) / (train_tokens + ADDED * (distinct + 1)))
    parts = []
    for packed in block.column("docs").to_pylist():
        texts = pa.ipc.open_stream(packed).read_all()
        rows = texts.column("text").to_pylist()
        n, known_n = np.ones(len(rows), np.int64), np.full(len(rows), int(ends > 0), np.int64)
        base, score = np.full(len(rows), log_of(ends)), np.zeros(len(rows))
        for owners, pieces, first, last, lead in _cut(rows):
            piece, codes = gram_keys(pieces, first, last, lead)
            np.add.at(score, owners, np.bincount(piece, grams(codes), len(pieces)))
            found = B.Words(pieces, lower=True)
            if len(found):
                count = words(found.hashes().view(np.int64))
                np.add.at(base, owners, found.per_piece(log_of(count)))
                np.add.at(n, owners, found.count)
                np.add.at(known_n, owners, found.per_piece(count > 0).astype(np.int64))
        columns = [texts.column("doc_id"), texts.column("held_out"), pa.array(n), pa.array(known_n), pa.array(base), pa.array(score)]
        parts.append(pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
    return pa.concat_tables(parts)


def score_texts(docs: DataFrame, folds: int = FOLDS, most_shared: int = MOST_SHARED) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    A byte model of order `ORDER` and word counts are learned from the documents outside the held-out
    fold, and every whole text is scored by both. Letters A-Z are lower-cased; a text ends with an
    end symbol, so a null or empty text has one token and the probability of ending at once. Without
    training documents all symbols are equally likely. Repeated rows are counted and scored each.

    The corpus is cut into blocks, counts meet by key, and each block gets back just the word counts
    its own texts ask for, and their n-gram costs alike. Only where the corpus has at most
    `most_shared` distinct n-grams are all costs sent to the workers instead, with the same result.
    """
    spark = docs.sparkSession
    blocks = saved(blocks_of(docs, folds), "lm-blocks")
    grams, words = _pairs(blocks, "grams", "gram_counts"), _pairs(blocks, "words", "word_counts")
    gram_sums = saved(grams.groupBy("key").agg(F.sum("n").alias("n")), "lm-grams")
    by_key = Window.partitionBy("key")
    counted = words.select(
        "block",
        "key",
        F.sum("n").over(by_key).alias("total"),
        (F.row_number().over(by_key.orderBy("block")) == 1).alias("first"),
    )
    counted = saved(counted, "lm-words")
    ends = docs.where(~held_out(F.col("doc_id"), folds)).count()
    in_block = F.aggregate("word_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    train_tokens = (blocks.agg(F.sum(in_block)).first()[0] or 0) + ends
    distinct = counted.where("first and total > 0").count() + int(ends > 0)
    costs = log_probabilities(gram_sums)
    lookups = counted.select("block", F.lit(1).cast("byte").alias("kind"), "key", F.col("total").cast("double").alias("value"))
    shared = None
    if costs.count() <= most_shared:
        table_ = costs.toArrow()
        shared = spark.sparkContext.broadcast((table_.column("key").to_numpy(), table_.column("value").to_numpy()))
    else:
        wanted = grams.select("block", "key").join(costs, "key")
        lookups = lookups.union(wanted.select("block", F.lit(0).cast("byte"), "key", F.col("value").cast("double")))
    lookups = lookups.withColumnRenamed("block", "of_block")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        return _scored(left, right, _shared_lookup(shared) if shared else None, train_tokens, distinct, ends)

    texts = blocks.select("block", "docs")
    out = texts.groupBy("block").cogroup(lookups.groupBy("of_block")).applyInArrow(scored, SCORES)
    return out.withColumn("train_tokens", F.lit(train_tokens).cast("long"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
