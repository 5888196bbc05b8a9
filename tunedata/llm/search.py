"""Ranked lexical search of many queries at once, with common term sets evaluated once per document.

All queries of a block are answered in one pass. Term sets that several queries share are mined from the
queries; they form a graph whose leaves are terms and whose inner nodes are sets. For every document each
node's partial sum is made once, from the sums of its two parts, and queries add up the nodes they are
left with. Sums are of integers, so the order of adding does not matter.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunedata.llm import bytes_ as B
from tunedata.llm.tables import dropped, saved, table, text_of
from tunedata.operators.blocks import running_total

TOP = 10
# ASCII letters and digits and everything beyond ASCII
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BREAKS = B.class_table(bytes(b for b in range(128) if not chr(b).isalnum()))
# Terms of the queries answered in one pass over the documents; the last query of a pass may exceed it.
BLOCK_TERMS = 1 << 16
ACCUMULATORS = 1 << 22  # partial sums held at a time
SALTS = 64


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- the query-sharing graph -----------------------------------------------------------------


@dataclass
class Plan:
    """How the term sets of the queries are put together. Nodes 0 … n_terms - 1 are the terms."""

    terms: list[bytes]
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # (nodes, first parts, second parts), parts before wholes
    queries: list  # the key of every query
    flat: np.ndarray  # the nodes each query adds up, one query after another
    start: np.ndarray

    @property
    def n_nodes(self) -> int:
        return len(self.terms) + sum(x[0].size for x in self.levels)


def _chosen(run: list[int], counts: Counter) -> list[int]:
    """Places of a run where two neighbours are replaced: the more frequent of overlapping pairs."""
    at, i = [], 0
    while i + 1 < len(run):
        here = counts.get((run[i], run[i + 1]), 0)
        if here > 1 and here >= counts.get((run[i + 1], run[i + 2]) if i + 2 < len(run) else None, 0):
            at.append(i)
            i += 1
        i += 1
    return at


def sharing_plan(queries: dict[object, set[bytes]]) -> Plan:
    """Mine shared term sets among the queries.

    The terms of a query are put in order of how many queries hold them, so that what queries share lies
    together. Neighbours that occur in two queries or more become a node; this is repeated on the
    shortened queries until no pair is shared. Work and size are linear in the terms for each round.
    """
    held = Counter(t for terms in queries.values() for t in terms)
    order = sorted(held, key=lambda t: (-held[t], t))
    code = {t: i for i, t in enumerate(order)}
    keys = [k for k, terms in queries.items() if terms]
    runs = [sorted(code[t] for t in queries[k]) for k in keys]
    levels, n = [], len(order)
    while True:
        counts = Counter(p for r in runs for p in zip(r, r[1:], strict=False))
        used = Counter((r[i], r[i + 1]) for r in runs for i in _chosen(r, counts))
        kept = Counter({p: c for p, c in used.items() if c > 1})
        if not kept:
            break
        node = {p: n + i for i, p in enumerate(sorted(kept))}
        levels.append((np.arange(n, n + len(node)), *np.array(sorted(kept), np.int64).T))
        n += len(node)
        for r in runs:
            for i in reversed(_chosen(r, kept)):
                r[i : i + 2] = [node[r[i], r[i + 1]]]
    flat = np.array([x for r in runs for x in r], np.int64)
    return Plan(order, levels, keys, flat, np.cumsum([0, *map(len, runs)])[:-1])


# --- documents -------------------------------------------------------------------------------


def postings(docs: DataFrame, terms: list[bytes], id: str) -> DataFrame:
    """(id, n, codes, tfs) of every document that has a term: its length, and the given terms it holds."""
    known = B.Words([b" ".join(terms)], TERM_BREAKS).hashes()
    order = np.argsort(known)
    shared = docs.sparkSession.sparkContext.broadcast((known[order], order))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, codes = shared.value
        for batch in batches:
            length, found = np.zeros(batch.num_rows, np.int64), []
            for owners, pieces in B.slices(B.texts(batch.column(1))):
                words = B.Words(pieces, TERM_BREAKS, lower=True)
                np.add.at(length, owners, words.count)
                h = words.hashes()
                at = np.minimum(np.searchsorted(hashes, h), hashes.size - 1)
                hit = np.flatnonzero(hashes[at] == h)
                row = np.asarray(owners, np.int64)[words.owner()[hit]]
                found.append(np.stack(np.unique(row * hashes.size + codes[at[hit]], return_counts=True)))
            pairs = np.concatenate([*found, np.zeros((2, 0), np.int64)], axis=1)
            key, inverse = np.unique(pairs[0], return_inverse=True)  # a long text spans several groups
            tf = np.bincount(inverse, pairs[1], key.size).astype(np.int64)
            row, code = np.divmod(key, hashes.size)
            edges = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(length),
                    pa.ListArray.from_arrays(edges, pa.array(code.astype(np.int32))),
                    pa.ListArray.from_arrays(edges, pa.array(tf)),
                ],
                ["id", "n", "codes", "tfs"],
            )
            yield out.filter(pa.array(length > 0))

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(docs[id].alias("id"), text_of(docs).alias("text")).mapInArrow(
        read, f"id {kind}, n long, codes array<int>, tfs array<long>"
    )


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    """A term's weight from the number of documents and of those that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _best(row: np.ndarray, rank: np.ndarray, ids: list, k: int) -> list[tuple]:
    """The k best of one query in a group of documents as (-score, id is null, id)."""
    at = np.flatnonzero(row > 0)
    if at.size > k:
        at = at[row[at] >= np.partition(row[at], at.size - k)[at.size - k]]
    at = at[np.lexsort((rank[at], -row[at]))[:k]]
    return [(-int(row[i]), ids[i] is None, ids[i]) for i in at.tolist()]


def scored(posted: DataFrame, plan: Plan, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, id, score): the k best documents of every query in every task."""
    shared = posted.sparkSession.sparkContext.broadcast((plan, weights))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights = shared.value
        width = max(1, ACCUMULATORS // (plan.n_nodes + plan.flat.size))
        best: list[list] = [[] for _ in plan.queries]
        kind = None
        for batch in batches:
            id_, n, codes, tfs = batch.columns
            kind, ids = id_.type, id_.to_pylist()
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(id_).to_numpy()] = np.arange(len(ids))
            edges = codes.offsets.to_numpy() - codes.offsets[0].as_py()
            owner = np.repeat(np.arange(len(ids)), np.diff(edges))
            code, tf = codes.flatten().to_numpy(), tfs.flatten().to_numpy()
            m = 100 - 90 + (90 * n.to_numpy() * n_docs) // n_terms
            value = weights[code] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
            for low in range(0, len(ids), width):
                high = min(len(ids), low + width)
                part = slice(edges[low], edges[high])
                sums = np.zeros((plan.n_nodes, high - low), np.int64)
                sums[code[part], owner[part] - low] = value[part]
                for nodes, first, second in plan.levels:
                    sums[nodes] = sums[first] + sums[second]
                rows = np.add.reduceat(sums[plan.flat], plan.start, axis=0)
                floor = np.array([-b[-1][0] if len(b) == k else 1 for b in best])
                for q in np.flatnonzero(rows.max(axis=1) >= floor).tolist():
                    row = np.where(rows[q] >= floor[q], rows[q], 0)
                    best[q] = heapq.nsmallest(k, best[q] + _best(row, rank[low:high], ids[low:high], k))
        found = [(q, b) for q, every in zip(plan.queries, best, strict=True) for b in every]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for q, _ in found]), pa.array([b[2] for _, b in found], kind), pa.array([-b[0] for _, b in found])],
                ["query", "id", "score"],
            )

    kind = posted.schema["id"].dataType.simpleString()
    return posted.mapInArrow(read, f"query long, id {kind}, score long")


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id: str = "doc_id", item: str = "item_id") -> DataFrame:
    """The `k` best documents of every item -> item_id, rank, doc_id, score (named as `item` and `id`).

    Terms are runs of letters, digits and what lies beyond ASCII, with A-Z lowered. Null, empty and
    termless documents have no part in any count and are never found; such items find nothing, and so
    does every item if there are no documents. Repeated documents are ranked each, repeated items
    answered each. Equal scores go by ascending id, null last; equal ids by chance, since they look alike.
    Very long texts are read in groups of bounded size. Other columns of either table are not read.

    Items are answered in blocks of about `BLOCK_TERMS` terms, each one pass over the texts; memory is
    bounded by the block, not by the items or documents.
    """
    spark = docs.sparkSession
    terms = F.array_distinct(F.regexp_extract_all(lowered(text_of(items)), F.lit(TERM), F.lit(0)))
    asked = items.select(items[item].alias("item"), terms.alias("terms")).where(F.size("terms") > 0)
    asked = saved(asked.withColumn("query", F.monotonically_increasing_id()), "search-items")
    sized = asked.select("query", F.size("terms").alias("size"), F.lit(0).alias("all"))
    placed = running_total(sized, ["all"], ["query"], F.col("size"), "before", exclusive=True)
    placed = saved(placed.select("query", F.expr(f"before div {BLOCK_TERMS}").alias("block")), "search-blocks")
    kind = docs.schema[id].dataType
    found = spark.createDataFrame([], "query long, score long").withColumn("id", F.lit(None).cast(kind)).select("query", "id", "score")
    for (block,) in placed.select("block").distinct().orderBy("block").collect():  # one row a block
        rows = asked.join(placed.where(F.col("block") == block), "query").select("query", "terms").collect()
        plan = sharing_plan({r.query: {t.encode() for t in r.terms} for r in rows})
        posted = saved(postings(docs, plan.terms, id), "search-postings")
        n_docs, n_terms = posted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if n_docs:
            df = np.zeros(len(plan.terms), np.int64)
            for r in posted.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # one row a term of the block
                df[r["code"]] = r["count"]
            found = found.unionByName(saved(scored(posted, plan, weight(n_docs, df), n_docs, n_terms, k), "search-best"))
        dropped(posted)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))  # what many tasks found meets in two steps
    ranked = _ranked(_ranked(salted, ["query", "salt"], k).drop("rank"), ["query"], k)
    return ranked.join(asked.select("query", "item"), "query").select(
        F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id), "score"
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents WHERE text IS NOT NULL
), sized AS (
  SELECT doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sized
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term
), part AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))) AS s
  FROM tf JOIN w USING (term), total
), score AS (
  SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM q JOIN part USING (term) GROUP BY ALL HAVING sum(s) > 0
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM score QUALIFY rank <= 10
"""
