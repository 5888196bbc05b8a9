"""Phrase collocations by set-oriented mining of occurrence relations.

R1 holds every occurrence of a word in order of its place; Rk those of the frequent phrases of k words.
Rk+1 comes from Rk by a merge-join with itself: a phrase at a place meets the phrase at the next place,
which is its own continuation, if both lie in one piece of text. The pairs are grouped and counted over
the whole table, and a semi-join keeps the occurrences of frequent pairs before the next length.

A relation is stored in blocks of one language, sorted by place, one row a block: steps from place to
place, codes, and what each code of the block stands for, all packed. The merge-join happens inside the
rows; counts and semi-joins are Spark's, on one row for each block and distinct pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tunedata.llm import bytes_ as B
from tunedata.llm.tables import dropped, saved, table, text_of

LONGEST = 5
LEAST_COUNT = 100
TOP = 2000
NO_LANG = "und"
BLOCK_BYTES = 32 << 20
# a code of a block as one number: the task, its block, the code
CODE_BITS, BLOCK_BITS = 24, 14
PIECE_ENDS = bytes(map(ord, ".,;:!?\n\x0b\x0c\r"))
ENDS_PIECE = B.class_table(PIECE_ENDS)
BREAKS = B.class_table(PIECE_ENDS + b" \t")
SALTS = 64

# steps, codes: the occurrences; first, second, n: what a code stands for, and how often it occurs
RELATION = "block long, lang string, steps binary, codes binary, first binary, second binary, n binary"
CODEC = "zstd"
OUT_ROWS = 1 << 16

# steps, codes: the occurrences; first, second, n: what a code stands for, and how often it occurs
RELATION = "block long, lang string, steps binary, codes binary, first binary, second binary, n binary"
CODEC = "zstd"
OUT_ROWS = 1 << 16
# Two primes whose product stays within 63 bits: they spread pairs of numbers over the bit table.
SPREAD = (1_073_741_789, 2_147_483_647)
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def _packed(values: np.ndarray, kind: str = "<i4") -> bytes:
    """Numbers, compressed plane by plane: the lowest bytes of all, then the next, so that small numbers cost little."""
    planes = values.astype(kind).view(np.uint8).reshape(values.size, np.dtype(kind).itemsize).T
    return _compressed(planes.tobytes())


def _compressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, CODEC, asbytes=True)


def _raw(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), CODEC, asbytes=True)


def _unpacked(data: bytes, kind: str = "<i4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_raw(data), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _parts(first: bytes, second: bytes, words: bool) -> tuple:
    """What the codes of a block stand for: words, or the ids of two phrases."""
    if words:
        return None, pa.array(_raw(second).decode("utf-8", "replace").split("\n"), pa.string())
    return pa.array(_unpacked(first, "<i8")), pa.array(_unpacked(second, "<i8"))


def _row(block: int, lang: str, places: np.ndarray, codes: np.ndarray, first: bytes, second: bytes, n: np.ndarray) -> pa.RecordBatch:
    cells = [block, lang, _packed(np.diff(places, prepend=0)), _packed(codes), first, second, _packed(n)]
    kinds = [pa.int64(), pa.string(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays(
        [pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["block", "lang", "steps", "codes", "first", "second", "n"]
    )


def piece_cut(text: bytes, limit: int) -> Iterator[bytes]:
    """Parts of about `limit` bytes that end with a piece; only a longer piece makes a longer part."""
    data, at = np.frombuffer(text, np.uint8), 0
    while len(text) - at > limit:
        end, size = 0, limit
        while not end and at < len(text):
            ends = np.flatnonzero(ENDS_PIECE[data[at : at + size]])
            end = at + int(ends[-1]) + 1 if ends.size else len(text) if at + size >= len(text) else 0
            size *= 2
        yield text[at:end]
        at = end
    yield text[at:]


def _block_id(n: int) -> int:
    """A number no other task gives."""
    if n >> BLOCK_BITS:
        raise ValueError("a task has too many blocks")
    return (TaskContext.get().partitionId() << BLOCK_BITS) + n


# --- R1 --------------------------------------------------------------------------------------


class _Gathering:
    """The words of one language in one block, slice by slice."""

    def __init__(self) -> None:
        self.hashes, self.words, self.codes, self.places = [], [], [], []
        self.size = self.place = self.known = 0

    def add(self, pieces: list[bytes]) -> None:
        words = B.Words(pieces, BREAKS, lower=True)
        self.size += sum(map(len, pieces))
        if not len(words):
            return
        piece = np.cumsum(ENDS_PIECE[words.blob], dtype=np.int32)[words.start]
        steps = 1 + (np.diff(piece, prepend=piece[0] - 1) != 0)
        codes, found = pd.factorize(words.hashes())
        example = np.empty(found.size, np.int64)
        example[codes] = np.arange(codes.size)
        self.hashes.append(found)
        self.words += words.text(example)
        self.codes.append(codes + self.known)
        self.places.append(self.place + np.cumsum(steps))
        self.place, self.known = int(self.places[-1][-1]), self.known + found.size

    def rows(self, block: int, lang: str) -> Iterator[pa.RecordBatch]:
        if not self.codes:
            return
        merged, found = pd.factorize(np.concatenate(self.hashes))
        if found.size >> CODE_BITS:
            raise ValueError("a block has too many words")
        example = np.empty(found.size, np.int64)
        example[merged] = np.arange(merged.size)
        codes = merged[np.concatenate(self.codes)]
        n = np.bincount(codes)
        frequent_first = np.argsort(-n, kind="stable")  # small codes for frequent words
        rank = np.empty(n.size, np.int64)
        rank[frequent_first] = np.arange(n.size)
        words = b"\n".join([self.words[i] for i in example[frequent_first].tolist()])
        yield _row(block, lang, np.concatenate(self.places), rank[codes], b"", _compressed(words), n[frequent_first])


def word_blocks(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """The relation of all word occurrences; `second` holds the words of the block by code.

    Places count the words of a block and skip one between pieces, so that neighbours are words of one piece.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, open_ = 0, {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for owners, pieces in B.slices(B.texts(batch.column(1)), cutter=piece_cut):
                by_lang: dict[str, list[bytes]] = {}
                for row, piece in zip(owners, pieces, strict=True):
                    by_lang.setdefault(langs[row], []).append(piece)
                for name, mine in by_lang.items():
                    block = open_.setdefault(name, _Gathering())
                    block.add(mine)
                    if block.size >= BLOCK_BYTES:
                        yield from open_.pop(name).rows(_block_id(n), name)
                        n += 1
        for name, block in open_.items():
            yield from block.rows(_block_id(n), name)
            n += 1

    chosen = docs.select(F.coalesce(docs[lang].cast("string"), F.lit(NO_LANG)).alias("lang"), text_of(docs).alias("text"))
    return chosen.mapInArrow(B.freed(read), RELATION)


# --- from Rk to Rk+1 -----------------------------------------------------------------------------


def _joined(places: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of a sorted relation with itself at the next place: places, codes, and per code left, right, count."""
    at = np.flatnonzero(places[1:] == places[:-1] + 1)
    size = max(1, ids.size)
    codes, found = pd.factorize(codes[at].astype(np.int64) * size + codes[at + 1])
    left, right = np.divmod(found, size)
    return places[at], codes, ids[left], ids[right], np.bincount(codes, minlength=left.size)


def extended(relation: DataFrame, kept: DataFrame) -> DataFrame:
    """Rk+1 with its candidate pairs, from Rk and (at, id) of the codes whose phrase is frequent."""
    by_block = kept.groupBy(F.shiftright("at", CODE_BITS).alias("block")).agg(F.collect_list(F.struct("at", "id")).alias("kept"))
    both = relation.select("block", "lang", "steps", "codes").join(by_block, "block").select("block", "lang", "steps", "codes", "kept")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, lang, steps, codes = (batch.column(c)[i].as_py() for c in range(4))
                held = batch.column(4)[i].values
                code, ids = held.field(0).to_numpy() & ((1 << CODE_BITS) - 1), held.field(1).to_numpy()
                codes, places = _unpacked(codes), np.cumsum(_unpacked(steps))
                new = np.full(max(int(codes.max(initial=0)), int(code.max(initial=0))) + 1, -1, np.int32)
                new[code] = np.arange(code.size, dtype=np.int32)
                codes = new[codes]
                there = codes >= 0  # the semi-join with the frequent phrases
                places, codes, left, right, n = _joined(places[there], codes[there], ids)
                if places.size:
                    yield _row(block, lang, places, codes, _packed(left, "<i8"), _packed(right, "<i8"), n)

    return both.mapInArrow(B.freed(step), RELATION)


def _by_code(relation: DataFrame, words: bool) -> DataFrame:
    """(first, second, at, n): a row for each block and code; `first` and `second` are a language and a word, or two ids."""
    kind = "string" if words else "long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, lang, one, two, n = (c[i].as_py() for c in batch.columns)
                first, second = _parts(one, two, words)
                first = pa.array(np.full(len(second), lang, object), pa.string()) if words else first
                at = pa.array((block << CODE_BITS) + np.arange(len(second)))
                out = pa.RecordBatch.from_arrays([first, second, at, pa.array(_unpacked(n).astype(np.int64))], ["first", "second", "at", "n"])
                for k in range(0, out.num_rows, OUT_ROWS):
                    yield out.slice(k, OUT_ROWS)

    return relation.select("block", "lang", "first", "second", "n").mapInArrow(B.freed(read), f"first {kind}, second {kind}, at long, n long")


def _frequent(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The codes (at, id) whose group occurs `least` times, and the groups (id, first, second, f).

    One shuffle brings the codes of a group together, a row for each block that has it. The group's id
    is its least code.
    """
    group = W.partitionBy("first", "second")
    known = rows.select("first", "second", "at", F.sum("n").over(group).alias("f"), F.min("at").over(group).alias("id"))
    first = F.col("at") == F.col("id")  # the group is described once
    kept = known.where(F.col("f") >= least).select("at", "id", *[F.when(first, F.col(c)).alias(c) for c in ("first", "second", "f")])
    kept = saved(kept, "phrase-codes")
    return kept, kept.where(first).drop("at")


def _totals(relation: DataFrame) -> DataFrame:
    """(lang, n): all occurrences."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(_unpacked(n).sum(dtype=np.int64)) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], ["lang", "n"])

    return relation.select("lang", "n").mapInArrow(read, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def _described(groups: DataFrame, shorter: DataFrame) -> DataFrame:
    """Words and counts of longer phrases, from the phrases of one word less at either end."""
    left = shorter.select(F.col("id").alias("first"), "lang", "words", "heads")
    right = shorter.select(F.col("id").alias("second"), F.col("words").alias("_words"), F.col("tails"))
    return groups.join(left, "first").join(right, "second").select(
        "id",
        "first",
        "second",
        "lang",
        "f",
        F.concat("words", F.slice("_words", -1, 1)).alias("words"),
        F.concat("heads", F.array("f")).alias("heads"),
        F.concat("tails", F.array("f")).alias("tails"),
    )


def _number(c: Column, digits: int) -> Column:
    return c.cast(f"decimal({digits},0)")


def _scored(phrases: DataFrame) -> DataFrame:
    """Add l, r and score of the cut that scores lowest; the products are exact in 38 digits."""
    top = _number(F.lit(1000) * F.col("a"), 19) * _number(F.col("n"), 18)

    def cut(k: Column) -> Column:
        l, r = F.element_at("heads", k), F.element_at("tails", F.size("words") - k)
        return F.struct(
            F.call_function("div", top, _number(l, 18) * _number(r, 18)).alias("score"), k.alias("k"), l.alias("l"), r.alias("r")
        )

    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut)
    return phrases.withColumn("cut", F.array_min(cuts)).select("*", "cut.l", "cut.r", "cut.score")


def mine_phrases(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, top: int = TOP, lang: str = "lang"
) -> DataFrame:
    """The collocations of every language -> lang, rank, phrase, a, l, r, n, score.

    Words are runs without blanks, with A-Z lowered; pieces end at `.,;:!?` and line breaks. Candidates
    are phrases of 2 to `longest` words that occur `least` times within pieces. A candidate goes if a
    longer one that holds it occurs as often; since counts only fall with length, one more word decides.

    A null language is `und` (together with texts so labelled); null, empty and wordless texts add
    nothing, repeated rows count each. Equal scores go by count, then phrase, so ties have one order.
    Very long texts are cut between pieces into parts of about 2 MB. An empty table gives no rows.
    Other columns are not read.
    """
    words = saved(word_blocks(docs, lang), "phrase-words")
    kept, groups = _frequent(_by_code(words, True), least)
    totals = saved(_totals(words), "phrase-totals")
    phrases = groups.select("id", F.col("first").alias("lang"), "f", F.array("second").alias("words"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    relation, found = words, []
    for _ in range(2, longest + 1):
        longer = saved(extended(relation, kept), "phrase-relation")
        dropped(relation)
        relation, shorter = longer, kept
        kept, groups = _frequent(_by_code(relation, False), least)
        phrases = saved(_described(groups, phrases), "phrase-found")
        dropped(shorter)
        found.append(phrases)
    dropped(relation, kept)

    candidates = []
    for i, phrases in enumerate(found):
        if i + 1 < len(found):
            again = found[i + 1].select(F.col("first"), F.col("second"), "f", F.element_at("heads", -2).alias("_l"), F.element_at("tails", -2).alias("_r"))
            inside = again.where("f >= _l").select(F.col("first").alias("id")).union(again.where("f >= _r").select("second"))
            phrases = phrases.join(inside.distinct(), "id", "left_anti")
        candidates.append(phrases.select("lang", "words", F.col("f").alias("a"), "heads", "tails"))
    out = candidates[0]
    for more in candidates[1:]:
        out = out.unionByName(more)
    scored = _scored(out.join(totals, "lang")).withColumn("phrase", F.array_join("words", " "))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))  # one language may hold most phrases
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    result = saved(last.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "phrase-result")
    dropped(totals, *found)
    return result


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE p AS (
  SELECT doc_id, coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), pieces AS (
  SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p
), words AS MATERIALIZED (
  SELECT pid, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM pieces WHERE len(ws) > 0
), total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f1 AS MATERIALIZED (SELECT lang, w AS phrase, 1 AS size, count(*) AS f FROM words GROUP BY ALL HAVING count(*) >= {LEAST_COUNT}),
r1 AS MATERIALIZED (SELECT pid, words.lang, pos, w AS phrase, w AS word FROM words JOIN f1 ON f1.lang = words.lang AND f1.phrase = words.w),
{"".join(f'''
c{k} AS (SELECT a.pid, a.lang, a.pos, a.phrase || ' ' || b.word AS phrase FROM r{k - 1} a JOIN r1 b ON b.pid = a.pid AND b.pos = a.pos + {k - 1}),
f{k} AS MATERIALIZED (SELECT lang, phrase, {k} AS size, count(*) AS f FROM c{k} GROUP BY ALL HAVING count(*) >= {LEAST_COUNT}),
r{k} AS MATERIALIZED (SELECT c{k}.* FROM c{k} SEMI JOIN f{k} USING (lang, phrase)),''' for k in range(2, LONGEST + 1))}
f AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(1, LONGEST + 1))}),
inner_ AS (
  SELECT DISTINCT s.lang, s.phrase FROM f s JOIN f g ON g.lang = s.lang AND g.f >= s.f AND g.size > s.size
    AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') WHERE s.size > 1
), cuts AS (
  SELECT f.lang, f.phrase, f.f AS a, k, h.f AS l, t.f AS r, total.n,
    ((1000::HUGEINT * f.f * total.n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM f JOIN total ON total.lang = f.lang JOIN range(1, {LONGEST}) AS x(k) ON f.size > k
  JOIN f h ON h.lang = f.lang AND h.phrase = array_to_string(string_split(f.phrase, ' ')[1:k], ' ')
  JOIN f t ON t.lang = f.lang AND t.phrase = array_to_string(string_split(f.phrase, ' ')[k + 1:], ' ')
), best AS (
  SELECT * FROM cuts ANTI JOIN inner_ USING (lang, phrase)
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= {TOP}
"""
