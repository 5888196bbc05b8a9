"""BPE encoding and decoding of whole texts, with content-defined chunks encoded once and reused.

A rolling hash over the bytes cuts every text into chunks, so equal passages give equal chunks wherever
they stand. The chunks that save most are counted over the whole table and encoded once for all tasks;
each task encodes every other chunk once. A cut may fall inside a word, so the segment that a cut runs
through is encoded anew with its neighbours, in ever wider windows until the ids on both sides agree.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm import bytes_ as B
from tunedata.llm.tables import fresh, table, text_of

TOKENIZER = "word_bpe_49k.json"
ROLLING_BYTES = 24  # the window of the rolling hash
CHUNK_BITS = 10  # a cut every 1,024 bytes on average
GROUP_BYTES = B.SLICE_BYTES
ENCODE_ROWS = 1024
MARKED = 256
# What a task remembers; beyond these it forgets all and starts anew.
CACHE_BYTES = 8 << 20
CACHE_WORDS = 1 << 20
# The table of chunks that all tasks share has at most 4,096 chunks of at most 4 KB each.
SHARED_CHUNKS = 4096
SHARED_BYTES = 4096
NONE = np.zeros(0, np.uint32)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; Spark runs the tasks side by side
    from tokenizers import Tokenizer

    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _encode(tokenizer, texts: list[bytes]) -> list[np.ndarray]:
    """The ids of every text, encoded as it stands."""
    out: list[np.ndarray] = []
    for i in range(0, len(texts), ENCODE_ROWS):  # encodings are large; few live at a time
        found = [t.decode("utf-8", "replace") for t in texts[i : i + ENCODE_ROWS]]
        out += [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(found, add_special_tokens=False)]
    return out


# --- chunks --------------------------------------------------------------------------------


def segment_cut(text: bytes, limit: int) -> Iterator[bytes]:
    """Parts of about `limit` bytes that start where white space starts; only a longer segment makes a longer part."""
    data = np.frombuffer(text, np.uint8)
    at = 0
    while len(text) - at > limit:
        end, size = 0, limit
        while not end and at + size < len(text):
            space = B.IS_SPACE[data[at : at + size]]
            starts = np.flatnonzero(space[1:] & ~space[:-1])
            end, size = (at + 1 + int(starts[-1]) if starts.size else 0), 2 * size
        if not end:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def rolling_cuts(data: np.ndarray, bits: int = CHUNK_BITS, width: int = ROLLING_BYTES) -> np.ndarray:
    """Places where the hash of the last `width` bytes ends in `bits` zeros, moved to the next character."""
    if data.size <= width:
        return np.zeros(0, np.int64)
    hit = (B.window_hashes(data, width) & np.uint64((1 << bits) - 1)) == 0
    hit[1:] &= ~hit[:-1]  # a run of equal bytes has one hash throughout: it is cut once
    cuts = np.flatnonzero(hit) + width
    cuts = cuts[cuts < data.size]
    for _ in range(3):
        cuts = cuts + ((cuts < data.size) & ((data[np.minimum(cuts, data.size - 1)] & 0xC0) == 0x80))
    return cuts[cuts < data.size]


def _places(size: int, *sets: np.ndarray) -> np.ndarray:
    """All places of some sets in order, once each."""
    mark = np.zeros(size + 1, bool)
    for places in sets:
        mark[places] = True
    return np.flatnonzero(mark)


class Chunks:
    """The chunks of some pieces of text: their whole segments (`body`) and the segments between them.

    A segment is white space and the word behind it. A body goes from the first start of a segment in the
    chunk to the last. What lies between two bodies
    of a piece is nothing, where the cut fell on the start of a segment, or else one segment, a `joint`.
    """

    def __init__(self, pieces: list[bytes], bits: int = CHUNK_BITS):
        self.blob = b"".join(pieces)
        data = np.frombuffer(self.blob, np.uint8)
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        space = B.IS_SPACE[data]
        starts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        self.edges = np.concatenate([[0], ends])
        self.splits = _places(data.size, starts, self.edges)
        cuts = _places(data.size, rolling_cuts(data, bits), self.edges)
        first = self.splits[np.searchsorted(self.splits, cuts[:-1])]
        last = self.splits[np.searchsorted(self.splits, cuts[1:], "right") - 1]
        whole = first < last
        self.first, self.last = first[whole].tolist(), last[whole].tolist()
        self.piece = (np.searchsorted(self.edges, first[whole], "right") - 1).tolist()

    def bodies(self) -> list[bytes]:
        return [self.blob[a:b] for a, b in zip(self.first, self.last, strict=True)]

    def around(self, a: int, b: int, piece: int, width: int) -> tuple[int, int]:
        """The span that has `width` more segments on either side of [a, b), inside the piece."""
        i, j = np.searchsorted(self.splits, [a, b])
        low = max(int(self.splits[max(0, i - width)]), int(self.edges[piece]))
        high = min(int(self.splits[min(self.splits.size - 1, j + width)]), int(self.edges[piece + 1]))
        return low, high


# --- encoding ------------------------------------------------------------------------------


def _marked(tokenizer, mark: int | None, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, how many each has), of a tokenizer that drops white space.

    Texts are encoded many at a time, between marks that are one token and touch no other.
    """
    ids, sizes = [], np.zeros(len(texts), np.int64)
    for i in range(0, len(texts), MARKED):
        part = texts[i : i + MARKED]
        found = _encode(tokenizer, [b" \x01 ".join([b"", *part, b""])])[0] if mark is not None else NONE
        at = np.flatnonzero(found == mark) if mark is not None else NONE
        if at.size == len(part) + 1:
            ids.append(found[found != mark])
            sizes[i : i + len(part)] = np.diff(at) - 1
        else:  # a text holds the mark itself, or there is none
            each = _encode(tokenizer, part)
            ids += each
            sizes[i : i + len(part)] = [x.size for x in each]
    return np.concatenate(ids) if ids else NONE, sizes


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of `flat`, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if ends.size else 0)]


class WordIds:
    """The ids of the words met so far, by the words' 64-bit hashes in order."""

    def __init__(self, tokenizer, mark: int | None):
        self.tokenizer, self.mark = tokenizer, mark
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.start, self.size = NONE, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return self.hashes.size

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts, word by word; words not met before are encoded."""
        words = B.Words(texts)
        if not len(words):
            return [NONE] * len(texts)
        codes, found = pd.factorize(words.hashes())
        place = np.searchsorted(self.hashes, found)
        known = np.zeros(found.size, bool)
        known[place < len(self)] = self.hashes[place[place < len(self)]] == found[place < len(self)]
        number = np.empty(found.size, np.int64)
        number[known] = self.at[place[known]]
        new = np.flatnonzero(~known)
        if new.size:
            example = np.empty(found.size, np.int64)
            example[codes] = np.arange(codes.size)
            ids, size = _marked(self.tokenizer, self.mark, words.text(example[new]))
            number[new] = np.arange(self.size.size, self.size.size + new.size)
            self.start = np.append(self.start, self.flat.size + np.cumsum(size) - size)
            self.size, self.flat = np.append(self.size, size), np.append(self.flat, ids)
            self.hashes, self.at = np.append(self.hashes, found[new]), np.append(self.at, number[new])
            order = np.argsort(self.hashes, kind="stable")
            self.hashes, self.at = self.hashes[order], self.at[order]
        at = number[codes]
        ids = _gathered(self.flat, self.start[at], self.size[at])
        edges = np.append(0, np.cumsum(self.size[at]))[words.first].tolist()
        return [ids[a:b].copy() for a, b in zip(edges, edges[1:], strict=False)]


class Encoder:
    """Encodes groups of texts, remembering chunks and words from one group to the next.

    `apart` says that the tokenizer drops white space and so never joins across it: then the distinct
    words of new chunks are encoded, once each. Otherwise chunks are encoded whole.
    """

    def __init__(self, path: str, shared: dict[bytes, bytes], apart: bool = True):
        self.tokenizer, self.shared, self.apart = _tokenizer(path), shared, apart
        mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.encoded = 0  # bytes of chunks that were not known
        self._forget()

    def _forget(self) -> None:
        self.bodies: dict[bytes, np.ndarray] = {}
        self.size = 0
        self.words = WordIds(self.tokenizer, self.mark)

    def _body_ids(self, bodies: list[bytes]) -> list[np.ndarray]:
        new = [b for b in dict.fromkeys(bodies) if b not in self.bodies and b not in self.shared]
        found = self.words.of(new) if self.apart else _encode(self.tokenizer, new)
        self.bodies.update(zip(new, found, strict=True))
        self.encoded += sum(map(len, new))
        self.size += sum(len(b) + i.nbytes for b, i in zip(new, found, strict=True))
        return [self.bodies[b] if b in self.bodies else np.frombuffer(self.shared[b], np.uint32) for b in bodies]

    def _joint_ids(self, chunks: Chunks, joints: list[tuple[int, int, int]]) -> list[np.ndarray | None]:
        """Ids of the segments that cuts run through; None where no window short of the piece agrees."""
        out: list[np.ndarray | None] = [None] * len(joints)
        open_, width = list(range(len(joints))), 1
        while open_:
            spans = [(*chunks.around(*joints[i], width), *joints[i][:2]) for i in open_]
            texts = [chunks.blob[x:y] for low, high, a, b in spans for x, y in ((low, high), (low, a), (b, high))]
            self._windows(texts)
            still = []
            for k, (i, (low, high, *_)) in enumerate(zip(open_, spans, strict=True)):
                whole, left, right = (self.windows[t] for t in texts[3 * k : 3 * k + 3])
                end = whole.size - right.size
                if left.size <= end and (whole[: left.size] == left).all() and (whole[end:] == right).all():
                    out[i] = whole[left.size : end]
                elif high - low < chunks.edges[joints[i][2] + 1] - chunks.edges[joints[i][2]]:
                    still.append(i)
            open_, width = still, 2 * width
        return out

    def _windows(self, texts: list[bytes]) -> None:
        """Ids of the short texts around joints, each encoded as it stands."""
        new = list(dict.fromkeys(texts))
        if self.apart:
            ids, size = _marked(self.tokenizer, self.mark, new)
            found = np.split(ids, np.cumsum(size)[:-1])
        else:
            found = _encode(self.tokenizer, new)
        self.windows = dict(zip(new, found, strict=True))

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of every piece."""
        chunks = Chunks(pieces)
        if self.size > CACHE_BYTES or len(self.words) > CACHE_WORDS:
            self._forget()
        bodies = self._body_ids(chunks.bodies())
        at = chunks.edges[:-1].tolist()  # how far each piece is covered
        parts: list[list] = [[] for _ in pieces]
        joints: list[tuple[int, int, int]] = []
        for ids, a, b, p in zip(bodies, chunks.first, chunks.last, chunks.piece, strict=True):
            if at[p] < a:
                parts[p].append(len(joints))
                joints.append((at[p], a, p))
            parts[p].append(ids)
            at[p] = b
        for p, end in enumerate(chunks.edges[1:].tolist()):
            if at[p] < end:
                parts[p].append(len(joints))
                joints.append((at[p], end, p))
        mended = self._joint_ids(chunks, joints)
        out = []
        for p, found in enumerate(parts):
            found = [mended[x] if isinstance(x, int) else x for x in found]
            if any(x is None for x in found):  # no agreement anywhere: the whole piece is encoded as it is
                found = _encode(self.tokenizer, [pieces[p]])
            out.append(np.concatenate(found) if found else NONE)
        return out

    def texts(self, rows: list[bytes]) -> list[np.ndarray]:
        """The ids of every text."""
        found: list[list] = [[] for _ in rows]
        for owners, pieces in B.slices(rows, GROUP_BYTES, segment_cut):
            for row, ids in zip(owners, self.pieces(pieces), strict=True):
                found[row].append(ids)
        return [np.concatenate(x) if x else NONE for x in found]


# --- Spark ---------------------------------------------------------------------------------


def _body_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(64-bit hashes, bodies) of the distinct chunks of every group."""
    import xxhash

    for batch in batches:
        for _, pieces in B.slices(B.texts(batch.column(0)), GROUP_BYTES, segment_cut):
            bodies = [b for b in Chunks(pieces).bodies() if len(b) <= SHARED_BYTES]
            yield np.array([xxhash.xxh64_intdigest(b) for b in bodies], np.uint64).view(np.int64), bodies


def shared_chunks(docs: DataFrame, tokenizer: str = TOKENIZER, apart: bool = True) -> dict[bytes, bytes]:
    """chunk -> ids of the chunks whose reuse saves most bytes over all of `docs`, encoded once on the executors.

    At most `SHARED_CHUNKS` chunks of at most `SHARED_BYTES` bytes. Hashes only choose them; whoever
    looks a chunk up compares its bytes.
    """
    texts = docs.select(text_of(docs).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, bodies in _body_rows(batches):
            found, at, n = np.unique(hashes, return_index=True, return_counts=True)
            sizes = np.array([len(bodies[i]) for i in at.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sizes), pa.array(n.astype(np.int64))], ["h", "size", "n"])

    marks = texts.mapInArrow(counted, "h long, size long, n long").groupBy("h").agg(F.max("size").alias("size"), F.sum("n").alias("n"))
    best = marks.where("n > 1").orderBy(F.col("size") * (F.col("n") - 1), "h", ascending=False).limit(SHARED_CHUNKS)
    chosen = np.array(sorted(r.h for r in best.select("h").collect()), np.int64)
    if not chosen.size:
        return {}
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(chosen)

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = wanted.value
        for hashes, bodies in _body_rows(batches):
            at = np.flatnonzero(np.isin(hashes, left))  # a task hands over each chunk once
            held, one = np.unique(hashes[at], return_index=True)
            left = np.setdiff1d(left, held)
            found = [bodies[i] for i in at[one].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found, pa.binary())], ["h", "body"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, {}, apart)
        for batch in batches:
            ids = [x.tobytes() for x in encoder._body_ids(B.texts(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["body", "ids"])

    bodies = texts.mapInArrow(fetched, "h long, body binary").groupBy("h").agg(F.min("body").alias("body"))
    rows = bodies.select("body").mapInArrow(encoded, "body binary, ids binary").collect()
    wanted.destroy()
    return {bytes(r.body): bytes(r.ids) for r in rows}


def encode(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    apart: bool = True,
    ids: str = "token_ids",
    decoded: str | None = None,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """`docs` with `ids`: the token ids of `text` as little-endian unsigned 32-bit numbers, one after another.

    The ids are those of the library for the whole text, without added special tokens; special strings
    inside a text count as the library takes them. `tokenizer` is a word-end BPE, which drops white space,
    or with `apart=False` a byte-level BPE, which cuts before it; no added token may hold white space.
    `decoded` names a column for what the library decodes from the ids, made in the same pass. Null
    and empty texts have no ids. Repeated rows and ties need no rule: every row is encoded by its text
    alone. An empty table gives an empty table. A very long text is encoded in parts of about
    `GROUP_BYTES` that start where white space starts. Columns of these names are replaced, those of
    `drop` left out; all others pass unchanged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, tokenizer, apart))
    kept = [c for c in docs.columns if c not in (ids, decoded, *drop)]
    schema = docs.select(*kept).schema.add(ids, "binary")
    if decoded:
        schema = schema.add(decoded, "string")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, shared.value, apart)
        for batch in batches:
            for rows in _row_groups(batch.column(batch.num_columns - 1)):  # what leaves at a time is as small as a group
                part = batch.slice(rows.start, len(rows))
                found = encoder.texts(B.texts(part.column(part.num_columns - 1)))
                made = [pa.array([x.tobytes() for x in found], pa.binary())]
                if decoded:
                    made.append(pa.array([_decoded(encoder.tokenizer, x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], schema.fieldNames())
                del found, made
            pa.default_memory_pool().release_unused()

    (text,) = fresh(docs, "text_to_encode")
    return docs.select(*[docs[c] for c in kept], text_of(docs).alias(text)).mapInArrow(coded, schema)


def _row_groups(column: pa.Array) -> Iterator[range]:
    """Rows whose texts have about `GROUP_BYTES` together."""
    ends = np.cumsum(pc.binary_length(column).to_numpy())
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_BYTES, "right")))
        yield range(at, to)
        at = to


def _decoded(tokenizer, ids: np.ndarray) -> str:
    return tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def decode(df: DataFrame, tokenizer: str = TOKENIZER, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """`df` with `text`: what the library decodes from `ids`, special tokens included. Null is no ids."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _tokenizer(tokenizer)
        for column in batches:
            yield pa.array([_decoded(known, np.frombuffer(x, "<u4")) for x in B.texts(column)], pa.string())

    return df.withColumn(text, decoded(F.col(ids)))


def op13_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids, text = fresh(docs, "token_ids", "decoded")
    coded = encode(docs, ids=ids, decoded=text, drop=("text",))
    return coded.select(
        "doc_id",
        F.expr(f"cast(octet_length({ids}) div 4 as long)").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col(text).cast("binary"), 256).alias("decoded_sha256"),
    )
