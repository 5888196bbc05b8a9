"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunedata.llm import bytes_ as B
from tunedata.llm.tables import dropped, fresh, held_out, saved, table, text_of

FOLDS = 5
# the labelled sample: at most so many rows a language, whole texts of any length
ROWS_PER_LANGUAGE = 500
SALTS = 64
BUCKETS, WIDTH, EPOCHS, BATCH, RATE = 1 << 15, 16, 20, 32, 0.5
GRAMS = (2, 3, 4)
CALIBRATION_SHARE = 0.2
# share of well-labelled calibration texts that may fall under the rejection threshold
MOST_REJECTED = 0.001
UNKNOWN = "und"
# anything ASCII but letters separates words; bytes beyond ASCII belong to words
NO_LETTER = B.class_table(bytes(c for c in range(128) if not chr(c).isalpha()))


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every byte n-gram of `<word>`."""
    blob = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(words)), size)
    left = ends - np.arange(blob.size)
    owners, buckets = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        code = np.full(at.size, n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | blob[at + k]
        owners.append(owner[at])
        buckets.append((B.mix(code) % np.uint64(BUCKETS)).astype(np.int32))
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class Model:
    """`weights`: per bucket the embedding already multiplied with the softmax layer; exact, as both are linear."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, rows: list[bytes]) -> np.ndarray:
        """Per text and language: mean over all subwords of the text, read in slices of bounded size."""
        k = len(self.languages)
        total, count = np.zeros((len(rows), k)), np.zeros(len(rows))
        for owners, pieces in B.slices(rows):
            words = B.Words(pieces, breaks=NO_LETTER, lower=True)
            if not len(words):
                continue
            codes, example = words.distinct()
            owner, bucket = subwords(words.text(example))
            np.add.at(count, owners, words.per_piece(np.bincount(owner, minlength=example.size)[codes]))
            for c in range(k):
                each = np.bincount(owner, self.weights[bucket, c], example.size)
                np.add.at(total[:, c], owners, words.per_piece(each[codes]))
        return (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature

    def predict(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(language number, calibrated probability)."""
        p = softmax(self.logits(rows))
        best = p.argmax(1)
        return best, p[np.arange(len(rows)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def features_of(rows: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the buckets its subwords fall in, and the share of each; texts are read in slices."""
    found = []
    for text in rows:
        total = np.zeros(BUCKETS, np.int64)
        for _, pieces in B.slices([text]):
            words = B.Words(pieces, breaks=NO_LETTER, lower=True)
            if len(words):
                codes, example = words.distinct()
                owner, bucket = subwords(words.text(example))
                total += np.bincount(bucket, np.bincount(codes)[owner], BUCKETS).astype(np.int64)
        held = np.flatnonzero(total)
        found.append((held.astype(np.int32), (total[held] / max(1, total.sum())).astype(np.float32)))
    return found


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> Model:
    """SGD over the sample, then a temperature and a rejection threshold from rows it has not seen."""
    languages = sorted(set(labels))
    k, rng = len(languages), np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels], np.int64)
    order = rng.permutation(len(features))
    aside = order[: int(len(features) * CALIBRATION_SHARE)]
    embed = rng.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32)
    fit = order[len(aside) :]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        mixed = rng.permutation(fit)
        for at in range(0, len(mixed), BATCH):
            batch = mixed[at : at + BATCH]
            hidden = np.stack([w @ embed[f] for f, w in (features[i] for i in batch)])
            slope = softmax(hidden @ layer + bias)
            slope[np.arange(len(batch)), y[batch]] -= 1
            back = slope @ layer.T
            layer -= rate * 4 / len(batch) * hidden.T @ slope
            bias -= rate / len(batch) * slope.sum(0)
            for i, g in zip(batch, back, strict=True):
                f, w = features[i]
                embed[f] -= rate * 8 * w[:, None] * g
    model = Model(languages, embed @ layer, bias)
    if len(aside):
        raw = np.stack([w @ model.weights[f] for f, w in (features[i] for i in aside)]) + bias
        truth = y[aside]
        scale = np.geomspace(0.05, 20, 121)
        loss = [-np.log(softmax(raw / t)[np.arange(len(aside)), truth] + 1e-12).mean() for t in scale]
        model.temperature = float(scale[int(np.argmin(loss))])
        p = softmax(raw / model.temperature)
        right = p.argmax(1) == truth
        sure = p.max(1)[right] if right.any() else np.zeros(1)
        model.threshold = float(min(0.5, np.quantile(sure, MOST_REJECTED)))
    return model


def fitted(docs: DataFrame, folds: int = FOLDS) -> Model:
    """A model of the languages in `docs`, from a bounded sample of labelled texts outside the held-out fold.

    Per language the rows with the least hash are taken, up to `ROWS_PER_LANGUAGE`, whatever their
    length; ties are equal rows. Rows are picked by hash alone, in two steps, so a language with most
    rows is not ranked in one task, and only bucket counts of the picked texts, made from whole texts on
    the executors, reach the driver, packed: at most `BUCKETS` numbers for each. Without labelled texts the model
    knows no language.
    """
    key = F.xxhash64("doc_id", "text")
    usable = docs.where(~held_out(F.col("doc_id"), folds) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = usable.select("lang", key.alias("_h"))
    for part in (["lang", F.pmod("_h", F.lit(SALTS))], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*part).orderBy("_h"))
        hashed = hashed.withColumn("_n", place).where(F.col("_n") <= ROWS_PER_LANGUAGE).drop("_n")
    picked = saved(hashed.distinct(), "language-sample")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.batches_in_parts(batches, "text"):
            found = features_of(B.texts(batch.column(2)))
            buckets = pa.array([f.tobytes() for f, _ in found], pa.binary())
            shares = pa.array([w.tobytes() for _, w in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), buckets, shares], ["lang", "h", "buckets", "shares"])

    texts = usable.select("lang", key.alias("_h"), "text").join(picked, ["lang", "_h"], "left_semi").dropDuplicates(["lang", "_h"])
    counted = texts.select("lang", "_h", "text").mapInArrow(B.freed(read), "lang string, h long, buckets binary, shares binary")
    sample = counted.toArrow()
    dropped(picked)
    langs, hashes, buckets, shares = (c.to_pylist() for c in sample.columns)
    order = sorted(range(len(langs)), key=lambda i: (langs[i], hashes[i]))
    features = [(np.frombuffer(buckets[i], np.int32), np.frombuffer(shares[i], np.float32)) for i in order]
    model = train(features, [langs[i] for i in order])
    del sample, buckets, shares, features
    B.free()
    return model


def identify(docs: DataFrame, model: Model, names: Sequence[str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """`docs` with lang_pred, score (0 to 1) and rejected (or other `names`), from the whole text and nothing else.

    A text that is null, or has no letter, or meets a model without languages is `und` with score 0
    and rejected. Others get the likeliest language and its calibrated probability, and are rejected
    under the model's threshold; of equally likely languages the first by name is taken. Repeated rows get
    equal results, an empty table an empty one. Columns of these names are replaced; all others pass unchanged.
    """
    label, score_name, rejected = names
    legible_name, found_name = fresh(docs, "legible", "found")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def predicted(column: pa.Array) -> pa.Array:
        best, score = shared.value.predict(B.texts(column))
        names = pa.array(np.array(shared.value.languages, dtype=object)[best], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(score)], ["lang", "score"])

    predict = F.arrow_udf(B.in_parts(predicted), "lang string, score double")

    if not model.languages:
        return docs.withColumns({label: F.lit(UNKNOWN), score_name: F.lit(0.0), rejected: F.lit(True)})
    legible = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    step = docs.withColumns({legible_name: legible, found_name: predict(text_of(docs))})
    read, found = F.col(legible_name), F.col(found_name)
    return step.withColumns(
        {
            label: F.when(read, found["lang"]).otherwise(UNKNOWN),
            score_name: F.when(read, found["score"]).otherwise(0.0),
            rejected: ~read | (found["score"] < model.threshold),
        }
    ).drop(legible_name, found_name)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fitted(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "lang_pred", "score", "rejected")
