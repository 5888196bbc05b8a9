"""Token counts: whole texts through a public tokenizer, lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm import bytes_ as B
from tunedata.llm.tables import table, text_of

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
ENCODE_ROWS = 2048


@lru_cache(maxsize=2)
def _encoder(path: str):
    """One tokenizer per worker process, loaded on first use."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda found: [len(ids) for ids in model.encode(found, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; Spark runs the tasks side by side
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def lengths(found: list[str]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(found), ENCODE_ROWS):  # encodings are large; few live at a time
            out += [len(e.ids) for e in tokenizer.encode_batch_fast(found[i : i + ENCODE_ROWS], add_special_tokens=False)]
        return out

    return lengths


def _resolved(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, splits_at_space: bool = True) -> DataFrame:
    """`docs` with `n_bytes` (UTF-8) and `n_tokens` of `text`.

    Tokens are those of `tokenizer` without added special tokens; special strings inside a text count
    as the library takes them. A null or empty text has no tokens. Other columns pass unchanged and
    never reach Python. Repeated rows are counted each.

    Texts are encoded in groups of about `bytes_.SLICE_BYTES`, so a batch costs the same whatever the
    lengths in it. With `splits_at_space` (true for a tokenizer that drops white space and never joins
    across it) long texts are cut at white space, and every distinct word of a group is encoded once.
    Otherwise each text is encoded whole.
    """

    def lengths(column: pa.Array) -> pa.Array:
        encode, rows = _encoder(_resolved(tokenizer)), B.texts(column)
        total = np.zeros(len(rows), np.int64)
        if not splits_at_space:
            for i, text in enumerate(rows):
                total[i] = encode([text.decode("utf-8", "replace")])[0]
            return pa.array(total)
        for owners, pieces in B.slices(rows):
            words = B.Words(pieces)
            if len(words):
                codes, example = words.distinct()
                found = [w.decode("utf-8", "replace") for w in words.text(example)]
                size = np.array(encode(found), np.int64)
                np.add.at(total, owners, words.per_piece(size[codes]).astype(np.int64))
        return pa.array(total)

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield lengths(column)

    return docs.withColumns({"n_bytes": F.octet_length(text_of(docs)).cast("long"), "n_tokens": counted(text_of(docs))})


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    )
