"""Quality rules: word counts per text, and a log-likelihood ratio of hashed n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.tables import saved, table, text_of, words_of

BUCKETS = 1 << 14
# mean nats per n-gram by which a text may be likelier under the raw corpus than under the target
LEAST_RATIO = -0.06
LEAST_WORDS, REPEAT_PERCENT = 50, 50


def _neighbours(windows: Column) -> tuple[Column, Column]:
    """Positions of 3-word windows (given by hash, in order) sorted so that equal ones meet, and their hashes.

    Windows are sorted as one packed number, hash above and position below, so that equal windows
    are neighbours; the whole 64-bit hashes decide.
    """
    mask = F.when(F.size(windows) < (1 << 24), F.lit((1 << 24) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("long")
    packed = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

    def place(p: Column) -> Column:
        return p.bitwiseAND(mask).cast("int")

    order = F.transform(packed, lambda p: place(p))
    own = F.transform(order, lambda i: F.get(windows, i))
    return order, own


def _same_as_near(own: Column, h: Column, j: Column) -> Column:
    return (
        F.coalesce(F.get(own, j - 1) == h, F.lit(False))
        | F.coalesce(F.get(own, j + 1) == h, F.lit(False))
        | F.coalesce(F.get(own, j - 2) == h, F.lit(False))
        | F.coalesce(F.get(own, j + 2) == h, F.lit(False))
    )


def word_counts(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and two helper
    columns, `_h` (hash of every word) and `_n` (n_words).

    Null and empty texts have no words and zero counts. All work stays inside one row, in arrays of
    the words of one text.
    """
    text = text_of(docs)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]", "")) > 0)
    step = docs.withColumn("_w", words_of(text)).withColumn("_lines", lines)
    step = step.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.transform("_w", lambda w: F.xxhash64(w)),
        }
    ).drop("_w", "_lines")
    h = F.col("_h")
    windows = F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)),
    )
    step = step.withColumn("_t", windows)
    many = F.size(F.array_distinct("_t")) < F.size("_t")
    order, own = _neighbours(F.col("_t"))
    step = step.withColumn("_t", F.when(many, F.col("_t"))).withColumn("_o", order).withColumn("_own", own)
    twice = F.filter(
        F.transform("_o", lambda i, j: F.when(_same_as_near(F.col("_own"), F.get("_own", j), j), i)),
        lambda i: i.isNotNull(),
    )
    step = step.withColumn("_p", F.sort_array(twice))
    covered = F.aggregate(
        F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_t", "_o", "_own", "_p")


def _features(h: Column, buckets: int) -> Column:
    """Bucket of every word and of every pair of neighbours, from the words' hashes."""
    pairs = F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))),
        lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(buckets)).cast("int"),
    )
    return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int")), pairs)


def _word_hashes(docs: DataFrame) -> Column:
    return F.transform(words_of(text_of(docs)), lambda w: F.xxhash64(w))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ratio) for every bucket: log of its smoothed share in the trusted target (documents
    labelled quality 1) over its share in all documents.

    Counts are combined in each task, so the shuffle carries at most `buckets` rows a task. A
    document labelled twice is trusted if any label says so. Without trusted documents every ratio is 0.
    """
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    # both sides are shuffled by id at every size: the labels grow with the documents
    flagged = docs.select("doc_id", "text").join(trusted.withColumn("_good", F.lit(1)).hint("merge"), "doc_id", "left")
    counted = saved(
        flagged.withColumn("_h", _word_hashes(flagged))
        .select("_good", F.explode(_features(F.col("_h"), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("_good").alias("good")),
        "quality-counts",
    )
    every = docs.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    totals = counted.agg(F.sum("raw").alias("_raw"), F.sum("good").alias("_good"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    dense = every.join(counted, "bucket", "left").join(F.broadcast(totals))  # totals: one row
    return dense.select(
        "bucket",
        F.when(zero("_good") == 0, F.lit(0.0))
        .otherwise(
            F.log((zero("good") + 1.0) / (zero("_good") + float(buckets)))
            - F.log((zero("raw") + 1.0) / (zero("_raw") + float(buckets)))
        )
        .alias("ratio"),
    )


def quality_rules(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, least_ratio: float = LEAST_RATIO
) -> DataFrame:
    """One row per document with its counts, `ratio` (mean log ratio per n-gram) and verdicts.

    Words and word pairs are hashed into `buckets`; a text's ratio is the mean over its n-grams, so
    length does not matter. kept: neither rule fails and the ratio reaches `least_ratio`. A text
    without words has ratio 0 and fails the rules. The table of ratios has exactly `buckets` numbers
    and reaches the tasks as one scalar.
    """
    ratios = log_ratios(docs, labels, buckets).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x.ratio).alias("r")
    )
    counts = word_counts(docs.select("doc_id", "text")).drop("text")
    scored = counts.withColumn("_f", _features(F.col("_h"), buckets)).withColumn("_r", ratios.scalar())
    total = F.aggregate(
        F.transform("_f", lambda b: F.get("_r", b)), F.lit(0.0), lambda a, x: a + x
    )
    scored = scored.withColumn("ratio", F.when(F.size("_f") > 0, total / F.size("_f")).otherwise(0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT
    )
    return scored.withColumn("base_failed", failed).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("ratio") >= least_ratio)).alias("kept"),
        "ratio",
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
