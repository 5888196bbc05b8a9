"""Personal data: base patterns seed a bootstrapped search for identifiers in the same contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.tables import dropped, saved, table, text_of

KINDS = ("email", "ip", "card", "phone")
# Same matches as the plain patterns, written so that a long run of one class is walked once: a match
# starts where a run starts or where the last match ended, and repetitions give nothing back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
# a white-space token with a digit or an at sign, less leading quotes and brackets and trailing punctuation
LOOSE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
LOOSE_KIND = {
    "email": r"^[^@]{1,64}@[^@]{2,255}$",
    "ip": r"^[0-9]{1,3}(?:[.,:_-][0-9]{1,3}){3}$",
    "card": r"^[0-9](?:-?[0-9]){11,18}$",
    "phone": r"^[0-9(][0-9().-]{7,20}[0-9]$",
}
CONTEXT_CHARS = 60
ROUNDS, LEAST_SUPPORT, LEAST_CONFIDENCE = 3, 4, 0.8
CHUNK = 256
SPAN = "array<struct<start:int,kind:int,end:int>>"


def running_sums(lengths: Column) -> Column:
    """Sums of all earlier elements, one per element; folded in chunks so that long arrays stay cheap."""

    def fold(part: Column) -> Column:
        grown = F.aggregate(
            part, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array((F.element_at(a, -1) + x).cast("int")))
        )
        return F.slice(grown, F.lit(1), F.size(part))

    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: (a + x).cast("int"))
    chunks = F.transform(
        F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int"))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda c: F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)),
    )
    offsets = fold(F.transform(chunks, total))
    return F.flatten(
        F.zip_with(chunks, offsets, lambda part, at: F.transform(fold(part), lambda x: (x + at).cast("int")))
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Digits of any length; the check digit rule of payment cards."""
    values = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 1, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v))
    return F.aggregate(doubled, F.lit(0), lambda a, x: (a + x).cast("int")) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        short = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x.value)


def _span(rank: int) -> Callable[[Column], Column]:
    def made(x: Column) -> Column:
        end = (x.start + F.char_length(x.value)).cast("int")
        return F.struct(x.start, F.lit(rank).alias("kind"), end.alias("end"), x.value, x.left, x.right)

    return made


def _occurrences(step: DataFrame, text: Column, name: str, pattern: str, when: Column) -> DataFrame:
    """Adds `name`: array of (start, value, left, right), one per match; left and right are the words
    beside it, cut from the text between this match and its neighbours."""
    none = F.array().cast("array<string>")
    step = step.withColumns(
        {
            "_v": F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            "_p": F.when(when, F.split(text, pattern)).otherwise(none),
        }
    )
    step = step.withColumn(
        "_len", F.zip_with(F.slice(F.col("_p"), F.lit(1), F.size("_v")), "_v", lambda p, v: F.char_length(p) + F.char_length(v))
    ).withColumn("_at", F.when(F.size("_v") > 0, running_sums(F.col("_len"))).otherwise(F.array().cast("array<int>")))
    word = r"[^\x20\x09-\x0D]+"
    # zipped, not looked up by place: an expression inside a lambda may be computed once per element
    beside = F.arrays_zip(
        F.col("_v").alias("value"),
        F.col("_at").alias("at"),
        F.slice(F.col("_p"), F.lit(1), F.size("_v")).alias("before"),
        F.slice(F.col("_p"), F.lit(2), F.size("_v")).alias("after"),
    )
    row = lambda x: F.struct(
        (x["at"] + F.char_length(x["before"])).cast("int").alias("start"),
        x["value"].alias("value"),
        F.lower(F.regexp_extract(F.right(x["before"], F.lit(CONTEXT_CHARS)), rf"({word})[\x20\x09-\x0D]*$", 1)).alias("left"),
        F.lower(F.regexp_extract(F.left(x["after"], F.lit(CONTEXT_CHARS)), rf"^[\x20\x09-\x0D]*({word})", 1)).alias("right"),
    )
    return step.withColumn(name, F.transform(beside, row)).drop("_v", "_p", "_len", "_at")


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, seeds, loose) per row: base matches with their contexts, and the tokens of a
    looser shape that overlap none of them. Texts without digits and at signs are not searched."""
    text = F.col("_text")
    step = docs.select("doc_id", text_of(docs).alias("_text")).withColumn("key", F.xxhash64("_text"))
    step = step.withColumns({"_digit": text.rlike("[0-9]"), "_mail": F.contains(text, F.lit("@"))})
    for rank, kind in enumerate(KINDS):
        when = F.col("_mail") if kind == "email" else F.col("_digit")
        if NEEDS[kind] and kind != "email":
            when = when & F.contains(text, F.lit(NEEDS[kind]))
        step = _occurrences(step, text, f"_{kind}", BASE[kind], when)
        step = step.withColumn(f"_{kind}", F.filter(f"_{kind}", _passes(kind)))
        step = step.withColumn(f"_{kind}", F.transform(f"_{kind}", _span(rank)))
    step = step.withColumn("seeds", F.sort_array(F.concat(*[F.col(f"_{k}") for k in KINDS])))
    step = _occurrences(step, text, "_loose", LOOSE, F.col("_digit") | F.col("_mail")).drop("_text")
    # quotes and brackets around a token are not part of it
    trimmed = F.transform(
        "_loose",
        lambda x: F.struct(
            (x.start + F.char_length(F.regexp_extract(x.value, r"^[\"'<(\[{]*", 0))).cast("int").alias("start"),
            F.regexp_replace(x.value, r"^[\"'<(\[{]+|[\"'>)\]},;:.!?]+$", "").alias("value"),
            x.left,
            x.right,
        ),
    )

    def shaped(x: Column) -> Column:
        found = F.coalesce(*[F.when(x.value.rlike(LOOSE_KIND[k]), F.lit(r)) for r, k in enumerate(KINDS)])
        return F.struct(
            x.start, found.alias("kind"), (x.start + F.char_length(x.value)).cast("int").alias("end"), x.value, x.left, x.right
        )

    step = step.withColumn("_loose", F.filter(F.transform(trimmed, shaped), lambda x: x.kind.isNotNull()))
    # neighbours in order of start tell which tokens touch a base span
    marked = F.sort_array(
        F.concat(
            F.transform("seeds", lambda x: F.struct(x.start, F.lit(0).alias("new"), x.end, x.kind, x.value, x.left, x.right)),
            F.transform("_loose", lambda x: F.struct(x.start, F.lit(1).alias("new"), x.end, x.kind, x.value, x.left, x.right)),
        )
    )
    step = step.withColumn("_all", F.when(F.size("_loose") > 0, marked))

    def touches(x: Column, i: Column) -> Column:
        hit = F.lit(False)
        for d in range(1, len(KINDS) + 1):
            before, after = F.get("_all", i - d), F.get("_all", i + d)
            hit = hit | F.coalesce((before.new == 0) & (before.end > x.start), F.lit(False))
            hit = hit | F.coalesce((after.new == 0) & (after.start < x.end), F.lit(False))
        return hit

    free = F.filter("_all", lambda x, i: (x.new == 1) & ~touches(x, i))
    plain = F.transform(free, lambda x: F.struct(x.start, x.kind, x.end, x.value, x.left, x.right))
    return step.select("doc_id", "key", "seeds", F.coalesce(plain, F.filter("_loose", lambda x: F.lit(False))).alias("loose"))


def bootstrap(found: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """(kind, left, right, value) accepted beyond the base: graph scores over patterns and instances.

    A pattern is a kind with the words to its left and right; an instance is a value. Base values
    start at 1, all others at 0. Each round a pattern's confidence is the sum of its instances' scores
    over their number plus one, and an instance's score is one less the product of its patterns'
    doubts. Patterns under `support` accepted instances have no confidence. Both steps are aggregations
    of distinct edges, combined in each task; a very common value or pattern meets one row of the other side.
    """
    def edges_of(column: str, seed: int) -> DataFrame:
        return found.select(F.explode(column).alias("x")).select(
            "x.kind", "x.left", "x.right", "x.value", F.lit(seed).alias("seed")
        )

    pattern, instance = ["kind", "left", "right"], ["kind", "value"]
    edges = saved(
        edges_of("seeds", 1).unionByName(edges_of("loose", 0)).groupBy(*pattern, "value").agg(F.max("seed").alias("seed")),
        "pii-edges",
    )
    known = edges.groupBy(*instance).agg(F.max("seed").cast("double").alias("score"))
    made = [edges]
    for _ in range(rounds):
        patterns = (
            edges.join(known, instance)
            .groupBy(*pattern)
            .agg(
                (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("conf"),
                F.sum((F.col("score") >= confidence).cast("int")).alias("support"),
            )
            .where(F.col("support") >= support)
        )
        patterns = saved(patterns, "pii-patterns")
        doubt = F.sum(F.log(1 - F.least(F.coalesce("conf", F.lit(0.0)), F.lit(0.999999))))
        known = saved(
            edges.join(patterns, pattern, "left")
            .groupBy(*instance)
            .agg(F.when(F.max("seed") == 1, 1.0).otherwise(1 - F.exp(doubt)).alias("score")),
            "pii-instances",
        )
        made += [patterns, known]
    strong = patterns.where(F.col("conf") >= confidence).select(*pattern)
    accepted = saved(
        edges.where("seed = 0")
        .join(strong, pattern)
        .join(known.where(F.col("score") >= confidence).select(*instance), instance)
        .select(*pattern, "value"),
        "pii-accepted",
    )
    dropped(*made)
    return accepted


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", name(x.kind), x.start.cast("string"), x.end.cast("string"))), ","
    )


def personal_data(
    docs: DataFrame, rounds: int = ROUNDS, support: int = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE
) -> DataFrame:
    """(doc_id, base, added) per row: arrays of (start, kind, end) by code point, end exclusive.

    `base` holds the valid matches of the four patterns; `added` the tokens of a looser shape whose
    context the bootstrap trusts. Null and empty texts have neither; repeated rows are found alike.
    Rows of one text and id share their added spans, which are joined by id and text hash.
    """
    short = lambda c: F.transform(c, lambda x: F.struct(x.start, x.kind, x.end))
    found = saved(base_spans(docs), "pii-found")
    accepted = bootstrap(found, rounds, support, confidence)
    extra = (
        found.where(F.size("loose") > 0)
        .select("doc_id", "key", F.explode("loose").alias("x"))
        .select("doc_id", "key", "x.kind", "x.left", "x.right", "x.value", "x.start", "x.end")
        .join(accepted, ["kind", "left", "right", "value"])
        .groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("added"))
    )
    both = found.join(extra, found.doc_id.eqNullSafe(extra._id) & (found.key == extra._key), "left")
    return both.select(
        "doc_id", short("seeds").cast(SPAN).alias("base"), F.coalesce("added", F.array().cast(SPAN)).alias("added")
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda r: F.size(F.filter("base", lambda x: x.kind == r)).cast("long")
    return found.select(
        "doc_id",
        *[count(r).alias(f"n_{k}") for r, k in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
