"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunedata.llm.tables import dropped, saved, table, text_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
NEWTON_STEPS, CLOSE = 16, 1e-4
BINS, LEVELS, PASSES = 4096, 2, 4
TWO = math.log(MOST)


def _sizes(docs: DataFrame) -> DataFrame:
    """`docs` with `_size` (words) and `_v`, a uniform number in [0, 1) from id and text."""
    text = text_of(docs)
    bits = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), text), 11)
    return docs.withColumns(
        {
            "_size": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
            "_v": bits.cast("double") / float(1 << 53),
        }
    )


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(source, source_size, target) from (source, _size, n): one row per source, the null source too.

    Sources in order of code point, null last, take the weights in turn. Targets are c * weight, held
    to `most` times the source's size; c is the level at which they sum to `share` of all words. That
    is where resharing the excess by weight ends, found in one pass over the sources in the order in
    which they fill up. The two windows see one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum(F.col("_size") * F.col("n")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)) + 1)
    full = F.lit(float(most)) * F.col("source_size")
    ranked = sources.withColumn("_w", weight).withColumn("_fills", full / F.col("_w"))
    order = Window.orderBy("_fills", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        share * F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    ) / (F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("_level", level)
    # the first source in this order that the level does not fill sets the level for all after it
    open_level = F.min(F.when(F.col("_level") <= F.col("_fills"), F.struct("_fills", "_level"))).over(everything)
    target = F.when(
        open_level.isNull() | (F.col("_fills") < open_level["_fills"]), full
    ).otherwise(F.least(full, open_level["_level"] * F.col("_w")))
    return ranked.select("source", F.col("source_size"), target.cast("double").alias("target"))


def _rate(size: Column) -> Column:
    """Tilted copies of a document: exp(lambda * size / mean size), at most `MOST`."""
    tilt = F.least(F.col("lam") * size / F.col("mean"), F.lit(TWO))
    return F.when(F.col("full"), F.lit(float(MOST))).otherwise(F.exp(F.greatest(tilt, F.lit(-700.0))))


def balanced(sizes: DataFrame, targets: DataFrame, steps: int = NEWTON_STEPS) -> DataFrame:
    """`targets` with lam, mean and full: the dual variable of each source's token constraint.

    Rates nearest to 1 in relative entropy under the constraints are exp(lam * size / mean), cut at
    the cap. Each step sums gradient and curvature of the dual over (source, size) counts in Spark,
    moves every source by Newton's rule, and halves the bracket where that leaves it. It ends when no
    source is off by more than `CLOSE` of its target, or after `steps`; rounding takes up the rest.
    """
    mean = sizes.where("_size > 0").groupBy("source").agg(
        (F.sum(F.col("_size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("_size").alias("_least")
    )
    state = targets.join(mean, targets.source.eqNullSafe(mean.source), "left").select(
        targets.source,
        "source_size",
        "target",
        F.coalesce("mean", F.lit(1.0)).alias("mean"),
        (F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"),
        F.lit(-700.0).alias("lo"),
        (TWO * F.coalesce("mean", F.lit(1.0)) / F.coalesce("_least", F.lit(1))).alias("hi"),
    )
    state = saved(state, "mix-state")
    columns = state.columns
    for _ in range(steps):
        joined = sizes.join(state, sizes.source.eqNullSafe(state.source)).drop(sizes.source)
        tokens = F.col("_size") * F.col("n") * _rate(F.col("_size"))
        free = F.col("lam") * F.col("_size") / F.col("mean") < TWO
        moved = (
            joined.groupBy(*columns)
            .agg(
                F.sum(tokens).alias("_got"),
                F.sum(F.when(free, tokens * F.col("_size") / F.col("mean"))).alias("_slope"),
            )
            .withColumn("_gap", F.col("_got") - F.col("target"))
            .withColumn("lo", F.when(F.col("_gap") < 0, F.col("lam")).otherwise(F.col("lo")))
            .withColumn("hi", F.when(F.col("_gap") > 0, F.col("lam")).otherwise(F.col("hi")))
        )
        newton = F.col("lam") - F.col("_gap") / F.col("_slope")
        inside = (F.col("_slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        off = F.abs(F.col("_gap")) > CLOSE * F.col("target")
        after = moved.withColumn(
            "lam",
            F.when(F.col("full") | ~off, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2),
        ).withColumn("_off", off & ~F.col("full") & (F.col("source_size") > 0))
        after = saved(after.select(*columns, "_off"), "mix-state")
        dropped(state)
        state = after
        if not state.where("_off").limit(1).count():
            break
    return state.select("source", "source_size", "target", "mean", "full", "lam")


def _level(size: Column) -> Column:
    """The number whose whole part is a document's copies, before the cap."""
    shift = F.col("shift0")
    for k in range(1, PASSES):
        shift = shift + F.when(size <= F.col(f"cut{k}"), F.col(f"shift{k}")).otherwise(0.0)
    return _rate(size) + F.col("_v") + shift


def copies(size: Column) -> Column:
    return F.when(size > 0, F.greatest(F.least(F.floor(_level(size)), F.lit(MOST)), F.lit(0))).otherwise(0).cast("long")


def rounded(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """`rates` with shift0, cut1, shift1, ...: what turns rates into whole copies that meet the targets.

    A document gets floor(rate + v + shift) copies, v being its own uniform number. As the shift of a
    source grows its documents gain copies one after another, so some shift meets the target to within
    one document. It is found by counting words per bin of the shift at which copies change, then
    within the one bin where the target lies. Further passes shift only documents no larger than the
    rest that is still open, and bring it down to a few words where such documents exist. A pass is an aggregation to `BINS` rows a source.
    """
    params = rates
    for k in range(PASSES):
        params = params.withColumn(f"shift{k}", F.lit(0.0)).withColumn(f"cut{k}", F.lit(-1.0 if k else float("inf")))
    params = saved(params, "mix-rounding")
    names = params.columns
    for k in range(PASSES):
        bounds = params.withColumns({"_lo": F.lit(-4.0), "_width": F.lit(8.0 / BINS)})
        taken_now = F.sum(F.col("_size") * copies(F.col("_size")))
        joined = lambda p: rows.join(p, rows.source.eqNullSafe(p.source)).drop(rows.source)
        if k:
            gaps = joined(params).groupBy(*names).agg((F.col("target") - taken_now).alias("_gap"))
            params = gaps.withColumn(f"cut{k}", F.abs("_gap")).drop("_gap")
            params = saved(params.select(*names), "mix-rounding")
            bounds = params.withColumns({"_lo": F.lit(-4.0), "_width": F.lit(8.0 / BINS)})
        fixed = joined(params).where(F.col("_size") > F.col(f"cut{k}")).groupBy(F.col("source").alias("_s")).agg(
            taken_now.alias("_held")
        )
        bounds = bounds.join(fixed, bounds.source.eqNullSafe(fixed._s), "left").drop("_s")
        bounds = saved(bounds.withColumn("_below", F.coalesce("_held", F.lit(0)).cast("double")).drop("_held"), "mix-bins")
        for _ in range(LEVELS):
            near = joined(bounds).where((F.col("_size") > 0) & (F.col("_size") <= F.col(f"cut{k}")))
            flips = near.withColumn("_k", F.explode(F.array(*[F.lit(float(c)) for c in range(1, MOST + 1)]))).withColumn(
                "_bin", F.floor((F.col("_k") - _level(F.col("_size")) - F.col("_lo")) / F.col("_width"))
            )
            flips = flips.where(F.col("_bin").between(0, BINS - 1))
            counted = flips.groupBy(F.col("source").alias("_s"), "_bin").agg(F.sum("_size").alias("_tokens"))
            order = Window.partitionBy("_s").orderBy("_bin")
            counted = counted.withColumn("_upto", F.sum("_tokens").over(order))
            before = bounds.select(F.col("source").alias("_b"), "_below", "target")
            hit = (
                counted.join(before, counted._s.eqNullSafe(before._b))
                # the bin in which the running sum passes the target, or else the last one
                .groupBy("_s")
                .agg(
                    F.min(
                        F.when(
                            F.col("_below") + F.col("_upto") >= F.col("target"),
                            F.struct("_bin", (F.col("_upto") - F.col("_tokens")).alias("_under"), "_tokens"),
                        )
                    ).alias("_in"),
                    F.max(F.struct("_bin", F.col("_upto").alias("_under"), F.lit(0).cast("long").alias("_tokens"))).alias("_end"),
                )
                .select(
                    "_s",
                    F.coalesce(F.col("_in._bin"), F.col("_end._bin") + 1).alias("_bin"),
                    F.coalesce(F.col("_in._under"), F.col("_end._under")).alias("_under"),
                    F.coalesce(F.col("_in._tokens"), F.lit(0)).alias("_last"),
                )
            )
            bounds = bounds.join(hit, bounds.source.eqNullSafe(hit._s), "left").drop("_s")
            bounds = bounds.withColumns(
                {
                    "_lo": F.col("_lo") + F.coalesce("_bin", F.lit(0)) * F.col("_width"),
                    "_below": F.col("_below") + F.coalesce("_under", F.lit(0)),
                }
            )
            bounds = bounds.withColumn("_step", F.col("_width")).withColumn("_width", F.col("_width") / BINS)
            bounds = saved(bounds.drop("_bin", "_under").withColumnRenamed("_last", "_tail"), "mix-bins")
            tail = bounds.select("source", F.coalesce("_tail", F.lit(0)).alias("_tail"))
            last, bounds = bounds, bounds.drop("_tail", "_step")
        # just below the bin, or through it: whichever ends nearer to the target
        through = F.col("_below") + F.coalesce("_tail", F.lit(0)) - F.col("target") < F.col("target") - F.col("_below")
        shift = F.col("_lo") + F.when(through, F.col("_step")).otherwise(0.0)
        params = saved(last.withColumn(f"shift{k}", shift).select(*names), "mix-rounding")
    return params


def mixed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, params): (doc_id, source, _size, _v) of every document, and one row per source with its
    size, target and rounding. Nothing but sums per source and size, or per source and bin, is shuffled.

    A text that is null, empty or white space has size 0 and no copies. Rows that agree in id and text
    get the same number of copies. An empty table gives empty tables.
    """
    rows = saved(_sizes(docs).select("doc_id", "source", "_size", "_v"), "mix-rows")
    sizes = saved(rows.groupBy("source", "_size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    return rows, rounded(rows, balanced(sizes, saved(source_targets(sizes), "mix-targets")))


def mix(docs: DataFrame) -> DataFrame:
    """`docs` as the mix takes them: each row as often as it has copies; columns of any name pass unchanged."""
    rows, params = mixed(docs)
    dropped(rows)
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    sized = _sizes(docs.select(whole, docs["doc_id"], docs["source"], docs["text"])).drop("text")
    right = params.withColumnRenamed("source", "_source").drop("source_size", "target")
    joined = sized.join(right, sized.source.eqNullSafe(right._source))
    repeated = joined.withColumn("_copies", copies(F.col("_size"))).where("_copies > 0")
    return repeated.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, params = mixed(table(spark, sf_dir, "documents"))
    joined = rows.join(params, rows.source.eqNullSafe(params.source)).drop(params.source)
    return joined.select(
        "doc_id",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (copies(F.col("_size")) * F.col("_size")).alias("taken"),
        _rate(F.col("_size")).alias("rate"),
    )
