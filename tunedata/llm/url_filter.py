"""URL filter: rules by host and path, and trust and distrust propagated over links between hosts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.tables import dropped, saved, table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
DAMPING, SAVE_EVERY = 0.85, 4
# scores are settled when a few rounds move less than this share of all scores
TOLERANCE = 1e-4
# a host is blocked if distrust is more than this share of trust and distrust together
MOST_DISTRUST = 0.75
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, lower-cased) and path; both empty without a url or a ://."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(url, whole, 1)), F.regexp_extract(url, whole, 2)


def _rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as (rule, verdict), or null."""
    cases = None
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        value = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if cases is None else cases


def judged_by_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`pages` with host, path, rule and verdict; the last two null where no rule fits."""
    host, path = host_and_path(F.col("url"))
    step = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    return (
        step.withColumn("_r", _rule(F.col("host"), F.col("path"), rules))
        .withColumns({"rule": F.col("_r.rule"), "verdict": F.col("_r.verdict")})
        .drop("_r")
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links in `html` to other hosts, and each host's tie to its parent domain.

    Links are absolute or start with //. The tie goes both ways with the weight of one link, from a
    host to the host less its first label, while two labels are left. Equal edges are counted before
    they move, so a host with most of the pages sends a row per task and edge.
    """
    host, _ = host_and_path(F.col("url"))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    link = r"(?i)href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#\"'\s>]+)"
    found = F.when(F.contains(html, F.lit("//")), F.regexp_extract_all(html, F.lit(link), F.lit(1)))
    seen = pages.select(host.alias("src"), found.alias("_links")).where("src <> ''")
    links = seen.select("src", F.explode("_links").alias("_l")).select(
        "src", ascii_lower(F.regexp_extract("_l", r"//(.*)$", 1)).alias("dst")
    )
    links = links.where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = seen.select("src").distinct().union(links.select("dst")).distinct()
    parent = F.regexp_extract("src", r"^[^.]+\.(.+\..+)$", 1)
    up = hosts.select("src", parent.alias("dst"), F.lit(1.0).alias("weight")).where("dst <> ''")
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return links.union(up).union(down).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagated(
    edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING
) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from the seeds' `trusted` weights along the edges,
    and from their `blocked` weights against them.

    Both run at once, told apart by `way`. A round is one join and one sum per host; every `SAVE_EVERY`
    rounds the scores are written, until these rounds move less than `tolerance` of all scores; damping
    makes that certain, after some 60 rounds at most. What flows into hosts without a way on returns
    to the seeds: the solution with that return is the one without, scaled to the seeds' total.
    Hosts that no seed reaches are absent. Ties need no rule: scores are sums.
    """
    ways = edges.select(F.lit(0).alias("way"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight").union(
        edges.select(F.lit(1), "dst", "src", "weight")
    )
    out = ways.groupBy("way", "a").agg(F.sum("weight").alias("_out"))
    ways = saved(ways.join(out, ["way", "a"]).select("way", "a", "b", (F.col("weight") / F.col("_out")).alias("part")), "url-edges")
    start = seeds.select(F.lit(0).alias("way"), "host", F.col("trusted").alias("_w")).union(
        seeds.select(F.lit(1), "host", "blocked")
    )
    start = start.where("_w > 0")
    # one total for both, so that a host's two scores compare as its pages do
    total = start.agg(F.sum("_w").alias("_all"))
    start = saved(start.select("way", "host", (F.col("_w") / total.scalar()).alias("score")), "url-seeds")
    jump = start.select("way", "host", ((1 - damping) * F.col("score")).alias("score"))
    state, moving = start, True
    while moving:
        before = state
        for _ in range(SAVE_EVERY):
            moved = (
                state.withColumnRenamed("host", "a")
                .join(ways, ["way", "a"])
                .select("way", F.col("b").alias("host"), (damping * F.col("score") * F.col("part")).alias("score"))
            )
            state = moved.union(jump).groupBy("way", "host").agg(F.sum("score").alias("score"))
        state = saved(state, "url-scores")
        gap = state.select("way", "host", "score").union(before.select("way", "host", -F.col("score"))).groupBy("way", "host").agg(F.sum("score").alias("gap"))
        moving = (gap.agg(F.sum(F.abs("gap"))).first()[0] or 0.0) >= tolerance
        if before is not start:
            dropped(before)
    goal = start.groupBy("way").agg(F.sum("score").alias("_goal"))
    scale = state.groupBy("way").agg(F.sum("score").alias("_sum")).join(goal, "way").select("way", (F.col("_goal") / F.col("_sum")).alias("_scale"))
    settled = state.join(scale, "way").select("way", "host", (F.col("score") * F.col("_scale")).alias("score"))
    settled = saved(settled, "url-scores")
    dropped(ways, start, state)
    return settled.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("way") == 0, F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("way") == 1, F.col("score"))), F.lit(0.0)).alias("distrust"),
    )


def filter_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, most_distrust: float = MOST_DISTRUST
) -> DataFrame:
    """`pages` with host, path, rule, verdict, trust and distrust.

    Hosts are seeds by the pages their rules allow or block. A page without a rule takes its host's
    verdict: block where distrust is above `most_distrust` of both scores, else allow. Without a host,
    without scores, or in an empty table nothing speaks against a page, and it is allowed. Repeated
    rows get equal verdicts; a column already named like a result is replaced.
    """
    ruled = judged_by_rules(pages, rules)
    seeds = (
        ruled.where("rule is not null and host <> ''")
        .groupBy("host")
        .agg(
            F.count(F.when(F.col("verdict") == "allow", 1)).cast("double").alias("trusted"),
            F.count(F.when(F.col("verdict") == "block", 1)).cast("double").alias("blocked"),
        )
    )
    scores = propagated(host_edges(pages), seeds).withColumnRenamed("host", "_host")
    joined = ruled.drop("trust", "distrust").join(scores, ruled.host == scores["_host"], "left").drop("_host")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    by_host = F.when(zero("distrust") > most_distrust * (zero("trust") + zero("distrust")), "block").otherwise("allow")
    return joined.withColumns(
        {"verdict": F.coalesce("verdict", by_host), "trust": zero("trust"), "distrust": zero("distrust")}
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict", "trust", "distrust"
    )
