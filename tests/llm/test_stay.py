"""Texts that are kept as they are stay where they are read: only rows that may change or go are shuffled."""

import pytest
from pyspark.sql import functions as F

from tunedata.llm import line_dedup, near_dups
from tunedata.llm.tables import maybe_in

PASSAGE = " ".join(f"w{i}" for i in range(60))


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, value in zip(names, before, strict=True):
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def texts_shuffled_whole(df):
    """Exchanges over a scan of texts that no bit table has thinned out."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [next((i for i, c in enumerate(x) if c.isalnum()), 0) for x in plan]
    found = []
    for i, line in enumerate(plan):
        if "Exchange hashpartitioning" in line:
            below = plan[i + 1 : next((k for k in range(i + 1, len(plan)) if depth[k] <= depth[i]), len(plan))]
            if any("FileScan" in x and "text#" in x for x in below) and not any("ArrowEvalPython" in x for x in below):
                found.append(line)
    return found


def test_rows_that_stay_are_not_shuffled(spark, no_broadcast):
    rows = [(i, f"own {i} text {i * 7}", "x") for i in range(200)] + [(300, PASSAGE, "y"), (301, PASSAGE, "z"), (None, PASSAGE, None), (302, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = near_dups.without_near_duplicates(docs)
    assert texts_shuffled_whole(kept) == []
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id is not null and doc_id <> 301").collect()))
    cut = line_dedup.dedup_lines(docs)
    assert texts_shuffled_whole(cut) == []
    got = {r.doc_id: (r.text, list(r.removed_lines), r.source) for r in cut.collect()}
    want = {d: (t, [], s) for d, t, s in rows} | {301: ("", [0], "z"), None: ("", [0], None)}
    assert got == want


@pytest.mark.parametrize("ids", [[], [5], [-1, 0, 1 << 40], [3, 3, 3], list(range(0, 20000, 2))])
def test_no_id_is_missed(spark, ids):
    asked = spark.createDataFrame([(i,) for i in ids], "id long")
    rows = spark.range(-10, 20010).union(spark.createDataFrame([(1 << 40,)], "id long"))
    found = {r.id for r in rows.where(maybe_in(F.col("id"), asked)).collect()}
    assert found >= set(ids) and len(found) <= len(set(ids)) + 2000
