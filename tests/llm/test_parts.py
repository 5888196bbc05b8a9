"""Python steps read the batches of a task in parts of bounded size, and leave no memory behind."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tunedata.llm import bytes_ as B
from tunedata.llm import decontaminate, language_id, line_dedup, near_dups

TEXTS = [" ".join(f"w{i % 97}x{k % 89}" for k in range(400)) + f"\nline {i}" for i in range(1800)]


class Rows:
    """Stands for a table: what a Python step makes of one batch of it."""

    def __init__(self, **columns):
        self.batch = pa.RecordBatch.from_pydict(columns)

    def __getitem__(self, name):
        return F.col(name)

    def select(self, *_):
        return self

    def mapInArrow(self, step, schema):  # noqa: N802
        return list(step(iter([self.batch])))


def test_parts_hold_every_row_once():
    column = pa.array([None, "", "ab" * 5, None, "x" * 100, "y", "z" * 9, "é" * 6])
    found = list(B.parts(column, limit=24))
    assert [k for at, n in found for k in range(at, at + n)] == list(range(8))
    assert found == [(0, 4), (4, 1), (5, 2), (7, 1)]
    assert list(B.parts(pa.array([], pa.string()))) == []
    assert list(B.parts(pa.array([1, None, 3]))) == [(0, 3)]
    for kind in (pa.large_string(), pa.binary(), pa.large_binary()):
        assert list(B.parts(column.cast(kind), limit=24)) == found


@pytest.mark.parametrize("step", [near_dups.shingled, lambda rows: line_dedup.lines_of(rows, 50)])
def test_steps_make_a_batch_for_every_part(spark, step):
    uids = list(range(len(TEXTS)))
    parts = len(list(B.parts(pa.array(TEXTS))))
    made = step(Rows(uid=uids, doc_id=uids, text=TEXTS) if step is near_dups.shingled else Rows(uid=uids, text=TEXTS))
    assert parts > 2 and len(made) == parts
    one = step(Rows(uid=[700], doc_id=[700], text=[TEXTS[700]]) if step is near_dups.shingled else Rows(uid=[700], text=[TEXTS[700]]))
    assert [r for b in made for r in b.to_pylist() if r["uid"] == 700] == one[0].to_pylist()


def test_functions_end_with_no_memory_held(monkeypatch):
    freed, sizes = [], []
    monkeypatch.setattr(B, "free", lambda: freed.append(1))

    def upper(text, n):
        sizes.append(sum(map(len, text.to_pylist())))
        return pa.array([t.upper() for t in text.to_pylist()])

    column = pa.array(TEXTS)
    out = [x for a in B.in_parts(upper)(iter([(column, pa.array(range(len(TEXTS))))] * 2)) for x in a.to_pylist()]
    assert out == [t.upper() for t in TEXTS] * 2 and max(sizes) <= B.SLICE_BYTES and freed == [1]
    assert [a.to_pylist() for a in B.in_parts(lambda c: c)(iter([pa.array(["a", None])]))] == [["a", None]] and freed == [1, 1]


def test_functions_of_columns_that_cut_texts_free_in_workers(spark, monkeypatch):
    read = []
    whole = B.in_parts
    monkeypatch.setattr(B, "in_parts", lambda step: read.append(step.__name__) or whole(step))
    docs = spark.createDataFrame([(1, "a b c", "en"), (2, "d", "en")], "doc_id long, text string, lang string")
    items = spark.createDataFrame([("q", "a b")], "item_id string, text string")
    model = language_id.Model(["en"], np.zeros((language_id.BUCKETS, 1), np.float32), np.zeros(1, np.float32))
    assert line_dedup.dedup_lines(docs).count() == decontaminate.remove_leaks(docs, items).count() == 2
    assert language_id.identify(docs, model).where("lang_pred = 'en'").count() == 2
    assert read == ["without_lines", "leaks", "without_spans", "predicted"]


def test_sums_over_steps_equal_one_sum():
    data = np.random.default_rng(3).integers(0, 256, 2 * B.STEP + 77).astype(np.uint8)
    powers = B._powers(1 << 21)[0]
    assert (B._sums(data, powers)[1:] == np.cumsum(B._byte_codes()[data] * powers[: data.size])).all()
    assert B._sums(data[:0], powers).tolist() == [0]
    assert [int(x) for x in powers[:4]] == [B._BASE**k % (1 << 64) for k in range(4)]
    assert (powers * B._powers(1 << 21)[1] == 1).all()
