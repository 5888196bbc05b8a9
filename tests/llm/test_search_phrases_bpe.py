"""Ranked search, phrase mining and BPE coding against plain versions on small and odd tables."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tests.llm.test_operators import LOWER, ODD, SCHEMA
from tunedata.llm import bpe, phrases, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def some_texts(seed, n, words=60, length=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Über", "naïve", "x-y", "漢字"]
    return [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(0, length))) for _ in range(n)]


# --- 11 ranked search --------------------------------------------------------------------------


def plain_search(docs, items, k=10):
    """docs: (id, text) rows; items: (id, text) rows -> sorted (item, rank, id, score)."""
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    big_n, big_l = len(terms), sum(len(t) for _, t in terms)
    df = collections.Counter(w for _, t in terms for w in set(t))
    out = []
    for item, text in items:
        asked, scored = set(TERM.findall((text or "").translate(LOWER))), []
        for i, t in terms:
            tf, m, score = collections.Counter(t), 10 + (90 * len(t) * big_n) // big_l, 0
            for w in asked & set(tf):
                weight = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1)))
                score += weight * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [search.BLOCK_TERMS, 30])
def test_search_equals_the_plain_ranking(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    monkeypatch.setattr(search, "ACCUMULATORS", 4000)
    docs = list(enumerate(some_texts(1, 150))) + [(1000 + i, "w1 w2 w3") for i in range(30)] + [(None, "w1 w2"), (7, None), (8, "...")]
    items = list(enumerate(some_texts(2, 25, length=20))) + [(50, "w1 w2"), (50, "w1 w2"), (60, None), (61, "none of these"), (None, "w3")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert found(search.search(d, q)) == plain_search(docs, items)


def test_search_of_odd_rows(spark, odd, empty):
    docs = [(r[0], r[1]) for r in ODD]
    items = [(1, "one passage3"), (2, "w1x1 SS"), (3, "")]
    q = spark.createDataFrame(items, "item_id long, text string")
    assert found(search.search(odd, q)) == plain_search(docs, items)
    assert search.search(empty, q).count() == 0
    assert search.search(odd, q.where("item_id > 9")).count() == 0


def test_shared_sets_add_up_to_the_queries():
    rng = random.Random(3)
    common = [{f"c{i}{k}".encode() for k in range(6)} for i in range(4)]
    queries = {n: set().union(*rng.sample(common, 2)) | {f"own{n}".encode()} for n in range(40)} | {99: set()}
    plan = search.sharing_plan(queries)
    held = {i: {t} for i, t in enumerate(plan.terms)}
    for nodes, first, second in plan.levels:
        for n, a, b in zip(nodes.tolist(), first.tolist(), second.tolist(), strict=True):
            assert not held[a] & held[b]
            held[n] = held[a] | held[b]
    ends = [*plan.start[1:].tolist(), plan.flat.size]
    for q, a, b in zip(plan.queries, plan.start.tolist(), ends, strict=True):
        parts = [held[x] for x in plan.flat[a:b].tolist()]
        assert sum(map(len, parts)) == len(queries[q]) and set().union(*parts) == queries[q]
    assert plan.flat.size + plan.n_nodes - len(plan.terms) < sum(map(len, queries.values())) / 2  # fewer sums than terms


# --- 12 phrases ----------------------------------------------------------------------------------


def plain_phrases(rows, longest, least, top):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= f[p[i:j]]}
        rows_ = []
        for p, a in found.items():
            if p not in inside:
                cuts = [(1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("block", "top"), [(phrases.BLOCK_BYTES, 2000), (1500, 7)])
def test_phrases_equal_plain_counting(spark, monkeypatch, block, top):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    rng = random.Random(9)
    fixed = ["new york city hall", "in spite of", "A B c d e f"]
    rows = []
    for text in some_texts(4, 200, words=12, length=30):
        words = text.split(" ")
        words.insert(rng.randrange(len(words)), rng.choice(fixed))
        text = "".join(w + rng.choice([" ", "  ", " ", "\t", ". ", "\n", ", "]) for w in words)
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    rows += [(None, "en"), ("", None), ("...", "fr"), ("a a a a a a a a", "xx")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = phrases.mine_phrases(df, least=4, top=top)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 5, 4, top)


def test_phrases_of_odd_rows(odd, empty):
    got = phrases.mine_phrases(odd, least=2)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases([(r[1], r[2]) for r in ODD], 5, 2, 2000)
    assert phrases.mine_phrases(empty).count() == 0


def test_long_texts_are_cut_between_pieces():
    text = b"one two. three four\n" * 50 + b"x" * 300 + b" y. z"
    parts = list(phrases.piece_cut(text, 64))
    assert b"".join(parts) == text and len(parts) > 10
    assert all(p[-1:] in (b".", b"\n") for p in parts[:-1] if p)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(["a", "b"], 9 * 10**12, 10**15, [10**13, 9 * 10**12], [9 * 10**12 + 1, 9 * 10**12])]
    df = spark.createDataFrame(rows, "words array<string>, a long, n long, heads array<long>, tails array<long>")
    r = phrases._scored(df).first()
    assert r.score == 1000 * 9 * 10**12 * 10**15 // (10**13 * (9 * 10**12 + 1)) and (r.l, r.r) == (10**13, 9 * 10**12 + 1)


# --- 13 BPE ---------------------------------------------------------------------------------------


def odd_texts():
    rng = random.Random(5)
    letters = list("ab  \n\té́ñ漢'st<|>.!1 \xa0İ\x01") + ["<|endoftext|>", "'re", " the", "\r\n"]
    texts = ["", " ", "a" * 30_000, "a " * 5000, "<|endoftext|>" * 300, "é́ ñ" * 2000, " \n\n  \t x" * 3000, "x<|startoftext|> y" * 2000]
    return texts + ["".join(rng.choices(letters, k=rng.randint(1, 4000))) for _ in range(40)] + some_texts(6, 100, words=500, length=400)


@pytest.mark.parametrize(("name", "apart"), [(bpe.TOKENIZER, True), (bpe.TOKENIZER, False), ("byte_bpe_50k.json", False)])
@pytest.mark.parametrize("bits", [bpe.CHUNK_BITS, 4])
def test_chunked_encoding_equals_the_library(monkeypatch, name, apart, bits):
    whole = bpe.Chunks.__init__
    monkeypatch.setattr(bpe.Chunks, "__init__", lambda self, pieces: whole(self, pieces, bits))
    monkeypatch.setattr(bpe, "GROUP_BYTES", 20_000)
    texts = odd_texts()
    got = bpe.Encoder(name, {}, apart).texts([t.encode() for t in texts])
    library = bpe._tokenizer(name)
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunks_of_copies_are_encoded_once():
    text = " ".join(some_texts(7, 1, words=3000, length=20_000)).encode() + b" " + b" ".join(b"t%d" % i for i in range(9000))
    encoder = bpe.Encoder(bpe.TOKENIZER, {})
    encoder.pieces([text])
    once = encoder.encoded
    encoder.pieces([text, b"something before " + text])
    assert once > 0.9 * len(text) and encoder.encoded - once < 0.1 * len(text)  # the cuts follow the content


def test_a_window_that_does_not_agree_is_widened():
    """A tokenizer that sees three words ahead: neighbours change ids until the windows hold them."""
    text = b" ".join(b"w%d" % i for i in range(4000))
    encoder = bpe.Encoder("byte_bpe_50k.json", {}, apart=False)
    seen = []

    def near_sighted(texts):
        encoder.windows = {}
        for t in texts:
            ids = bpe._encode(encoder.tokenizer, [t])[0].copy()
            if len(t) < 30 and ids.size:
                ids[0] ^= len(t)  # too little context: the first id depends on the length
            encoder.windows[t] = ids
        seen.append(max(map(len, texts)))

    encoder._windows = near_sighted
    got = encoder.pieces([text])[0]
    assert got.tolist() == encoder.tokenizer.encode(text.decode(), add_special_tokens=False).ids and len(seen) > 2


def test_encoding_and_decoding_of_odd_rows(odd, empty):
    library = bpe._tokenizer(bpe.TOKENIZER)
    coded = bpe.encode(odd.withColumnRenamed("key", "coded"), decoded="again")
    assert coded.columns == ["doc_id", "text", "lang", "source", "coded", "value", "score", "token_ids", "again"]
    for r in bpe.decode(coded).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids
        assert r.again == r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty).count() == 0


def test_shared_chunks_are_those_of_many_rows(spark):
    passage = " ".join(f"passage{i}" for i in range(2000))
    rows = [(i, f"{i} own words " + passage + f" end {i}") for i in range(20)] + [(99, " ".join(f"x{i}" for i in range(3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shared = bpe.shared_chunks(df)
    assert shared and all(k.decode() in passage for k in shared)
    library = bpe._tokenizer(bpe.TOKENIZER)
    assert all(np.frombuffer(v, np.uint32).tolist() == library.encode(k.decode(), add_special_tokens=False).ids for k, v in shared.items())
