"""Every operator against a plain version on small tables, and on empty, null, long and repeated rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunedata.llm import decontaminate, language_id, line_dedup, lm_scoring, mixing, near_dups, pii, quality
from tunedata.llm import token_counts, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, key string, value string, score double"
WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(120_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))

# nulls in every column, empty and wordless texts, repeated rows, a very long text, clashing column names
ODD = [
    (None, None, None, None, None, None, None),
    (1, "", "en", "a", "k", "v", 1.0),
    (2, " \n\t ", None, None, "k", "v", 1.0),
    (3, "one", "en", "a", "k", "v", 1.0),
    (3, "one", "en", "a", "k", "v", 1.0),
    (None, "no id\n" + PASSAGE, "en", None, "k", "v", 1.0),
    (4, "first\n" + PASSAGE + "\nlast", "en", "b", "k", "v", 1.0),
    (5, "other\n" + PASSAGE, "de", "b", "k", "v", 1.0),
    (6, LONG, "en", "b", "k", "v", 1.0),
    (7, LONG + " end", "en", "b", "k", "v", 1.0),
    (8, "é ß 漢字 ñ", "fr", "c", "k", "v", 1.0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(corpus):
    return {r.doc_id: r.text for r in corpus.select("doc_id", "text").collect()}


# --- 1 LM scoring ----------------------------------------------------------------------------


def plain_scores(texts):
    order, start, end = lm_scoring.ORDER, lm_scoring.START, lm_scoring.END
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    symbols = lambda x: [start] * order + [b + 1 for b in x.translate(LOWER).encode()] + [end]
    trie = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for i, x in texts.items():
        s = symbols(x)
        for k in range(order, len(s)) if not held[i] else ():
            for j in range(order + 1):
                trie[j][tuple(s[k - j : k])][s[k]] += 1

    def score(x):
        s, total = symbols(x), 0.0
        for k in range(order, len(s)):
            gone, p = set(), 1.0
            for j in range(order, -1, -1):
                seen = trie[j].get(tuple(s[k - j : k]), {})
                n = sum(v for a, v in seen.items() if a not in gone)
                if not n:
                    continue
                if s[k] in seen:
                    p *= (seen[s[k]] - 0.5) / n
                    break
                p *= sum(1 for a in seen if a not in gone) / n / 2
                gone = set(seen)
            else:
                p /= 257 - len(gone)
            total += math.log10(p)
        return total

    return score, held


@pytest.mark.parametrize("most_shared", [lm_scoring.MOST_SHARED, 0])
def test_scores_equal_a_plain_trie(spark, texts, most_shared):
    some = {i: texts[i][:700] for i in sorted(texts)[:40]}
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    score, held = plain_scores(some)
    got = lm_scoring.score_texts(docs, most_shared=most_shared).collect()
    assert len(got) == len(some)
    for r in got:
        assert r.held_out == held[r.doc_id]
        assert r.score == pytest.approx(score(some[r.doc_id]), rel=1e-5)


def test_word_base(corpus, texts):
    tokens = {i: WORD.findall(x.translate(LOWER)) + ["\n"] for i, x in texts.items()}
    counts = collections.Counter()
    for i, w in tokens.items():
        counts.update(w if zlib.crc32(str(i).encode()) % 10 else [])
    total, kinds = sum(counts.values()), len(counts)
    for r in lm_scoring.score_texts(corpus).collect():
        want = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens[r.doc_id])
        assert (r.n_tokens, r.train_tokens) == (len(tokens[r.doc_id]), total)
        assert r.n_known == sum(counts[w] > 0 for w in tokens[r.doc_id])
        assert r.base_score == pytest.approx(want, rel=1e-9)


def test_scores_of_odd_rows(odd, empty):
    rows = lm_scoring.score_texts(odd).collect()
    assert len(rows) == len(ODD)
    assert [r.n_tokens for r in rows if r.doc_id == 1] == [1]
    assert [r.n_tokens for r in rows if r.doc_id == 6] == [120_001]
    assert all(r.score < 0 for r in rows)
    assert lm_scoring.score_texts(empty).count() == 0


# --- 2 language ID ---------------------------------------------------------------------------


def test_language_accuracy_on_held_out_texts(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fitted(corpus)
    rows = language_id.identify(corpus, model).where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, empty, corpus):
    found = language_id.identify(odd, language_id.fitted(corpus)).collect()
    assert len(found) == len(ODD)
    for r in found:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in {"en", "de", "es", "fr"}
    assert language_id.identify(odd, language_id.fitted(empty)).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty, language_id.fitted(corpus)).count() == 0


def test_the_sample_comes_packed(corpus, monkeypatch):
    """Buckets and shares of the sample reach the driver as bytes, never as one Python number each."""
    kinds, train = [], language_id.train
    monkeypatch.setattr(type(corpus), "collect", lambda self: pytest.fail("rows as Python objects"))
    monkeypatch.setattr(language_id, "train", lambda features, labels: kinds.extend(type(x.base) for f in features for x in f) or train(features, labels))
    assert language_id.fitted(corpus).languages == ["de", "en", "es", "fr"]
    assert set(kinds) == {bytes}


def test_long_texts_teach_a_language_too(spark, texts):
    """A language whose texts are all long is learned; features are those of the whole text."""
    rows = [(i, (text + " ") * (1 + 9000 // len(text)) if lang == "fr" else text, lang) for i, (lang, text) in enumerate(
        (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and r.lang)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fitted(df)
    assert model.languages == sorted({r[2] for r in rows})
    for name, found in (("fr", 0.9), ("en", 0.9)):
        mine = [x.encode() for _, x, lang in rows if lang == name]
        best, _ = model.predict(mine)
        assert np.mean([model.languages[b] == name for b in best]) > found


def test_features_and_prediction_equal_a_plain_forward_pass():
    text = "Über the façade, x1y the the"
    words = [w for w in re.split(rb"[^A-Za-z\x80-\xff]+", text.translate(LOWER).encode()) if w]
    grams = collections.Counter()
    for w in words:
        w = b"<" + w + b">"
        for n in language_id.GRAMS:
            for i in range(len(w) - n + 1):
                code = n
                for b in w[i : i + n]:
                    code = (code << 8 | b) % (1 << 64)
                grams[int(language_id.B.mix(np.array([code], np.uint64))[0]) % language_id.BUCKETS] += 1
    ((buckets, shares),) = language_id.features_of([text.encode()])
    total = sum(grams.values())
    assert dict(zip(buckets.tolist(), shares.tolist(), strict=True)) == pytest.approx({b: n / total for b, n in grams.items()})
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b"], rng.normal(size=(language_id.BUCKETS, 2)), np.array([0.1, -0.1]), temperature=0.7)
    plain = (sum(n * model.weights[b] for b, n in grams.items()) / total + model.bias) / 0.7
    assert model.logits([text.encode()])[0] == pytest.approx(plain)


# --- 3 PII -----------------------------------------------------------------------------------


def plain_spans(x):
    luhn = lambda d: sum((2 * int(c) - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return sorted((m.start(), k, m.end()) for k, (r, ok) in enumerate(kinds) for m in re.finditer(r, x) if ok(m[0]))


HARD = [
    "a@b.c_d@e.fg a.b@c.d.e@f.gh .@x.y @a.b é漢 me+you@x-y.example.org,",
    "1.2.3.4.5.6.7.8 1.2.3.999 01.002.3.4 999.1.1.1.1 0000256.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 4111111111111111 7 +1 (499) 555-6503 +12 +1--------2345678 9",
    "+4915112345678 tel +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 x +",
    "𝔘𝔫𝔦 a@b.cc " + "1 " * 4000 + "a" * 50_000 + " " + "9" * 30_000 + " x@y.zz",
]


def test_base_spans_equal_the_plain_patterns(spark, texts):
    docs = spark.createDataFrame(list(enumerate(HARD)) + [(100 + i, x) for i, x in texts.items()], "doc_id long, text string")
    want = {r.doc_id: plain_spans(r.text) for r in docs.collect()}
    for r in pii.personal_data(docs).collect():
        assert [tuple(x) for x in r.base] == want[r.doc_id]


def test_contexts_reveal_unseen_identifiers(spark):
    cards = ["4111111111111111", "5500005555555559", "340000000000009", "6011000990139424", "3530111333300000", "4012888888881881"]
    rows = [(i, f"please charge card {c} for the order") for i, c in enumerate(cards * 2)]
    rows += [(50, "please charge card 4111111111111112 for the order"), (51, "serial code 4111111111111112x was printed"),
             (52, "number 123456789012 stands alone"), (None, None), (53, "")]
    found = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in found[50].added] == [(19, 2, 35)] and not found[50].base
    assert not found[51].added and not found[52].added and not found[0].added and not found[None].base


def test_pii_of_odd_rows(odd, empty):
    assert pii.personal_data(odd).count() == len(ODD)
    assert pii.personal_data(empty).count() == 0


# --- 4 quality -------------------------------------------------------------------------------


def plain_counts(x):
    w = WORD.findall(x)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [y for y in x.split("\n") if WORD.search(y)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd, texts):
    rows = [*texts.items(), *((None if r[0] is None else 10**6 + r[0], r[1]) for r in ODD), (-1, "a b c a b c a b c d a b"), (-2, "x\n" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = collections.Counter((i, *plain_counts(x or "")) for i, x in rows)
    got = quality.word_counts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert collections.Counter(map(tuple, got.collect())) == want


def test_quality_verdicts(spark, odd, empty, corpus):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_rules(corpus, labels).collect()
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    kept = [r.kept for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(kept) / len(kept) > 0.95
    assert any(not r.kept and not r.base_failed for r in rows)
    assert quality.quality_rules(odd, labels).count() == len(ODD)
    assert quality.quality_rules(empty, labels.limit(0)).count() == 0
    assert {r.ratio for r in quality.quality_rules(odd, labels.limit(0)).collect()} == {0.0}


# --- 5 token counts --------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, odd, empty, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    rows = [*texts.items(), (-1, "<|endoftext|> a<|startoftext|>b 's don't I'll 12 3"), (-2, "é ́x y z"),
            (-3, "ΟΔΟΣ Σ ΑΣ"), (-4, "x" * 3_000_000 + " y")]
    for tokens in (rows, [(r[0], r[1]) for r in ODD]):
        docs = spark.createDataFrame(tokens, "doc_id long, text string")
        want = collections.Counter((i, len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for i, x in tokens)
        assert collections.Counter(map(tuple, token_counts.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens").collect())) == want
    assert token_counts.count_tokens(empty).count() == 0


# --- 6 URLs ----------------------------------------------------------------------------------

PAGES = [
    (1, "http://A.Example.ORG/es/x?y", ""),
    (2, "https://example.org/en/12#z", ""),
    (3, "http://example.org", ""),
    (4, "http://b.com/fr/?q=://x/", '<a href="http://good.net/a">'),
    (5, "ftp://b.com:80/de/", ""),
    (6, None, None),
    (7, "no scheme/x", ""),
    (8, "http://bad.com/de/1", ""),
    (9, "http://spam.net/1", '<a href="//bad.com/"> <A HREF=http://bad.com/de/2>'),
    (10, "http://good.net/1", ""),
    (10, "http://good.net/1", ""),
]


def test_url_rules_and_links(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert [(got[i].host, got[i].path) for i in (1, 3, 5, 6, 7)] == [("a.example.org", "/es/x"), ("example.org", ""), ("b.com:80", "/de/"), ("", ""), ("", "")]
    assert [got[i].rule for i in range(1, 9)] == ["example.org/es/", "example.org/en/1", None, "com/fr/", None, None, None, "com/de/"]
    assert [got[i].verdict for i in (1, 2, 4, 8, 9, 10, 6, 7)] == ["block", "block", "allow", "block", "block", "allow", "allow", "allow"]
    assert url_filter.filter_urls(pages).count() == len(PAGES)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_propagation_equals_plain_iteration(spark):
    """Distrust has no way on from d: what flows there returns to the seeds."""
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("c", "a", 1.0), ("d", "c", 3.0), ("b", "end", 1.0)]
    got = url_filter.propagated(
        spark.createDataFrame(edges, "src string, dst string, weight double"),
        spark.createDataFrame([("a", 3.0, 0.0), ("c", 0.0, 1.0)], "host string, trusted double, blocked double"),
        tolerance=1e-9,
    ).collect()
    for column, links, seed in (("trust", edges, {"a": 0.75}), ("distrust", [(b, a, w) for a, b, w in edges], {"c": 0.25})):
        out = collections.Counter()
        for a, _, w in links:
            out[a] += w
        rank, mass = dict(seed), sum(seed.values())
        for _ in range(300):
            stuck = sum(x for h, x in rank.items() if not out[h])
            new = collections.Counter({h: (0.15 + 0.85 * stuck / mass) * s for h, s in seed.items()})
            for a, b, w in links:
                new[b] += 0.85 * rank.get(a, 0) * w / out[a]
            rank = new
        assert sum(rank.values()) == pytest.approx(mass)
        for r in got:
            assert r[column] == pytest.approx(rank.get(r.host, 0), abs=1e-7)


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    """Twenty hosts link to the next, the last one is blocked by a rule."""
    pages = [(i, f"http://h{i}.net{i}/", f"<a href='http://h{i + 1}.net{i + 1}/'>") for i in range(19)] + [(19, "http://h19.net19/", "")]
    pages += [(20, "http://h19.net19/bad/", ""), (30, "http://apart.net/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = (url_filter.Rule("block", "net19", "/"),)
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {i: "allow" if i == 30 else "block" for i, *_ in pages}


# --- 7 mixing --------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        share = sum(weight[s] for s in sizes if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / share for s in sizes}
        over = {s for s in sizes if target[s] > 2 * sizes[s] and s not in full}
        if not over:
            return target
        full |= over


def test_mix_meets_targets(spark):
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, params = mixing.mixed(corpus)
    joined = rows.join(params, rows.source.eqNullSafe(params.source)).select(rows.source, "_size", "target", mixing.copies(rows._size).alias("n"))
    taken, sizes, target = collections.Counter(), collections.Counter(), {}
    for r in joined.collect():
        assert r.n in (0, 1, 2)
        taken[r.source] += r.n * r._size
        sizes[r.source] += r._size
        target[r.source] = r.target
    assert target == pytest.approx(plain_targets(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.005 * target[s]


def test_mix_of_odd_rows(odd, empty):
    assert mixing.mix(odd).columns == odd.columns
    rows, params = mixing.mixed(odd)
    sizes = collections.Counter()
    for r in rows.collect():
        sizes[r.source] += r._size
    assert {r.source: r.target for r in params.collect()} == pytest.approx(plain_targets(sizes))
    assert mixing.mix(empty).count() == 0


# --- 8 decontamination -----------------------------------------------------------------------


def plain_leaks(docs, items, n=10):
    cut = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (x or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for i, x in items:
        w = cut(x)
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k : k + m])].add(str(i))
    out = []
    for i, x in docs:
        w, hit, names = cut(x), set(), set()
        for m in set(map(len, windows)):
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    names |= windows[tuple(w[k : k + m])]
        out.append((i, len(w), len(hit), tuple(sorted(names))))
    return sorted(out, key=str)


ITEMS = [(1, "W5x5 w6x6, w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x13 w14x14 w15x15"), (2, "passage3"), (10, "Passage3 passage4"), (3, None), (4, " "), (2, "passage3")]


@pytest.mark.parametrize("block_bytes", [decontaminate.ITEM_BLOCK_BYTES, 40])
def test_leaks_equal_plain_windows(spark, corpus, odd, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", block_bytes)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    cases = [(odd, items, [(r[0], r[1]) for r in ODD], ITEMS)]
    if block_bytes > 40:
        bench = spark.read.parquet(f"{SF}/benchmark.parquet")
        plain = lambda df: [tuple(r) for r in df.collect()]
        cases.append((corpus, bench, plain(corpus.select("doc_id", "text")), plain(bench.select("item_id", "text"))))
    for docs, test, d, t in cases:
        got = []
        for r in decontaminate.find_leaks(docs, test).select("doc_id", "text", "leaks").collect():
            got.append((r.doc_id, r.leaks.n_words, sum(s.end_word - s.word for s in r.leaks.spans), tuple(r.leaks.items)))
        assert sorted(got, key=str) == plain_leaks(d, t)


def test_removed_passages_are_gone(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = decontaminate.remove_leaks(odd, items)
    assert clean.columns == odd.columns and clean.count() == len(ODD)
    rows = {r.doc_id: r.text for r in clean.collect()}
    assert rows[5] == ODD[7][1].replace("passage3 passage4", "") and rows[8] == ODD[10][1] and rows[1] == ""
    assert decontaminate.remove_leaks(empty, items).count() == 0
    assert decontaminate.remove_leaks(odd, items.limit(0)).count() == len(ODD)


# --- 9 near duplicates -----------------------------------------------------------------------


def plain_classes(rows):
    """Connected by Jaccard similarity of 0.8 or more over shingle counts; first id of each class."""
    bags = {}
    for i, x in rows:
        w = x.translate(LOWER).split()
        bags[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    parent = {i: i for i in bags}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for a in ids:
        for b in ids:
            if a < b and bags[a] and bags[b]:
                both = sum((bags[a] & bags[b]).values())
                if both / (sum(bags[a].values()) + sum(bags[b].values()) - both) >= 0.8:
                    parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in bags}


def test_near_duplicate_classes(corpus, texts):
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(corpus).collect()}
    want = plain_classes(list(texts.items()))
    assert sum(got[i] == want[i] for i in want) / len(want) > 0.995
    assert len(set(want.values())) < len(want)


def test_large_group_of_near_copies(spark):
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(words[:k] + [f"new{i}"] + words[k + 1 :])) for i, k in ((i, i * 7 % 200) for i in range(60))]
    rows += [(100 + i, " ".join(f"doc{i}_{k}" for k in range(80))) for i in range(40)]
    found = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in found if r.doc_id < 100} == {0}
    assert all(r.class_id == r.doc_id and r.kept for r in found if r.doc_id >= 100)


@pytest.mark.parametrize("block", [near_dups.BLOCK, 7])
def test_rare_shingles_find_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    words = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(50):  # one to four words of each text differ, so similarities lie on both sides of 0.8
        text = list(words)
        for k in range(1 + i % 4):
            text[(i * 29 + k * 41) % 120] = f"new{i % 9}x{k}"
        rows.append((i, i, " ".join(text)))
    docs = spark.createDataFrame(rows, "uid long, doc_id long, text string")
    signed = near_dups.shingled(docs)
    weights = near_dups.shingle_weights(signed)
    texts = signed.selectExpr("uid as id", "uid % 3 as comp", "shingles")
    kept = {r.id: (r.comp, bytes(r.shingles)) for r in texts.collect()}
    pairs = [(a, b) for a in kept for b in kept if a < b and kept[a][0] != kept[b][0]]
    want = {(a, b) for a, b in pairs if near_dups.weighted_jaccard(kept[a][1], kept[b][1], weights) >= 0.8}
    found = near_dups.exact_pairs(texts, weights, 0.8)
    got = {tuple(r) for r in found.collect()}
    assert want and want <= got and len(got) < len(pairs)
    assert {tuple(r) for r in near_dups.verified(found, signed, weights, 0.8).collect()} == want


def test_a_group_is_joined_without_all_its_pairs(spark, monkeypatch):
    """120 similar texts have 7,140 links; a few rows a text join them, and texts apart stay apart."""
    words, far = [f"word{i}" for i in range(200)], [f"far{i}" for i in range(200)]
    rows = [(i, i, " ".join(words[:i] + [f"new{i}"] + words[i + 1 :])) for i in range(120)]
    rows += [(i, i, " ".join(far[: i - 60] + [f"new{i}"] + far[i - 59 :])) for i in range(120, 150)]
    signed = near_dups.shingled(spark.createDataFrame(rows, "uid long, doc_id long, text string"))
    weights, tried, verified = near_dups.shingle_weights(signed), [], near_dups.verified
    monkeypatch.setattr(near_dups, "verified", lambda pairs, *a: tried.append(pairs.count()) or verified(pairs, *a))
    # the last 10 of the group are a class already
    comps = spark.createDataFrame([(i, 110) for i in range(110, 120)], "id long, comp long")
    texts = signed.select(F.col("uid").alias("id"), "shingles").join(comps, "id", "left").selectExpr("id", "coalesce(comp, id) as comp", "shingles")
    found = {r.id: r.comp for r in near_dups.linked_by_rare(texts, comps, signed, weights, 0.8).collect()}
    assert found == {i: 0 if i < 120 else 120 for i in range(150)}
    assert 149 - 10 <= sum(tried) <= 6 * 150


def test_more_links_merge_classes(spark):
    links = [[(1, 2), (2, 3), (7, 9)], [(3, 9), (4, 5), (1, 3)], [(5, 20), (20, 21), (0, 4)]]
    frames = [spark.createDataFrame(x, "a long, b long") for x in links]
    comps = near_dups.components(frames[0])
    for k, more in enumerate(frames[1:], 2):
        comps = near_dups.merged(comps, more)
        whole = near_dups.components(spark.createDataFrame(sum(links[:k], []), "a long, b long"))
        assert sorted(map(tuple, comps.collect())) == sorted(map(tuple, whole.collect()))


def test_near_duplicate_classes_of_a_corpus(spark):
    """Classes at sf0.01 against brute force over all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.selectExpr("doc_id AS uid", "doc_id", "text")
    signed = near_dups.shingled(rows)
    weights = near_dups.shingle_weights(signed)
    texts = {r.uid: bytes(r.shingles) for r in signed.where("n > 0").collect()}
    holders = collections.defaultdict(list)
    for i, x in texts.items():
        for v in {x[k : k + 4] for k in range(0, len(x), 4)}:
            holders[v].append(i)
    shared = collections.Counter((a, b) for ids in holders.values() if len(ids) < 200 for k, a in enumerate(ids) for b in ids[k + 1 :])
    least = {i: len(x) // 4 for i, x in texts.items()}
    links = [p for p, n in shared.items() if n >= 0.3 * max(least[p[0]], least[p[1]]) and near_dups.weighted_jaccard(texts[p[0]], texts[p[1]], weights) >= 0.8]
    class_of = {r.doc_id: r.class_id for r in near_dups.near_duplicates(docs).collect()}
    found = sum(class_of[a] == class_of[b] for a, b in links)
    assert len(links) > 50 and found >= 0.99 * len(links)
    together = collections.Counter(class_of.values())
    assert sum(n - 1 for n in together.values()) <= len(links)  # nothing is joined without a link


CLASHES = ["uid", "lines", "mean", "full", "leaks", "score", "lang_pred", "rejected", "id", "n", "ids", "token_ids", "decoded", "_size", "h1"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(*r[:4], *[f"{name}!" for name in CLASHES]) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))


def same_extras(got, names=tuple(CLASHES)):
    return all(r[c] == f"{c}!" for r in got.select(*names).collect() for c in names)


def test_clashing_columns_pass_unchanged(clashing, corpus, spark):
    items = spark.createDataFrame([(None, PASSAGE), ("x", PASSAGE)], "item_id string, text string")
    for out in (
        line_dedup.dedup_lines(clashing).drop("removed_lines"),
        near_dups.without_near_duplicates(clashing),
        decontaminate.remove_leaks(clashing, items),
        mixing.mix(clashing),
    ):
        assert out.columns == clashing.columns and same_extras(out)
    names = ["_a", "_b", "_c"]
    out = language_id.identify(clashing, language_id.fitted(corpus), names)
    assert out.columns == [*clashing.columns, *names] and same_extras(out)
    leaks = decontaminate.find_leaks(clashing.select("doc_id", "text"), items).where("doc_id = 4").first().leaks
    assert leaks["items"] == ["x"] and leaks["spans"]


def test_near_duplicates_of_odd_rows(odd, empty):
    found = near_dups.near_duplicates(odd).collect()
    # three rows hold the passage and little else, two are one word, two the long text
    assert len(found) == len(ODD) and sum(r.kept for r in found) == 7
    kept = near_dups.without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert sorted(r.doc_id for r in kept.where("doc_id in (3, 6, 7)").collect()) == [3, 6]
    assert near_dups.near_duplicates(empty).count() == 0
    assert near_dups.without_near_duplicates(empty).count() == 0


# --- 10 line dedup ---------------------------------------------------------------------------


def plain_cuts(rows, least=50):
    """Lines inside any run of `least` words or more that occurs earlier; all runs are tried."""
    seen, gone = {}, collections.defaultdict(set)
    runs = []
    for n, (_, x) in enumerate(rows):
        lines = [(k, y, len(WORD.findall(y))) for k, y in enumerate(x.split("\n")) if WORD.search(y)]
        for a in range(len(lines)):
            size = 0
            for b in range(a, len(lines)):
                size += lines[b][2]
                if size >= least:
                    runs.append((n, a, tuple(y for _, y, _ in lines[a : b + 1]), [k for k, _, _ in lines[a : b + 1]]))
    for n, a, run, numbers in runs:
        if seen.setdefault(run, (n, a)) != (n, a):
            gone[n] |= set(numbers)
    return {rows[n][0]: sorted(g) for n, g in gone.items()}


def test_repeated_runs_equal_plain_search(spark, texts):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = sorted(texts.items()) + [
        (10_001, "\n".join([a, b, "solo one", c])),
        (10_002, "\n".join(["x", a, "", b, c, a, b, c])),
        (10_003, "\n".join([b, c, "y", a, b, "z"])),
        (10_004, "\n".join([a, b, c, a, b, c, a, b, c])),
        (10_005, "\n".join(["tiny"] * 300)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: list(r.removed_lines) for r in line_dedup.dedup_lines(docs).collect() if r.removed_lines}
    assert got == plain_cuts(rows)


def test_line_dedup_of_odd_rows(odd, empty):
    found = line_dedup.dedup_lines(odd)
    assert found.drop("removed_lines").columns == odd.columns
    rows = found.collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    assert by[4] == ODD[6][1] and by[5] == "other" and by[6] == LONG and by[1] == ""
    assert sorted((r.text or "") for r in rows if r.doc_id is None) == ["", "no id"]
    assert line_dedup.dedup_lines(empty).count() == 0
