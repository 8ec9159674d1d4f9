import random
from collections import Counter

import numpy as np
import pytest

from basketlens.llm import fm_dedup, phrases, prefix_free


def runs(covered):
    return int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())


def brute_bytes(texts, length):
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        c = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                c[i : i + length] = True
        out.append((bytes(np.frombuffer(t, np.uint8)[~c]), runs(c)))
    return out


def test_phrase_borders_depend_on_content():
    r = np.random.default_rng(1)
    passage = r.integers(0, 50, 4000)
    a, b = np.concatenate([r.integers(0, 50, 300), passage]), np.concatenate([r.integers(0, 50, 77), passage, r.integers(0, 50, 50)])
    cut = lambda x, at: {(f - at, last - at) for f, last, _ in zip(*phrases.phrases(x, 200, 32)) if at + 400 < f and last < at + 3400}
    assert cut(a, 300) == cut(b, 77)


def test_long_sequences_in_chunks(monkeypatch):
    x = np.random.default_rng(2).integers(0, 9, 5000)
    whole = phrases.phrases(x, 50, 8)
    monkeypatch.setattr(phrases, "CHUNK", 333)
    for a, b in zip(whole, phrases.phrases(x, 50, 8)):
        assert a.tolist() == b.tolist()


@pytest.mark.parametrize("letters", [b"ab", b"abcdefgh", bytes(range(255))])
def test_corpus_order_finds_repeats(letters):
    r = random.Random(5)
    for _ in range(40):
        length = r.choice([3, 8, 12, 20])
        base = bytes(r.choice(letters) for _ in range(120))
        texts = set()
        for _ in range(r.randint(1, 10)):
            a = r.randint(0, 90)
            texts.add(bytes(r.choice(letters) for _ in range(r.randint(0, 9))) + base[a : a + r.randint(length, 60)] + bytes(r.choice(letters) for _ in range(r.randint(0, 9))))
        texts = [t for t in texts if len(t) >= length]
        if not texts:
            continue
        n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        expected = [[i for i in range(len(t) - length + 1) if n[t[i : i + length]] > 1] for t in texts]
        got = prefix_free.repeated_windows(texts, np.array([len(t) - length + 1 for t in texts]), length)
        assert [x.tolist() for x in got] == expected


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_substrings_against_brute_force(docs, rows, crowd):
    texts = [(t or "").encode() for _, t, *_ in rows]
    expected = sorted((i is None, i or 0, len(t), k, n) for (i, *_), t, (k, n) in zip(rows, texts, brute_bytes(texts, 200)))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], bytes(r["kept"]), len(r["runs"])) for r in prefix_free.strip(docs, crowd=crowd).collect())
    assert got == expected


def crowded_texts(r, n, sizes):
    """Texts that share an anchor's gram and differ around it, and some that share windows."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    middle = [word() for _ in range(40)]
    texts = []
    for k in range(n):
        a, b = r.choice(sizes), r.choice(sizes)
        texts.append(" ".join([*(word() for _ in range(60)), *middle[20 - a : 20 + b], *(word() for _ in range(60))]))
    return texts


@pytest.mark.parametrize("crowd", [20_000, 3, 1])
def test_crowds_are_split_without_loss(spark, crowd):
    r = random.Random(8)
    texts = crowded_texts(r, 30, (4, 10, 20)) + crowded_texts(r, 6, (20,)) * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    raw = [t.encode() for t in texts]
    got = {x["doc_id"]: (bytes(x["kept"]), len(x["runs"])) for x in prefix_free.strip(docs, length=60, crowd=crowd).collect()}
    assert got == dict(enumerate(brute_bytes(raw, 60)))
    least, split = {}, [t.split() for t in raw]
    for i, w in enumerate(split):
        for j in range(len(w) - 19):
            least.setdefault(tuple(w[j : j + 20]), i)
    expected = {}
    for i, w in enumerate(split):
        gone = {j + k for j in range(len(w) - 19) if least[tuple(w[j : j + 20])] < i for k in range(20)}
        expected[i] = b" ".join(x for j, x in enumerate(w) if j not in gone)
    assert {x["doc_id"]: bytes(x["kept"]) for x in fm_dedup.strip(docs, length=20, crowd=crowd).collect()} == expected


def test_very_long_repetitive_texts(spark):
    docs = spark.createDataFrame([(1, "x" * 400_000), (2, "ab " * 100_000), (3, "y" * 150)], "doc_id bigint, text string")
    got = {x["doc_id"]: (x["n_bytes"], len(x["kept"])) for x in prefix_free.strip(docs).collect()}
    assert got == {1: (400_000, 0), 2: (300_000, 0), 3: (150, 150)}


def test_clean_keeps_columns_and_whole_characters(docs, rows):
    got = prefix_free.clean(docs)
    assert got.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in got.collect()}
    assert left[3] is None and left[4] == "" and left[6] == "één woord" and 1 not in left and 2 not in left


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_words_against_brute_force(docs, rows, crowd):
    least = {}
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in split:
        for j in range(len(w) - 49):
            if i is not None:
                key = tuple(w[j : j + 50])
                least[key] = min(least.get(key, i), i)
    expected = []
    for i, w in split:
        c = np.zeros(len(w), bool)
        for j in range(len(w) - 49):
            if i is not None and least[tuple(w[j : j + 50])] < i:
                c[j : j + 50] = True
        expected.append((i is None, i or 0, len(w), b" ".join(x for x, y in zip(w, c) if not y)))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], bytes(r["kept"])) for r in fm_dedup.strip(docs, crowd=crowd).collect()]
    assert sorted(got) == sorted(expected)


def test_index_interval_documents():
    r = random.Random(3)
    for _ in range(60):
        length, letters = r.choice([3, 5]), r.choice([2, 30])
        base = [b"%d" % r.randint(0, letters) for _ in range(60)]
        seqs = set()
        for _ in range(r.randint(1, 10)):
            a = r.randint(0, 50)
            s = (*(b"%d" % r.randint(0, letters) for _ in range(r.randint(0, 5))), *base[a : a + r.randint(length, 30)])
            if len(s) >= length:
                seqs.add(s)
        if not seqs:
            continue
        seqs, docs = list(seqs), None
        docs = np.array([r.randint(0, 6) for _ in seqs])
        least = {}
        for s, d in zip(seqs, docs):
            for i in range(len(s) - length + 1):
                least[s[i : i + length]] = min(least.get(s[i : i + length], 99), d)
        expected = [[i for i in range(len(s) - length + 1) if least[s[i : i + length]] < d] for s, d in zip(seqs, docs)]
        assert [x.tolist() for x in fm_dedup.shared_windows(seqs, docs, length)] == expected


def test_empty_tables(nothing):
    assert prefix_free.strip(nothing).count() == prefix_free.clean(nothing).count() == fm_dedup.strip(nothing).count() == 0




def test_least_of_ranges():
    r = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        v = r.integers(0, 50, n).astype(np.int32)
        lo = r.integers(0, n, 400)
        hi = lo + 1 + (r.random(400) * (n - lo)).astype(int)
        hi = np.minimum(hi, n)
        assert fm_dedup.Least(v).find(lo, hi).tolist() == [v[a:b].min() for a, b in zip(lo, hi)]


def test_matching_statistics_against_brute_force():
    r = random.Random(6)
    for _ in range(40):
        seqs = [np.array([r.randint(1, 4) for _ in range(r.randint(3, 30))], np.int32) for _ in range(r.randint(1, 6))]
        index = fm_dedup.FMIndex(seqs, np.arange(len(seqs)))
        stream = np.array([r.randint(1, 4) for _ in range(40)], np.int32)
        last = np.arange(7, 40)
        joined = ["".join(map(str, s)) for s in seqs]
        times = lambda x: sum(s.startswith(x, i) for s in joined for i in range(len(s)))
        known = [c for c in range(1, 5) if any((s == c).any() for s in seqs)]
        if known != [1, 2, 3, 4]:
            continue
        text = "".join(map(str, stream))
        expected = [max(k for k in range(9) if k == 0 or (k <= 8 and times(text[e + 1 - k : e + 1]) > 1)) for e in last]
        assert index.matching(stream, last, 8)[0].tolist() == expected
