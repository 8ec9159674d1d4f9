import math
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketlens.llm import decontaminate, language_id, maxent_lm, quality_ranker, quality_rules, queries

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = queries.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.98


def test_language_edges(docs, nothing):
    model = language_id.learn(docs, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[1][0] == "en" and 0 <= got[7][1] <= 1
    empty = language_id.learn(nothing, F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(nothing, model).count() == 0


def test_language_needs_a_letter(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "½ ² ① Ⅷ", "en"), (2, "the words", "en"), (3, "ª", "fr"), (4, "les mots", "fr")], "doc_id int, text string, lang string")
    model = language_id.learn(docs, F.lit(True))
    whole = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    assert whole[1] == ("und", 0.0) and whole[2][0] == "en" and whole[3][0] == whole[4][0] == "fr"
    monkeypatch.setattr(language_id, "GATHERED", 5)  # lots that cut through texts
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    assert got.keys() == whole.keys() and all(got[k][0] == whole[k][0] and abs(got[k][1] - whole[k][1]) < 1e-9 for k in whole)
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language_id.learn(docs, F.lit(True))


def test_language_against_brute_force(spark):
    """Posteriors of a naive Bayes model counted n-gram by n-gram."""
    rows = [(1, "das ist ein Haus", "de"), (2, "this is a house", "en"), (3, "this is it", "en"), (4, "ist das it", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")

    def cells(t):
        out = []
        for _, parts, own in language_id.chunks([t]):
            for b, ok in language_id.buckets(parts, own):
                out += b[ok].tolist()
        return out

    counts = {x: Counter(c for _, t, lang in rows if lang == x for c in cells(t)) for x in ("de", "en")}
    logs = []
    for x, prior in (("de", 1 / 3), ("en", 2 / 3)):
        total = sum(counts[x].values())
        logs.append(math.log(prior) + sum(math.log((counts[x][c] + 0.5) / (total + 0.5 * (1 << language_id.BITS))) for c in cells("ist das it")))
    p = 1 / (1 + math.exp(min(logs) - max(logs)))
    got = language_id.predict(docs, language_id.learn(docs, F.lit(True))).where("doc_id = 4").first()
    assert got["lang_pred"] == ("de" if logs[0] > logs[1] else "en") and abs(got["score"] - p) < 1e-4


def test_quality_is_reproducible_and_ties_score_alike(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)], "doc_id bigint, quality int")
    one = quality_ranker.learn(docs, labels)
    two = quality_ranker.learn(docs.repartition(7), labels.repartition(5))
    assert np.array_equal(one.weights, two.weights) and one.threshold == two.threshold
    by_text = {}
    for r in quality_ranker.score(docs, one).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        by_text.setdefault(r["text"], set()).add(r["score"])
    assert all(len(x) == 1 for x in by_text.values())


def test_pairwise_loss_is_at_its_least():
    """No small step from the learned weights lowers the mean logistic loss of the pairs."""
    r = np.random.default_rng(2)
    x = r.normal(size=(400, quality_ranker.SIZE))
    good = x[:, 0] + 0.5 * x[:, 20] + r.normal(size=400) > 0
    ranker = quality_ranker.Ranker(x, good, pairs=3000)
    z, draw = ranker.squash(x), np.random.default_rng(17)
    d = z[draw.choice(np.flatnonzero(good), 3000)] - z[draw.choice(np.flatnonzero(~good), 3000)]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + 0.5e-3 * (w @ w)
    best = loss(ranker.weights)
    assert all(loss(ranker.weights + 1e-2 * r.normal(size=d.shape[1])) >= best for _ in range(50))
    share = (ranker.score(x) >= 0.7).mean()
    assert abs(share - good.mean()) < 0.01


def test_long_text_scored_whole(monkeypatch):
    text = "abc def " * 50
    count = lambda: sum(int(ok.sum()) for _, parts, own in language_id.chunks([text]) for _, ok in language_id.buckets(parts, own, 12))
    whole = count()
    monkeypatch.setattr(language_id, "CHUNK", 37)
    assert count() == whole == 3 * (len(text) + 2) - 3


def test_quality_held_out_accuracy(spark):
    got = queries.op3_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.93


def test_quality_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (8, 1), (9, 1), (11, 0), (13, 0), (7, None)], "doc_id bigint, quality int")
    ranker = quality_ranker.learn(docs, labels)
    rows = quality_ranker.score(docs, ranker).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    one = quality_ranker.score(docs, quality_ranker.learn(docs, labels.where("quality = 1"))).collect()
    assert {r["predicted"] for r in one} == {1}
    none = quality_ranker.score(docs, quality_ranker.learn(docs, labels.limit(0))).collect()
    assert {r["predicted"] for r in none} == {0}
    assert quality_ranker.score(nothing, ranker).count() == 0


def brute_rules(t):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w]
    n = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if n[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    symbols = sum(c in "#*$%&|<>" for c in t or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def test_rules_against_brute_force(docs, rows):
    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    got = quality_rules.judge(docs).select("doc_id", *[f"rules_measures.{x}" for x in fields], "base_failed").collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, ((i, *brute_rules(t)) for i, t, *_ in rows)))
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])


def test_rules_keep(docs, nothing):
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 7, 8, 9, 10}
    assert not {3, 4, 5, 6, 11, 13} & {r["doc_id"] for r in kept.collect()}
    assert quality_rules.keep(nothing).count() == 0


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_against_brute_force():
    r = np.random.default_rng(1)
    a = [r.integers(1, 5, r.integers(1, 12)).astype(np.int32) for _ in range(200)]
    b = [r.integers(0, 5, r.integers(1, 30)).astype(np.int32) for _ in range(200)]
    assert decontaminate.align(a, b)[0].tolist() == [smith_waterman(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize("scale", [1, 1_000_000])
def test_seeds_lose_nothing_however_large_the_corpus(scale):
    r = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(400)]
    chance = 1 / np.arange(1, 401)
    draw = lambda n: [vocabulary[k] for k in r.choice(400, n, p=chance / chance.sum())]
    items = [draw(int(n)) for n in r.integers(8, 40, 40)]
    block = decontaminate.Items(list(range(len(items))), [" ".join(x).encode() for x in items])
    texts = []
    for k, item in enumerate(items):
        every = 2 + k % 4
        edits = (lambda i, w: [f"x{i}"], lambda i, w: [], lambda i, w: [w, f"x{i}"], lambda i, w: [w, "x", "y"])[k // 4 % 4]
        copy = [y for i, w in enumerate(item) for y in (edits(i, w) if i % every == 0 else [w])]
        texts.append(" ".join(draw(30) + copy + draw(30)).encode())
    ids, starts = block.ids(texts)
    counts = np.bincount(ids, minlength=len(block.number) + 1) * scale
    block.seed(counts, int(counts.sum()), 0.01, 0.45)
    got = {(t, i): round(s, 6) for t, i, s, *_ in decontaminate.matches(block, texts, 0.45)}
    ends = np.append(starts[1:], ids.size) - 1
    expected = {}
    for t in range(len(texts)):
        score, _ = decontaminate.align(block.items, [ids[starts[t] : ends[t]]] * len(items))
        expected |= {(t, i): round(s / (2 * block.items[i].size), 6) for i, s in enumerate(score.tolist()) if s / (2 * block.items[i].size) >= 0.45}
    assert got == expected and sum(t == i for t, i in got) > 25


def test_decontamination(spark, docs, nothing):
    item = "Which of the green rivers, if any, flows past seven old mills before noon on Tuesday?"
    edited = item.replace("green", "blue").replace("if any, ", "").replace("old", "very old").upper()
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item)], "item_id bigint, text string")
    more = spark.createDataFrame([(50, f"so it began. {item} and went on"), (51, edited), (52, "green rivers and old mills"), (53, item[:30])], "doc_id bigint, text string")
    all_ = docs.select("doc_id", "text").unionByName(more)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(all_, items).collect()} == {(50, 1), (51, 1)}
    assert {r["doc_id"] for r in all_.collect()} - {r["doc_id"] for r in decontaminate.drop(all_, items).collect()} == {50, 51}
    assert decontaminate.find(all_, items.limit(0)).count() == decontaminate.find(nothing, items).count() == 0
    assert decontaminate.drop(docs, items).columns == docs.columns


def test_find_takes_any_keys_and_names(spark, docs):
    """Items keyed by an int, by a string, by the documents' own key name, and by nulls; columns with clashing names."""
    item = "Which of the green rivers, if any, flows past seven old mills before noon on Tuesday?"
    more = spark.createDataFrame([(50, f"so it began. {item} and went on"), (None, item)], "doc_id bigint, text string")
    all_ = docs.unionByName(more, allowMissingColumns=True)
    for kind, value in (("int", 7), ("string", "x"), ("bigint", None)):
        items = spark.createDataFrame([(value, item), (value, item), (value, "no such words stand anywhere in these few documents")], f"item_id {kind}, text string")
        got = decontaminate.find(all_, items)
        assert got.columns == ["doc_id", "item_id", "score", "first_word", "end_word"]
        assert sorted(map(str, ((r["doc_id"], r["item_id"]) for r in got.collect()))) == sorted(map(str, [(50, value)] * 2 + [(None, value)] * 2))
    same = decontaminate.find(all_, items.withColumnRenamed("item_id", "doc_id"), item_key="doc_id")
    assert same.columns[:2] == ["doc_id", "item_doc_id"] and same.count() == 4


def test_find_against_brute_force(spark):
    """Every item with every whole document by Smith-Waterman, on generated copies with edits."""
    r = np.random.default_rng(4)
    draw = lambda n: [f"w{k}" for k in r.zipf(1.3, n) % 3000]
    items = [draw(int(n)) for n in r.integers(8, 40, 12)]
    texts = []
    for k, item in enumerate(items):
        copy = [w if r.random() > 0.2 else f"e{k}" for w in item]
        texts += [draw(60) + copy + draw(60), draw(100)]
    number = {w: i + 1 for i, w in enumerate(sorted({w for x in items for w in x}))}
    ids = lambda words: np.array([number.get(w, 0) for w in words], np.int32)
    expected = set()
    for t, words in enumerate(texts):
        score, _ = decontaminate.align([ids(x) for x in items], [ids(words)] * len(items))
        expected |= {(t, i) for i, s in enumerate(score.tolist()) if s / (2 * len(items[i])) >= 0.45}
    docs = spark.createDataFrame([(t, " ".join(x)) for t, x in enumerate(texts)], "doc_id bigint, text string")
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.find(docs, table).collect()} == expected and len(expected) >= 10


@pytest.mark.parametrize("size", [12_000_000, 2_000])
def test_base_score_against_brute_force(docs, rows, monkeypatch, size):
    monkeypatch.setattr(maxent_lm, "BLOCK_BYTES", size)
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    split = [(i, (t or "").encode().lower().split() + [None]) for i, t, *_ in rows]
    c = Counter(w for i, ws in split if train(i) for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in split)
    column = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))
    got = maxent_lm.score(docs, column).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expected
    assert all(r["score"] < 0 for r in got)


def brute_score(learner, counts, texts):
    """Log10 probability of each text, token by token, from the weights and the counts of training tokens."""
    in_leaf, kinds = Counter(), Counter()
    keys = list(counts)
    for key, at in zip(keys, maxent_lm.key_leaves(pa.array([maxent_lm.word_key(k) for k in keys], pa.binary())).tolist()):
        in_leaf[at] += counts[key]
        kinds[at] += counts[key] > 0
    out = []
    for t in texts:
        words = [*t.lower().split(), b""]
        keys = pa.array([b"", b"", *map(maxent_lm.word_key, words)], pa.binary())
        ending, hashed = maxent_lm.hashes(keys)
        path, total = maxent_lm.paths(ending[2:], hashed[2:]), 0.0
        for level, rows in enumerate(maxent_lm.contexts(ending, hashed, path)):
            for i, y in enumerate(path[level].tolist()):
                z = learner.prior[level][rows[-1, i]] + sum(learner.w[level][r].astype(float) for r in rows[:-1, i])
                total += z[y] - math.log(np.exp(z).sum())
        for w, at in zip(words, maxent_lm.leaf(path).tolist()):
            total += math.log((counts.get(w, 0) + 1) / (in_leaf[at] + kinds[at] + 1))
        out.append(total / math.log(10))
    return out


def rows_of(tokens):
    (_, ending, word), = tokens.lots()
    path = maxent_lm.paths(ending[2:], word[2:])
    return path, maxent_lm.contexts(ending, word, path)


def test_tokens_and_class_probabilities():
    texts = ["the cat\x0bsat", None, " on \t the MAT été " + "x" * 50 + "\n"]
    tokens = maxent_lm.Tokens(pa.array(texts))
    long = maxent_lm.word_key(b"x" * 50)
    assert [tokens.keys[i].as_py() for i in tokens.at] == [b"the", b"cat", b"sat", b"", b"", b"on", b"the", b"mat", "été".encode(), long, b""]
    assert tokens.begin.tolist() == [0, 4, 5, 11]
    learner = maxent_lm.Learner([np.zeros(x, np.float32) for x in maxent_lm.shapes()], maxent_lm.priors(np.arange(maxent_lm.LEAVES) % 7))
    path, rows = rows_of(tokens)
    own = lambda: sum(maxent_lm.token_logs(w, q, r, y).sum() for w, q, r, y in zip(learner.w, learner.prior, rows, path))
    before = own()
    for _ in range(5):
        learner.learn(tokens)
    for w, q, r, y in zip(learner.w, learner.prior, rows, path):
        logs = maxent_lm.class_logs(w, q, r)
        assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-5)
        assert np.allclose(logs[np.arange(y.size), y], maxent_lm.token_logs(w, q, r, y), atol=1e-5)
    assert own() > before
    assert maxent_lm.key_leaves(tokens.keys)[tokens.at].tolist() == maxent_lm.leaf(path).tolist()


def test_tokens_hold_few_bytes_each():
    texts = pa.array(["a b c " * 50_000, " d  e\n", "f g " * 50_000])
    tracemalloc.start()
    tokens = maxent_lm.Tokens(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.diff(tokens.begin).tolist() == [150_001, 3, 100_001] and peak < 16 * tokens.at.size


def test_lots_cut_anywhere(monkeypatch):
    tokens = maxent_lm.Tokens(pa.array(["a b c d e f g", "", "h i j"]))
    _, whole = rows_of(tokens)
    monkeypatch.setattr(maxent_lm, "LOT", 3)
    parts = [maxent_lm.contexts(e, w, maxent_lm.paths(e[2:], w[2:])) for _, e, w in tokens.lots()]
    for level, rows in enumerate(whole):
        assert np.array_equal(rows, np.concatenate([p[level] for p in parts], axis=1))


def test_gradient_against_brute_force():
    """One step from zero: the weights of a row move against the sum of its tokens' gradients, scaled by AdaGrad."""
    tokens = maxent_lm.Tokens(pa.array(["a b a b c", "b a"]))
    learner = maxent_lm.Learner([np.zeros(x, np.float32) for x in maxent_lm.shapes()], [np.zeros((math.prod(maxent_lm.LEVELS[:k]), n), np.float32) for k, n in enumerate(maxent_lm.LEVELS)])
    learner.learn(tokens)
    path, rows_ = rows_of(tokens)
    for level, rows in enumerate(rows_):
        size = maxent_lm.LEVELS[level]
        for r in set(rows[:-1].ravel().tolist()):
            g = sum(1 / size - (np.arange(size) == y) for of in rows[:-1] for x, y in zip(of.tolist(), path[level].tolist()) if x == r)
            assert np.allclose(learner.w[level][r], -learner.rate * g / np.sqrt(1 + g**2), atol=1e-5)


def test_key_hashes_are_crc32():
    words = ["", "a", "é", "x" * 40, "y" * 41, "日" * 30, *(f"w{i}" * (i % 9 + 1) for i in range(500))]
    keys = pa.array([b"before", *(maxent_lm.word_key(w.encode()) for w in words)], pa.binary())
    assert maxent_lm.hashes(keys[1:])[1].tolist() == [0 if w == "" else max(1, zlib.crc32(w.encode())) for w in words]
    assert [len(x) for x in maxent_lm.hashes(keys[:0])] == [0, 0]


def plain_step(learner, level, rows, target):
    """Learner.step by plain indexing, sums along rows, and a sort."""
    w, size = learner.w[level], maxent_lm.ROWS[level]
    g = np.empty((target.size, maxent_lm.LEVELS[level]), np.float32)
    for i in range(0, target.size, maxent_lm.STEP):
        own = rows[:, i : i + maxent_lm.STEP]
        p = np.exp(learner.prior[level][own[-1]] + sum(w[r] for r in own[:-1]))
        g[i : i + maxent_lm.STEP] = p / p.sum(axis=1, keepdims=True)
    g[np.arange(target.size), target] -= 1
    for f in range(maxent_lm.features(level)):
        at = (rows[f] - f * size).astype(np.uint16)
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order].astype(int), prepend=-1))
        step, met = np.add.reduceat(g[order], first, axis=0), at[order][first].astype(int) + f * size
        learner.seen[level][met] += np.diff(np.append(first, target.size))
        learner.square[level][met] += step**2
        w[met] -= learner.rate * step / np.sqrt(learner.square[level][met])


def plain_logs(w, prior, rows, target):
    out = []
    for i in range(0, target.size, maxent_lm.STEP):
        own, y = rows[:, i : i + maxent_lm.STEP], target[i : i + maxent_lm.STEP]
        z = prior[own[-1]] + sum(w[r] for r in own[:-1])
        out.append(z[np.arange(y.size), y] - np.log(np.exp(z).sum(axis=1)))
    return np.concatenate(out)


def test_model_equals_the_plain_form_in_less_cpu_time():
    draw = np.random.default_rng(5)
    words = [f"w{i:x}"[::-1] for i in range(20_000)]
    tokens = maxent_lm.Tokens(pa.array([" ".join(words[i] for i in draw.zipf(1.3, 120_000) % len(words))]))
    path, rows = rows_of(tokens)
    prior = maxent_lm.priors(np.bincount(maxent_lm.leaf(path), minlength=maxent_lm.LEAVES))
    ours, plain = (maxent_lm.Learner([np.zeros(x, np.float32) for x in maxent_lm.shapes()], prior) for _ in range(2))
    took = {k: [] for k in ("step", "plain step", "logs", "plain logs")}

    def timed(kind, f, *args):
        before = time.process_time()
        out = f(*args)
        took[kind].append(time.process_time() - before)
        return out

    for _ in range(3):
        for level, (r, y) in enumerate(zip(rows, path)):
            timed("step", ours.step, level, r, y)
            timed("plain step", plain_step, plain, level, r, y)
            got = timed("logs", maxent_lm.token_logs, ours.w[level], prior[level], r, y)
            assert np.allclose(got, timed("plain logs", plain_logs, plain.w[level], prior[level], r, y), atol=1e-3)
    for level in range(len(path)):
        assert np.allclose(ours.w[level], plain.w[level], atol=1e-3)
        assert np.array_equal(ours.seen[level], plain.seen[level])
    least = {k: sum(min(x[level :: len(path)]) for level in range(len(path))) for k, x in took.items()}
    assert least["step"] < 0.7 * least["plain step"] and least["logs"] < 0.7 * least["plain logs"], least


@pytest.mark.parametrize("size", [12_000_000, 2_000])
def test_score_against_brute_force(docs, rows, monkeypatch, size):
    monkeypatch.setattr(maxent_lm, "BLOCK_BYTES", size)
    some = docs.where("doc_id <> 7 or doc_id is null")
    column = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))
    got = {r["key_"]: r["score"] for r in maxent_lm.score(some, column).withColumn("key_", F.col("doc_id").cast("string")).collect()}
    kept = [(i, (t or "").encode()) for i, t, *_ in rows if i != 7]
    counts = Counter(w for i, t in kept if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.lower().split(), b""])
    leaves = np.zeros(maxent_lm.LEAVES, np.int64)
    np.add.at(leaves, maxent_lm.key_leaves(pa.array([maxent_lm.word_key(k) for k in counts], pa.binary())), list(counts.values()))
    prior = maxent_lm.priors(leaves)
    learner = maxent_lm.Learner(maxent_lm.train(some.where(column), prior), prior)
    for (i, _), s in zip(kept, brute_score(learner, counts, [t for _, t in kept])):
        assert abs(got[None if i is None else str(i)] - s) < 1e-3 * max(1, abs(s)), i


def test_model_beats_base_held_out(spark):
    r = queries.op4_lm_score(spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_lm_empty(nothing):
    assert maxent_lm.score(nothing, F.lit(True)).count() == 0
