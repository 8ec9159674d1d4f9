import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import same
from tokenizers import Tokenizer

import corpus_pipeline
from basketlens.llm import quality_rules, queries, url_reputation

PAGES = [
    (1, "http://Blog.Example.COM/en/1?x#y", "blog.example.com", "/en/1", "example.com/en/", "block"),
    (2, "https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    (3, "https://example.com", "example.com", "", None, "allow"),
    (4, "ftp://a.com?q=/en/", "a.com", "", None, "allow"),
    (5, None, "", "", None, "allow"),
    (6, "a.net/es/1", "", "", None, "allow"),
    (7, "x://y.net/es/1://z", "y.net", "/es/1://z", "net/es/", "block"),
    (8, "x://planet/es/1", "planet", "/es/1", None, "allow"),
    (9, "http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    (9, "http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    (10, "", "", "", None, "allow"),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "!") for i, u, *_ in PAGES], "page_id bigint, url string, bad string")
    none = spark.createDataFrame([], "page_id bigint, bad int")
    got = url_reputation.judge(pages, none, queries.URL_RULES).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *rest)) for i, _, *rest in PAGES)
    assert url_reputation.judge(pages.limit(0), none, queries.URL_RULES).count() == 0


def test_reputation_shrinks(spark):
    hosts = spark.createDataFrame([("a.spam.org", 40, 40), ("b.spam.org", 1, 1), ("c.good.org", 50, 1), ("d.good.org", 1, 1), ("e.org", 60, 2), ("f.new.org", None, None)], "host string, n long, k long")
    r = {x["host"]: x for x in url_reputation.reputations(hosts).collect()}
    assert r["a.spam.org"]["bad_rate_low"] > 0.5 > r["d.good.org"]["bad_rate_low"]
    assert r["b.spam.org"]["bad_rate"] > r["d.good.org"]["bad_rate"] and 0 < r["f.new.org"]["bad_rate"] < 1


def test_blocked_by_outcomes(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 40 else 'good'}.site{'a' if i < 40 else 'b'}.org/{i}") for i in range(90)] + [(99, "http://bad.sitea.org/new")], "page_id bigint, url string")
    outcomes = spark.createDataFrame([(i, int(i < 40)) for i in range(90)] + [(5, None)], "page_id bigint, bad int")
    got = {r["page_id"]: r["verdict"] for r in url_reputation.judge(pages, outcomes, []).collect()}
    assert got[99] == "block" and got[3] == "block" and got[60] == "allow"


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            assert 0.5 * n < docs.count() <= n
    assert docs.count() > 0 and {"sequence_id", "offset", "length"} <= set(docs.columns)


def test_pipeline_on_edges(spark, rows, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert {1, 7, 10} <= {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}


def brute_rules(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    grams = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    hit = {i + k for i in range(n - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    if n < 50 or 100 * len(hit) > 50 * n:
        return False
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    symbols = sum(c in "#*$%&|<>" for c in text) / n
    stops = sum(w.lower() in set(quality_rules.STOP_WORDS) for w in words) / n
    return 2 <= sum(map(len, words)) / n <= 14 and symbols <= 0.1 and text.count("!") / n <= 0.3 and (stops >= 0.04 or symbols <= 0.03) and (len(lines) - len(set(lines))) / len(lines) <= 0.4


def shingled(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def without_repeats(texts):
    raw = [t.encode() for t in texts]
    n = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if n[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept, run = [], bytearray()
        for b, g in zip(t, gone):
            if g:
                kept.append(bytes(run).decode(errors="ignore"))
                run = bytearray()
            else:
                run.append(b)
        out.append("".join([*kept, bytes(run).decode(errors="ignore")]))
    return out


def holds(text, item):
    words = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", t.lower()).split()
    a, b = words(item), words(text)
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best / (2 * len(a)) >= 0.45


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, by plain versions of all five."""
    r = random.Random(4)
    word = lambda: r.choice(("the", "of", "and")) if r.random() < 0.2 else f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randint(0, 3000)}"
    draw = lambda n: " ".join(word() for _ in range(n))
    base, shared, item = draw(150), draw(70), draw(25)
    edited = base.split()
    edited[75] = "changed"
    texts = [None, "", draw(20), "word " * 80, draw(60).replace(" ", " ### "), base, base, " ".join(edited), f"{draw(90)} {shared}", f"{shared} été {draw(80)}", f"{draw(60)} {item} {draw(60)}", draw(2500), shared, *(draw(70) for _ in range(8))]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), dict(enumerate(texts))
    got = lambda df: {x["doc_id"]: x["text"] for x in df.collect()}
    stages = dict(corpus_pipeline.STAGES)

    docs = stages["quality_rules"](spark, docs, folder)
    expected = {i: t for i, t in kept.items() if brute_rules(t)}
    assert got(docs) == expected and 8 < len(expected) < len(texts)

    docs = stages["simhash_near_dedup"](spark, docs, folder)
    left = got(docs)
    close = [(i, j) for i in expected for j in expected if i < j and len(shingled(expected[i]) & shingled(expected[j])) / len(shingled(expected[i]) | shingled(expected[j])) >= 0.8]
    assert close and len({5, 6, 7} & set(left)) == 1 and set(left) >= set(expected) - {5, 6, 7}

    docs = stages["suffix_array_dedup"](spark, docs, folder)
    clean = dict(zip(left, without_repeats(left.values())))
    expected = {i: t for i, t in clean.items() if t.strip()}
    assert got(docs) == expected and expected != left
    assert all(x["n_chars"] == len(x["text"]) for x in docs.collect())

    docs = stages["benchmark_decontamination"](spark, docs, folder)
    assert got(docs) == {i: t for i, t in expected.items() if not holds(t, item)} and 10 not in got(docs) and 10 in expected

    pieces = stages["best_fit_packing"](spark, docs, folder).collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    cut = []
    for i, t in got(docs).items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        cut += [(i, k, 2048 * k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids[a : a + 2048] for a in range(0, len(ids), 2048))]
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in pieces) == sorted(cut)
    fill = Counter()
    for x in pieces:
        fill[x["sequence_id"]] += x["length"]
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(fill.values()) // 2048)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "ids_crc32").collect())) == sorted((x["doc_id"], x["piece"], x["ids_crc32"]) for x in pieces)


def test_very_long_and_repeated_urls(spark):
    long = "https://" + "a." * 20_000 + "example.com/en/" + "x" * 100_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, "://"), (3, "http://user@h.co.uk:80")], "page_id bigint, url string")
    got = url_reputation.judge(pages, spark.createDataFrame([(1, 1), (1, 1)], "page_id bigint, bad int"), queries.URL_RULES).collect()
    assert len(got) == 4 and {r["rule"] for r in got if r["page_id"] == 1} == {"example.com/en/"} and {r["host"] for r in got if r["page_id"] == 2} == {""}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    same(queries.QUERIES[name](spark, sf), sf, queries.ORACLE_SQL[name])
