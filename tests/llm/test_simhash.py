import numpy as np
import pytest
import xxhash

from basketlens.llm import components, simhash


def sets_of(n, linked):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_index_against_brute_force():
    r = np.random.default_rng(3)
    for _ in range(60):
        n, most = int(r.integers(2, 300)), int(r.integers(1, 9))
        base = r.integers(0, 2**63, max(1, n // 20), dtype=np.uint64)
        fp = base[r.integers(0, base.size, n)]
        for _ in range(int(r.integers(0, 7))):
            fp = fp ^ np.where(r.random(n) < 0.5, np.uint64(1) << r.integers(0, 64, n).astype(np.uint64), np.uint64(0))
        fp = np.unique(fp)
        bucket = np.sort(r.integers(0, 4, fp.size))
        index = simhash.GrayIndex(bucket, fp)
        x, b = index.fp, bucket[index.order]
        close = [(i, j) for i in range(x.size) for j in np.flatnonzero((np.bitwise_count(x ^ x[i]) <= most) & (b == b[i]))]
        assert index.joined(most).root.tolist() == sets_of(x.size, close)


def test_fingerprint():
    assert simhash.fingerprint(b" \n", 4) == 0
    assert simhash.fingerprint(b"A b", 4) == xxhash.xxh64_intdigest(b"a b", 42)
    h = [xxhash.xxh64_intdigest(x, 42) for x in (b"a b c d", b"b c d a", b"c d a b", b"d a b c", b"a b c d")]
    expected = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    assert simhash.fingerprint(b"a b c d a b c d", 4) == expected


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (3, 10), (5, 5), (2, 1)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components.stars(df).collect()}
    assert got == {2: 1, 3: 1, 10: 1, 9: 8} | {101 + i: 100 for i in range(40)}


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_groups_against_brute_force(docs, rows, crowd):
    fp = [simhash.fingerprint((t or "").encode(), 4) for _, t, *_ in rows]
    close = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    root = sets_of(len(fp), close)
    least = {}
    for (i, *_), x in zip(rows, root):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    expected = sorted((str(i), f"{f:016x}", str(least.get(x))) for (i, *_), f, x in zip(rows, fp, root))
    found = simhash.near_groups(simhash.fingerprints(docs, 4), 4, crowd=crowd)
    got = found.select("doc_id", simhash.hexadecimal(found["fp"]).alias("f"), "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == expected


def test_keep_one(spark, docs):
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    left = sorted(str(r["doc_id"]) for r in got.collect())
    # 2 copies 1; 10 is a repeated row; 3, 4 and 5 have no words, and one of them stays
    assert left == sorted(map(str, [1, 3, 6, 7, 8, 9, None, 10, 11, 12, 13]))


def test_keep_one_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    edited = lambda *at: " ".join("zz%d" % i if i in at else w for i, w in enumerate(words))
    rows = [(1, edited()), (2, edited(50)), (3, edited(120, 180)), (4, " ".join(reversed(words))), (5, edited(*range(0, 200, 10)))]
    left = {r[0] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id").collect()}
    assert {4, 5} <= left and len(left & {1, 2, 3}) == 1


def jaccard(a, b, width=5):
    grams = lambda t: {tuple(w[i : i + width]) for w in [t.lower().split()] for i in range(max(1, len(w) - width + 1))}
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def check_kept(spark, texts, least=0.8, **how):
    """No two that stay are similar, and each that goes is joined with one that stays by similar pairs."""
    got = [r[0] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3), **how).select("doc_id").collect()]
    left = set(got)
    assert len(left) == len(got)
    close = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= least]
    assert not [x for x in close if left.issuperset(x)]
    root = sets_of(len(texts), close)
    assert {root[i] for i in left} == set(root)
    return left


@pytest.mark.parametrize("how", [{}, {"near": 2}, {"near": 2, "most": 0}])
def test_keep_one_against_brute_force(spark, how):
    """Groups with several leaders, chains, families of dissimilar edits, short texts and copies, whatever the bounds."""
    r = np.random.default_rng(11)
    texts = ["", "one", "One", "two words", "a b c d e", "a b c d e f", "f e d c b a", " ".join(["x"] * 90), " ".join(["x"] * 400)]
    for k in range(12):
        words = [f"w{x}" for x in r.integers(0, 900, int(r.integers(20, 200)))]
        texts += [" ".join(words)] * 2
        for n in range(12):
            if r.random() < 0.5:
                at = int(r.integers(0, len(words)))
                words[at:at] = [f"n{k}{n}{i}" for i in range(int(r.integers(1, 9)))]
            else:
                for i in r.choice(len(words), int(r.integers(1, 5)), replace=False):
                    words[i] = f"e{k}{n}{i}"
            texts.append(" ".join(words))
    texts += [f"{t} {texts[20]}" for t in texts[60:70]]
    check_kept(spark, texts, **how)


def test_keep_one_in_a_family_of_dissimilar_edits(spark):
    r = np.random.default_rng(5)
    base = [f"w{x}" for x in r.integers(0, 5000, 300)]

    def edited(words, n, mark):
        words = list(words)
        for i in r.choice(len(words), n, replace=False):
            words[i] = f"{mark}x{i}"
        return words

    family = [edited(base, 7, k) for k in range(40)]
    texts = [" ".join(x) for x in family] + [" ".join(edited(x, 1, "p")) for x in family[:10]]
    assert len(check_kept(spark, texts)) <= 40
    check_kept(spark, texts, near=3)


def test_keep_one_finds_block_edits(spark):
    r = np.random.default_rng(6)
    words = lambda n: " ".join(f"w{x}" for x in r.integers(0, 5000, n))
    texts, n = [], 30
    for k in range(n):
        t = words(300)
        texts += [t, f"{t} {words(30 + k)}"]
    assert len(check_kept(spark, texts)) == n


def test_empty_table(nothing):
    assert simhash.keep_one(nothing).count() == 0
    assert simhash.near_groups(simhash.fingerprints(nothing)).count() == 0
