import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketlens.operators import figures, inference, network, profiles, ranking, regional, views

LONG = "recipe_id long, register string, unit string, canonical_id string"


def corpus(seed=1, gap=True):
    r = np.random.default_rng(seed)
    rows, k = [], 0
    for unit, sizes in {"n": (9, 14), "s": (9, 9), "c": (0, 1)}.items():
        for register, n in zip(("official", "commercial"), sizes):
            for _ in range(n):
                k += 1
                pool = np.arange(0, 12) if register == "official" or not gap else np.arange(8, 20)
                rows += [(k, register, unit, f"i{x}") for x in r.choice(pool, 5, replace=False)]
    return rows


@pytest.fixture(scope="module")
def data(spark):
    df = spark.createDataFrame(corpus(), LONG).cache()
    members = df.select("register", "unit", "recipe_id", F.lit(1).cast("bigint").alias("mult")).distinct()
    return members, df.select("recipe_id", "canonical_id"), df


def numpy_distances(rows, weighting="tfidf", left="official", right="commercial"):
    f = pd.DataFrame(rows, columns=["recipe_id", "register", "unit", "canonical_id"])
    groups = {g: x for g, x in f.groupby(["register", "unit"])}
    names = sorted(f["canonical_id"].unique())
    p = {g: np.array([(x["canonical_id"] == c).sum() / x["recipe_id"].nunique() for c in names]) for g, x in groups.items()}
    df = sum((v > 0).astype(int) for v in p.values())
    w = {g: v * (np.log((1 + len(p)) / (1 + df)) + 1 if weighting == "tfidf" else 1) for g, v in p.items()}
    out = {}
    for u in f["unit"].unique():
        a, b = w.get((left, u)), w.get((right, u))
        out[u] = None if a is None or b is None else 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    return out


@pytest.mark.parametrize("weighting", ["tfidf", "prevalence"])
def test_distances_equal_numpy(data, weighting):
    got = {r["unit"]: r for r in profiles.register_distances(data[0], data[1], weighting).collect()}
    for u, d in numpy_distances(corpus(), weighting).items():
        assert got[u]["distance"] is None if d is None else abs(got[u]["distance"] - d) < 1e-9
    assert (got["c"]["n_left"], got["c"]["n_right"]) == (0, 1)


def test_weighting_has_no_default(data):
    with pytest.raises(ValueError):
        profiles.weighted(profiles.prevalence(data[0], data[1]), "other")


def test_removing_a_register_changes_idf(spark, data):
    members, facts, df = data
    more = spark.createDataFrame([(900 + i, "domestic", "n", f"i{i % 3}") for i in range(9)], LONG)
    bigger = members.unionByName(more.select("register", "unit", "recipe_id", F.lit(1).cast("bigint").alias("mult")).distinct())
    a = profiles.register_distances(members, facts, "tfidf").where("unit = 'n'").first()["distance"]
    b = profiles.register_distances(bigger, facts.unionByName(more.select("recipe_id", "canonical_id")), "tfidf").where("unit = 'n'").first()["distance"]
    assert abs(a - b) > 1e-6


def test_bounds_are_inclusive(spark):
    facts = spark.createDataFrame([(n, f"i{i}") for n in (2, 3, 25, 26) for i in range(n)], "recipe_id long, canonical_id string")
    recipes = spark.createDataFrame([(2,), (3,), (25,), (26,)], "recipe_id long")
    assert {r[0] for r in views.sized(recipes, facts).select("recipe_id").collect()} == {3, 25}


def test_null_unit_is_dropped_first(spark):
    recipes = spark.createDataFrame([(1, "official", None), (2, "official", "n")], "recipe_id long, register string, region string")
    assert profiles.members_of(recipes, "region").count() == 1


def test_bootstrap_keeps_sizes(data):
    sizes = {(r["register"], r["unit"]): r["n_recipes"] for r in profiles.sizes(data[0]).collect()}
    got = profiles.sizes(inference.bootstrap(data[0], 5), ["rep"]).collect()
    assert len(got) == 5 * len(sizes) and all(r["n_recipes"] == sizes[r["register"], r["unit"]] for r in got)


def test_permutations_keep_sizes(data):
    members = data[0]
    sizes = {(r["register"], r["unit"]): r["n_recipes"] for r in profiles.sizes(members).collect()}
    for moved in (inference.permute_registers(members, "official", "commercial", 3), inference.permute_units(members, 3)):
        assert {(r["register"], r["unit"]): r["n_recipes"] for r in profiles.sizes(moved, ["rep"]).where("rep = 2").collect()} == sizes


def test_planted_and_null_signal(spark):
    for gap in (True, False):
        df = spark.createDataFrame(corpus(4, gap), LONG)
        members, facts = df.select("register", "unit", "recipe_id", F.lit(1).cast("bigint").alias("mult")).distinct(), df.select("recipe_id", "canonical_id")
        null = profiles.register_distances(inference.permute_registers(members, "official", "commercial", 60), facts, "tfidf", scope=["rep"])
        p = {r["unit"]: r["p"] for r in inference.p_values(profiles.register_distances(members, facts, "tfidf"), null).collect()}
        assert all(x >= 1 / 61 for x in p.values())
        assert max(p.values()) < 0.05 if gap else max(p.values()) > 0.05


def test_holm(spark):
    p = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", float("nan")), ("f", "e", None)], "f string, unit string, p double")
    got = {r["unit"]: r["p_holm"] for r in inference.holm(p, ["f"], "unit").collect()}
    assert got["a"] == pytest.approx(0.03) and got["c"] == got["b"] == pytest.approx(0.06) and got["d"] is None and got["e"] is None


def test_jackknife_equals_recomputing(data):
    got = {(r["left_out"], r["unit"]): r["distance"] for r in inference.jackknife(data[0], data[1], "official", "commercial").collect()}
    rows = corpus()
    where = {r[0]: (r[1], r[2]) for r in rows}
    assert {k for k, _ in got} == {k for k, (_, u) in where.items() if u in "ns"}
    for (k, u), d in got.items():
        assert d == pytest.approx(numpy_distances([r for r in rows if r[0] != k])[u], abs=1e-9)


def test_bias_corrected_interval():
    b = np.linspace(0, 1, 1001)
    lo, hi = inference.bias_corrected(b, 0.5)
    assert lo == pytest.approx(0.025, abs=0.01) and hi == pytest.approx(0.975, abs=0.01)
    assert all(np.isnan(inference.bias_corrected(b, float("nan"))))
    assert inference.bias_corrected(b, 2.0)[0] > 0.9


def test_multinomial_bootstrap_against_numpy(data):
    """The same draws as one generator for each replicate gives, group by group, whatever the size of a block."""
    members, facts, rows = data
    got = {(r["unit"], r["rep"]): r["distance"] for r in inference.bootstrap_kernel(rows, "tfidf", 3).collect()}
    pdf = rows.toPandas()
    groups = sorted({(r, u) for r, u in zip(pdf["register"], pdf["unit"])})
    for rep in (1, 2, 3):
        rng, drawn = np.random.default_rng([42, 0, rep]), []
        for r, u in groups:
            of = pdf[(pdf["register"] == r) & (pdf["unit"] == u)]
            ids = sorted(of["recipe_id"].unique())
            for i, n in zip(ids, rng.multinomial(len(ids), np.full(len(ids), 1 / len(ids)))):
                drawn += [(f"{i}#{k}", r, u, c) for k in range(n) for c in of[of["recipe_id"] == i]["canonical_id"]]
        for u, d in numpy_distances(drawn).items():
            if len({r for _, r, v, _ in drawn if v == u and r in ("official", "commercial")}) == 2:
                assert got[u, rep] == pytest.approx(d, abs=1e-9)
    assert len(got) == 3 * len({u for u, _ in got})


def test_blocks_of_replicates_do_not_matter(data, monkeypatch):
    members, facts, _ = data
    far = lambda: sorted((r["rep"], r["unit"], r["distance"]) for r in inference.replicated(lambda last, first: inference.bootstrap(members, last, first), facts, 5, "tfidf", "official", "commercial").where("distance is not null").collect())
    whole = far()
    monkeypatch.setattr(inference, "BLOCK", 2)
    plain = profiles.register_distances(inference.bootstrap(members, 5), facts, "tfidf", scope=["rep"]).where("distance is not null").collect()
    expected = sorted((r["rep"], r["unit"], r["distance"]) for r in plain)
    for got in (whole, far()):
        assert [x[:2] for x in got] == [x[:2] for x in expected] and [x[2] for x in got] == pytest.approx([x[2] for x in expected])


def test_numbered_equals_one_window(spark):
    rows = [("ab"[i % 2], (i * 37) % 101, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {(r["g"], r["v"], r["i"]): r["place"] for r in ranking.numbered(df, ["g"], ["v", "i"], F.floor(F.col("v") / 7)).collect()}
    for g in "ab":
        for place, row in enumerate(sorted((v, i) for h, v, i in rows if h == g)):
            assert got[g, *row] == place


def test_sweep_is_inclusive_and_keeps_zeros(spark):
    got = {r["threshold"]: r["n_units"] for r in ranking.sweep(spark.createDataFrame([("a", 10), ("a", 15)], "g string, n long"), ["g"], 5, 30).collect()}
    assert got[10] == 2 and got[11] == got[15] == 1 and got[16] == got[30] == 0 and len(got) == 26


def test_separation_equals_pairs(spark):
    r = np.random.default_rng(2)
    v = [(i, i % 3, (r.normal(size=4) + (i % 3)).tolist()) for i in range(30)] + [(99, 1, [0.0] * 4)]
    df = spark.createDataFrame(v, "id long, label int, vec array<double>")
    got = {x["rep"]: x["gap"] for x in regional.separation(df, 3).collect()}
    u = {i: np.array(x) / (np.linalg.norm(x) or 1) for i, _, x in v}
    pairs = [(1 - u[a] @ u[b], la == lb) for n, (a, la, _) in enumerate(v) for b, lb, _ in v[n + 1 :]]
    assert got[0] == pytest.approx(np.mean([d for d, s in pairs if not s]) - np.mean([d for d, s in pairs if s])) and len(got) == 4


def test_backbone_and_pmi(spark):
    facts = spark.createDataFrame([(i, c) for i, s in enumerate(["ab", "ab", "ac", "cd", "cd", "bd"]) for c in s], "recipe_id int, canonical_id string")
    got = {(r["a"], r["b"]): r for r in network.pmi(facts).collect()}
    assert set(got) == {("a", "b"), ("c", "d")} and got["a", "b"]["pmi"] == pytest.approx(np.log(2 * 6 / (3 * 3)))


def test_leaf_order_is_the_best_of_all_turns():
    r = np.random.default_rng(3)
    for n in (3, 5, 7):
        x = r.random((n, 4))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
        zero = np.zeros(n, bool)
        order = figures.leaf_order(d, zero)
        assert sorted(order) == list(range(n))
        trees = {i: i for i in range(n)}
        sets = {i: [i] for i in range(n)}
        while len(trees) > 1:
            _, a, b = min((d[np.ix_(sets[i], sets[j])].mean(), i, j) for i in sets for j in sets if i < j)
            trees[a], sets[a] = (trees[a], trees.pop(b)), sets[a] + sets.pop(b)

        def turns(t):
            if isinstance(t, int):
                return [[t]]
            return [p + q for x, y in (t, t[::-1]) for p in turns(x) for q in turns(y)]

        cost = lambda o: sum(d[i, j] for i, j in zip(o, o[1:]))
        assert cost(order) == pytest.approx(min(map(cost, turns(trees[0]))))
    d[0, :] = d[:, 0] = 1
    assert figures.leaf_order(d, np.arange(7) == 0)[-1] == 0
    assert figures.leaf_order(d[:2, :2], np.zeros(2, bool)) == [0, 1]


def test_histogram_closes_its_last_bin(spark):
    v = spark.createDataFrame([(0.0,), (0.25,), (1.0,), (1.1,), (None,)], "v double")
    assert {r["bin"]: r["n"] for r in ranking.histogram(v, "v", [0, 0.25, 0.5, 1]).collect()} == {0: 1, 1: 1, 2: 1}


def test_upper_median_and_ceiling(spark):
    v = spark.createDataFrame([("g", x) for x in (1, 2, 3, 4)], "g string, v int")
    assert ranking.upper_median(v, ["g"], "v").first()["median"] == 3
    n = spark.createDataFrame([("other", 5), ("acid", 95)], "c string, n long")
    assert ranking.over_ceiling(n, "c", "other", 0.05).first()["over"] is False
    assert [r["n"] for r in ranking.with_zeros(n, ["acid", "fat", "other"], "c").orderBy("place").collect()] == [95, 0, 5]


@pytest.mark.parametrize("resampled", [inference.bootstrap, inference.multinomial])
def test_draws_are_not_broadcast(data, resampled):
    drawn = resampled(data[0], 3)
    assert drawn.count()
    drawn.collect()
    assert re.search(r"SortMergeJoin \[register#\d+, unit#\d+, place#\d+L?\]", drawn._jdf.queryExecution().executedPlan().toString())


def test_picks_in_lots_are_the_same(data, monkeypatch):
    rows = lambda: sorted(map(tuple, inference.bootstrap(data[0], 3).collect()))
    whole = rows()
    monkeypatch.setattr(inference, "PICKS", 4)
    assert rows() == whole


def test_spans_equal_places(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"), "id")
    cell = F.shiftright("h", 61)
    spans = spark.createDataFrame([(g, upto, name) for g in range(3) for upto, name in ((1, "a"), (40, "b"), (41, "c"), (167 - g // 2, "d"))], "g long, upto long, span string")
    got = ranking.spanned(df, ["g"], ["h", "id"], cell, spans)
    places = {r["id"]: r["place"] for r in ranking.numbered(df, ["g"], ["h", "id"], cell).collect()}
    assert {r["id"]: r["span"] for r in got.collect()} == {i: "a" if p < 1 else "b" if p < 40 else "c" if p < 41 else "d" for i, p in places.items()}


def test_permuted_rows_are_not_sorted(data):
    for moved in (inference.permute_units(data[0], 3), inference.permute_registers(data[0], "official", "commercial", 3)):
        plan = moved._jdf.queryExecution().optimizedPlan().toString()
        top = [line for line in plan.splitlines() if "Join" in line][0]
        assert "rightHint=(strategy=broadcast)" in top
        assert moved.count() == 3 * data[0].count()


def test_tfidf_shuffles_texts_rather_than_words(spark, shuffled, monkeypatch):
    words = [f"{'ab'[i % 2]}{'xyz'[i % 3]}{chr(97 + i % 26)}" for i in range(156)]
    rows = [(i % 290, " ".join(words[(i * 7 + j) % 156] for j in range(100))) for i in range(300)] + [(1000, "Once."), (1001, None), (1002, "12"), (None, "AB ab")]
    texts = spark.createDataFrame(rows, "doc long, text string")
    counts = {}
    for d, x in rows:
        for w in re.findall("[a-z]+", (x or "").lower()):
            counts.setdefault(d, {}).setdefault(w, 0)
            counts[d][w] += 1
    df = {w: sum(w in c for c in counts.values()) for c in counts.values() for w in c}
    n = len([d for d in counts if d is not None])
    want = {}
    for d, c in counts.items():
        w = {t: k * (np.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items() if df[t] >= 2}
        if w:
            want[d] = (len(w), max(w.values()) / np.sqrt(sum(x * x for x in w.values())))
    for most in (200_000, 5):  # words that are joined give the same
        monkeypatch.setattr(regional, "FREQUENT", most)
        tops = regional.tfidf_tops(texts, "[a-z]+")
        got = {r["doc"]: (r["tokens"], r["top"]) for r in tops.collect()}
        assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d]) for d in want)
        if most == 200_000:
            assert shuffled(tops)[0] < sum(map(len, counts.values())) / 4
    long = regional.tfidf(texts, "[a-z]+").where("doc is not null").groupBy("doc").agg(F.count("*").alias("tokens"), F.max("weight").alias("top"))
    assert {r["doc"]: (r["tokens"], r["top"]) for r in long.collect()} == {d: pytest.approx(x) for d, x in want.items() if d is not None}


def test_jackknife_computes_profiles_once(spark, sf):
    from basketlens.plans import registry

    plan = registry.QUERIES["jackknife_distances"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("FileScan parquet [l_orderkey") <= 2  # to count a recipe's ingredients, and for its rows
