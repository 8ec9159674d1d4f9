from difflib import SequenceMatcher
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from oracle import duck, same
from pyspark.sql import functions as F

import __spark_entry__ as entry
from basketlens.functions import pages, privacy
from basketlens.operators import figures
from basketlens.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), sf, registry.ORACLE_SQL[name])


def rows(spark, sf, name, *columns):
    df = registry.QUERIES[name](spark, sf)
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def table(sf, sql):
    return duck(sf, sql)[1]


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_title_ratio_and_near_names(spark, sf):
    names = [x for (x,) in table(sf, "select distinct p_name from part")]
    expected = sorted((a, b, ratio(a, b)) for a in names for b in names if a != b and ratio(a, b) >= 0.8)
    assert rows(spark, sf, "title_ratio", "key", "other", "ratio") == sorted(expected, key=repr)
    mapped = {k for k, in table(sf, "select p_name from part where not starts_with(p_name, 'small') and not starts_with(p_name, 'red') and not starts_with(p_name, 'blue') union select p_name from part where starts_with(p_name, 'small') and p_size <= 3 union select p_name from part where starts_with(p_name, 'red')")}
    expected = [(a, b, ratio(a, b)) for a in names if a not in mapped for b in mapped if ratio(a, b) >= 0.7]
    assert expected and rows(spark, sf, "near_names", "key", "other", "ratio") == sorted(expected, key=repr)


def test_duplicate_candidates(spark, sf):
    pairs = rows(spark, sf, "jaccard_candidates", "a", "b", "similarity")
    titles = dict(table(sf, "select o_orderkey, c_mktsegment || ' ' || n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"))
    expected = [(a, b, round(ratio(titles[a], titles[b]), 9)) for a, b, _ in pairs if ratio(titles[a], titles[b]) > 0.8]
    got = [(a, b, round(x, 9)) for a, b, x in rows(spark, sf, "duplicate_candidates", "a", "b", "title_similarity")]
    assert expected and got == sorted(expected, key=repr)


def test_html(spark, sf):
    expected = sorted(((i, pos, line) for i, html in table(sf, "select page_id, html from pages") for pos, line in enumerate(pages.plain_lines(html) or [])), key=repr)
    assert rows(spark, sf, "html_lines", "page_id", "pos", "line") == expected
    found = {}
    for i, _, line in sorted(expected, key=lambda x: (x[0], x[1])):
        page = found.setdefault(i, [])
        item = line
        for mark in "•◦‣▪·*+-–—":
            item = item.removeprefix(mark)
        if len(line) <= 40:
            page.append([line, [], True])
        elif page and page[-1][2] and len(item) <= 400:
            page[-1][1].append(item.strip())
        elif page:
            page[-1][2] = False
    sections = {i: [(h, items) for h, items, _ in page if items] for i, page in found.items()}
    got = {}
    for r in registry.QUERIES["html_sections"](spark, sf).orderBy("page_id", "section").collect():
        got.setdefault(r["page_id"], []).append(r["heading"])
    assert got == {i: [h for h, _ in x] for i, x in sections.items() if x}
    expected = {}
    for i, url in table(sf, "select page_id, url from pages"):
        n = len(sections.get(i, []))
        outcome = "no_section" if not n else "many_sections" if n > 1 else "loaded" if (url or "").strip() else "no_name"
        expected[outcome] = expected.get(outcome, 0) + 1
    assert dict(rows(spark, sf, "single_section_outcome", "outcome", "n")) == expected


def test_redaction_and_scans(spark, sf):
    said = table(sf, "select conv_id, turn, text from conversations")
    expected = []
    for c, t, x in said:
        clean, n = privacy.redact_text(x)
        expected.append((c, t, clean, sum(n.values())))
    assert rows(spark, sf, "redact_texts", "conv_id", "turn", "text", "total") == sorted(expected, key=repr)
    both = lambda x: sorted({c for c, n in privacy.redact_text(x)[1].items() if n} | set(privacy.leak_classes(x)))
    texts = table(sf, "select doc_id, text from documents")
    left = [(i, " ".join(both(privacy.redact_text(x)[0]))) for i, x in texts]
    assert rows(spark, sf, "leak_scan") == sorted(((i, c) for i, c in left if c), key=repr)
    counts = {}
    for name, sql in (("documents", "select text, lang, source from documents"), ("pages", "select url, html from pages"), ("conversations", "select role, text from conversations")):
        for row in table(sf, sql):
            for c in privacy.leak_classes("\n".join(row)):
                counts[name, c] = counts.get((name, c), 0) + 1
    assert {(a, b): n for a, b, n in rows(spark, sf, "scan_all_text_columns", "table", "class", "n_rows")} == counts


def test_heatmap_order(spark, sf):
    weights = [r for r in rows(spark, sf, "profile_vectors", "register", "unit", "canonical_id", "weight") if r[0] == "official"]
    units, columns = sorted({r[1] for r in weights}), sorted({r[2] for r in weights})
    x = np.zeros((len(units), len(columns)))
    for _, u, c, w in weights:
        x[units.index(u), columns.index(c)] = w
    n = np.linalg.norm(x, axis=1)
    order = figures.leaf_order(1 - x @ x.T / np.outer(n, n), n == 0)
    assert [u for _, u in rows(spark, sf, "heatmap_order", "place", "unit")] == [units[i] for i in order]


def quantile(b, q):
    at = q * (len(b) - 1)
    k = min(int(at), len(b) - 2)
    return b[k] + (at - k) * (b[k + 1] - b[k])


def bias_corrected(draws, observed, a=0.0):
    b, n, normal = sorted(draws), len(draws), NormalDist()
    share = (sum(x < observed for x in b) + 0.5 * sum(x == observed for x in b)) / n
    z0 = normal.inv_cdf(min(max(share, 1 / (n + 1)), n / (n + 1)))
    return [quantile(b, normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (normal.inv_cdf(0.025), normal.inv_cdf(0.975))]


def test_bias_corrected_intervals(spark, sf):
    draws, left_out = {}, {}
    for u, d in rows(spark, sf, "bootstrap_draws", "unit", "distance"):
        if d is not None:
            draws.setdefault(u, []).append(d)
    observed = dict(rows(spark, sf, "register_distance_tfidf", "unit", "distance"))
    for u, d in rows(spark, sf, "jackknife_distances", "unit", "distance"):
        left_out.setdefault(u, []).append(d)
    for name, accelerated in (("bias_corrected_interval", False), ("bca_interval", True)):
        got = {u: (lo, hi) for u, lo, hi in rows(spark, sf, name, "unit", "bc_lo", "bc_hi")}
        assert got.keys() == draws.keys()
        for u, ends in got.items():
            d = np.mean(left_out[u]) - np.array(left_out[u]) if accelerated else np.zeros(1)
            a = (d**3).sum() / (6 * (d**2).sum() ** 1.5) if (d**2).sum() else 0.0
            assert ends == pytest.approx(bias_corrected(draws[u], observed[u], a), abs=2e-4), (name, u)


def test_result_table_is_made_of_its_parts(spark, sf):
    got = [r for r in registry.QUERIES["rq_result_table"](spark, sf).collect()]
    assert {r["weighting"] for r in got} == {"tfidf", "prevalence"}
    mine = {r["unit"]: r for r in got if r["weighting"] == "tfidf"}
    for u, n, m, d in rows(spark, sf, "register_distance_tfidf", "unit", "n_left", "n_right", "distance"):
        assert (mine[u]["n_left"], mine[u]["n_right"], mine[u]["below_min_n"]) == (n, m, m < 5) and mine[u]["distance"] == pytest.approx(d, abs=1e-6)
    for u, lo, hi, outside in rows(spark, sf, "bootstrap_intervals", "unit", "lo", "hi", "outside"):
        assert mine[u]["lo"] == pytest.approx(lo, abs=1e-6) and mine[u]["hi"] == pytest.approx(hi, abs=1e-6) and mine[u]["obs_outside_ci"] == outside
    for kind in ("register", "unit"):
        p = dict(rows(spark, sf, f"permute_{kind}", "unit", "p"))
        assert {u: r[f"p_{kind}"] for u, r in mine.items()} == pytest.approx(p, abs=1e-6)
        order, worst = sorted(p, key=lambda u: (p[u], u)), 0.0
        for i, u in enumerate(order):
            worst = max(worst, (len(order) - i) * p[u])
            assert mine[u][f"p_holm_{kind}"] == pytest.approx(min(1.0, worst), abs=1e-6)


def test_kernel_query(spark, sf):
    got = rows(spark, sf, "bootstrap_kernel", "unit", "rep", "distance")
    draws = {u for u, d in rows(spark, sf, "bootstrap_draws", "unit", "distance") if d is not None}
    assert {u for u, *_ in got} == draws and len(got) == 40 * len(draws) and all(0 <= d <= 1 for *_, d in got)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_batches_are_bounded_in_bytes(spark, sf):
    @F.pandas_udf("long")
    def rows_of_batch(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        registry.QUERIES["single_section_outcome"](spark, sf)
        texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("t"))
        assert texts.agg(F.max(rows_of_batch("t"))).first()[0] <= 400
    finally:
        if before is not None:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_leak_scan_goes_to_python_once(spark, sf):
    plan = registry.QUERIES["leak_scan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
