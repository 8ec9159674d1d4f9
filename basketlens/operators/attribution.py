"""Place labels from names: which terms hit, under which rule, and when that makes a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.operators.similarity import contained


def name_hits(texts: DataFrame, key: str, text: str, names: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(key, rule, code): names (code, name, ambiguous) contained in the text, by rule.

    A rule is a condition on name, ambiguous and the text column; names are a short reference list,
    so the containment join is a broadcast loop over it.
    """
    hit = texts.select(key, text).join(F.broadcast(names), F.contains(F.col(text), F.col("name")))
    which = F.filter(F.array(*[F.when(cond, rule) for rule, cond in rules.items()]), lambda x: x.isNotNull())
    return hit.select(key, "code", F.explode(which).alias("rule")).distinct()


def sets(hits: DataFrame, key: str) -> DataFrame:
    """(key, rule, codes, n): the hits of each rule as a sorted set."""
    return hits.groupBy(key, "rule").agg(F.array_sort(F.collect_set("code")).alias("codes")).withColumn("n", F.size("codes"))


def rule_yield(found: DataFrame, totals: DataFrame, rules: list[str]) -> DataFrame:
    """(rule, any, one, conflicting, share) over all texts, rules without hits included."""
    fixed = F.broadcast(found.sparkSession.createDataFrame([(r,) for r in rules], "rule string"))
    n = found.groupBy("rule").agg(F.count("*").alias("any"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") > 1).alias("conflicting"))
    out = fixed.join(n, "rule", "left").fillna(0, ["any", "one", "conflicting"]).crossJoin(F.broadcast(totals.agg(F.count("*").alias("texts"))))
    return out.withColumn("share", F.try_divide("one", "texts"))


def decide(keys: DataFrame, key: str, provinces: DataFrame, regions: DataFrame) -> DataFrame:
    """(key, label, tier, note): one province makes tier 1; none and one region tier 2; ambiguity makes no label.

    provinces, regions: (key, codes).
    """
    df = keys.select(key).join(provinces.select(key, F.col("codes").alias("p")), key, "left").join(regions.select(key, F.col("codes").alias("r")), key, "left")
    np_, nr = F.coalesce(F.size("p"), F.lit(0)), F.coalesce(F.size("r"), F.lit(0))
    np_, nr = F.greatest(np_, F.lit(0)), F.greatest(nr, F.lit(0))
    tier = F.when(np_ == 1, 1).when((np_ == 0) & (nr == 1), 2)
    label = F.when(np_ == 1, F.col("p")[0]).when((np_ == 0) & (nr == 1), F.col("r")[0])
    note = F.when((np_ == 1) & (nr > 1), "regions conflict").when(np_ > 1, "several provinces").when((np_ == 0) & (nr > 1), "several regions")
    return df.select(key, label.alias("label"), tier.alias("tier"), note.alias("note"))


def merge_labels(decided: DataFrame, by_hand: DataFrame, key: str) -> DataFrame:
    """Labels of a rule with hand-read ones for keys that have none; those never override."""
    known = decided.where("label is not null")
    new = by_hand.join(known.select(key), key, "left_anti")
    return known.select(key, "label", F.col("tier").cast("int").alias("tier")).unionByName(new.select(key, "label", F.lit(3).alias("tier")))


def from_field(forms: DataFrame, provinces: DataFrame, field: str) -> DataFrame:
    """Exact lookup of a form's field; a miss is a null province with low confidence."""
    out = forms.join(provinces.select(F.col("name").alias(field), "code"), field, "left")
    return out.withColumn("confidence", F.when(F.col("code").isNotNull(), "high").otherwise("low"))


def rebuild(existing: DataFrame, new: DataFrame, key: str, note: str, owned_prefix: str) -> DataFrame:
    """Rows that a rule owns (by the start of their note) replaced; foreign rows stay and win over new ones."""
    foreign = existing.where(~F.coalesce(F.startswith(F.col(note), F.lit(owned_prefix)), F.lit(False)))
    return foreign.unionByName(new.join(foreign.select(key), key, "left_anti"))


def term_hits(texts: DataFrame, key: str, text: str, terms: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, rule, code) of region terms in a text; terms: term -> (rule, region). Terms are a short list in the plan."""
    found = F.array_compact(F.array(*[F.when(F.contains(F.col(text), F.lit(t)), F.struct(F.lit(rule).alias("rule"), F.lit(region).alias("code"))) for t, (rule, region) in terms.items()]))
    return texts.select(key, F.inline(F.array_distinct(found)))


def title_hits(texts: DataFrame, key: str, title: str, names: DataFrame) -> DataFrame:
    """(key, rule, code) of titles that are (exact) or hold (substring) a known name; names: (name, code).

    Each distinct title is looked up once. A key with one title has each of its hits once then, so the
    rows, many for each text, are neither held nor shuffled; only those of keys with several titles are
    made distinct.
    """
    titles = texts.select(F.col(title).alias("__title")).distinct().withColumn("__key", F.col("__title"))
    exact = titles.join(names, F.col("__title") == F.col("name")).select("__key", F.lit("exact").alias("rule"), "code")
    held = contained(titles, "__key", "__title", names, "name").join(names, "name").select("__key", F.lit("substring").alias("rule"), "code")
    hits = exact.unionByName(held).distinct().groupBy("__key").agg(F.collect_list(F.struct("rule", "code")).alias("__hits"))
    own = texts.groupBy(key).agg(F.collect_set(title).alias("__own")).select(key, (F.size("__own") > 1).alias("__several"), F.explode("__own").alias("__key"))
    rows = own.join(hits, "__key").select(key, "__several", F.inline("__hits"))
    return rows.where("not __several").drop("__several").unionByName(rows.where("__several").drop("__several").distinct())


def agreement(found: DataFrame, key: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(left_rule, right_rule, both, same): texts with one code under each of two rules, and with the same one. found: (key, rule, codes, n)."""
    one = found.where("n = 1").select(key, "rule", F.col("codes")[0].alias("code"))
    wide = one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("rule", "code"))).alias("m"))
    out = None
    for a, b in pairs:
        x, y = F.col("m")[a], F.col("m")[b]
        row = wide.agg(F.count_if(x.isNotNull() & y.isNotNull()).alias("both"), F.count_if(x == y).alias("same")).select(F.lit(a).alias("left_rule"), F.lit(b).alias("right_rule"), "both", "same")
        out = row if out is None else out.unionByName(row)
    return out


def listed_hits(found: DataFrame, key: str, rules: list[str]) -> DataFrame:
    """One row per text: each rule's codes, sorted and joined by a bar."""
    wide = found.groupBy(key).pivot("rule", rules).agg(F.first(F.array_join("codes", "|")))
    return wide.fillna("", rules)


def labelled_fraction(found: DataFrame, texts: DataFrame, key: str, scope: str, rules: list[str]) -> DataFrame:
    """(scope, rule, n, any, one, share): of all texts in a scope, those with any and with exactly one code under each rule."""
    fixed = F.broadcast(found.sparkSession.createDataFrame([(r,) for r in rules], "rule string"))
    n = texts.groupBy(scope).agg(F.count("*").alias("n"))
    hits = found.join(texts.select(key, scope), key).groupBy(scope, "rule").agg(F.count("*").alias("any"), F.count_if(F.col("n") == 1).alias("one"))
    out = n.crossJoin(fixed).join(hits, [scope, "rule"], "left").fillna(0, ["any", "one"])
    return out.withColumn("share", F.try_divide("one", "n"))
