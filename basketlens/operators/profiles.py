"""Ingredient profiles of (register, unit) groups in long form, and distances between registers.

``members`` is (scope..., register, unit, recipe_id, mult): which recipes make up a group, and how
often each counts. ``scope`` columns keep families of groups apart, such as bootstrap replicates:
each has inverse document frequencies of its own. Everything stays relational, so replicates are
rows, not loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREVALENCE, TFIDF = "prevalence", "tfidf"
GROUP = ["register", "unit"]


def members_of(recipes: DataFrame, unit: str) -> DataFrame:
    return recipes.where(F.col(unit).isNotNull()).select("register", F.col(unit).alias("unit"), "recipe_id", F.lit(1).cast("bigint").alias("mult"))


def sizes(members: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    return members.groupBy(*scope, *GROUP).agg(F.sum("mult").alias("n_recipes"))


def prevalence(members: DataFrame, facts: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """Share of a group's recipes that hold each ingredient."""
    keys = [*scope, *GROUP]
    hits = members.join(facts, "recipe_id").groupBy(*keys, "canonical_id").agg(F.sum("mult").alias("hits"))
    return hits.join(sizes(members, scope), keys).select(*keys, "canonical_id", "n_recipes", (F.col("hits") / F.col("n_recipes")).alias("prevalence"))


def document_frequency(profiles: DataFrame, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """In how many groups each ingredient occurs."""
    return profiles.groupBy(*scope, "canonical_id").agg(F.count("*").alias("df"))


def weighted(profiles: DataFrame, weighting: str, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """Profiles with weight. The weighting has no default: prevalence, or prevalence times smoothed idf."""
    if weighting == PREVALENCE:
        return profiles.withColumn("weight", F.col("prevalence"))
    if weighting != TFIDF:
        raise ValueError(f"unknown weighting {weighting!r}")
    groups = profiles.select(*scope, *GROUP).distinct().groupBy(*scope).agg(F.count("*").alias("groups"))
    joined = profiles.join(document_frequency(profiles, scope), [*scope, "canonical_id"])
    joined = joined.join(F.broadcast(groups), scope) if scope else joined.crossJoin(F.broadcast(groups))
    return joined.withColumn("weight", F.col("prevalence") * (F.ln((1 + F.col("groups")) / (1 + F.col("df"))) + 1)).drop("groups", "df")


def cosine(dot: Column, a: Column, b: Column) -> Column:
    """Cosine distance; null where a norm is zero or missing."""
    return 1 - F.try_divide(dot, F.sqrt(a) * F.sqrt(b))


def distances(profiles: DataFrame, left: str, right: str, scope: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per unit that any register covers: n_left, n_right and distance (null if a side is missing)."""
    keys = [*scope, "unit"]
    side = profiles.where(F.col("register").isin(left, right))
    pair = side.groupBy(*keys, "canonical_id").agg(
        F.sum(F.when(F.col("register") == left, F.col("weight"))).alias("a"), F.sum(F.when(F.col("register") == right, F.col("weight"))).alias("b")
    )
    sums = pair.groupBy(*keys).agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    n = profiles.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("register") == left, F.col("n_recipes"))), F.lit(0)).alias("n_left"),
        F.coalesce(F.max(F.when(F.col("register") == right, F.col("n_recipes"))), F.lit(0)).alias("n_right"),
    )
    far = F.when((F.col("n_left") > 0) & (F.col("n_right") > 0), cosine(F.coalesce("dot", F.lit(0.0)), F.col("aa"), F.col("bb")))
    return n.join(sums, keys, "left").select(*keys, "n_left", "n_right", far.alias("distance"))


def register_distances(members: DataFrame, facts: DataFrame, weighting: str, left: str = "official", right: str = "commercial", scope: list[str] = []) -> DataFrame:  # noqa: B006
    return distances(weighted(prevalence(members, facts, scope), weighting, scope), left, right, scope)


def distances_sql(members: str, weighting: str, scope: str = "", left: str = "official", right: str = "commercial", name: str = "dist") -> str:
    """The same as DuckDB CTEs over ``members`` and ``facts``; the last is called ``name``."""
    s = f"{scope}, " if scope else ""
    join = f"using ({scope})" if scope else "on true"
    idf = "(ln((1 + groups) / (1 + df)::double) + 1)" if weighting == TFIDF else "1"
    return f"""
{name}_n as (select {s}register, unit, sum(mult) as n_recipes from {members} group by all),
{name}_p as (
  select {s}register, unit, canonical_id, any_value(n_recipes) as n_recipes, sum(mult) / any_value(n_recipes)::double as prevalence
  from {members} join facts using (recipe_id) join {name}_n using ({s}register, unit) group by all
),
{name}_d as (select {s}canonical_id, count(*) as df from {name}_p group by all),
{name}_g as (select {s}count(*) as groups from (select distinct {s}register, unit from {name}_p){" group by all" if scope else ""}),
{name}_w as (
  select {s}register, unit, canonical_id, n_recipes, prevalence, prevalence * {idf} as weight
  from {name}_p join {name}_d using ({s}canonical_id) join {name}_g {join}
),
{name}_s as (
  select {s}unit, sum(a * b) as dot, sum(a * a) as aa, sum(b * b) as bb from (
    select {s}unit, canonical_id, sum(weight) filter (register = '{left}') as a, sum(weight) filter (register = '{right}') as b
    from {name}_w where register in ('{left}', '{right}') group by all) group by all
),
{name}_c as (
  select {s}unit, coalesce(max(n_recipes) filter (register = '{left}'), 0) as n_left, coalesce(max(n_recipes) filter (register = '{right}'), 0) as n_right
  from {name}_w group by all
),
{name} as (
  select {s}unit, n_left, n_right, case when n_left > 0 and n_right > 0 and aa > 0 and bb > 0 then 1 - coalesce(dot, 0) / (sqrt(aa) * sqrt(bb)) end as distance
  from {name}_c left join {name}_s using ({s}unit)
)"""
