"""Co-occurrence networks and set comparisons of registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pmi(facts: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n, pmi) of ingredients that share at least ``least`` recipes.

    Pairs come from within a recipe, which the size bounds of the analysis view keep short.
    """
    a, b = facts.alias("a"), facts.alias("b")
    pairs = a.join(b, (F.col("a.recipe_id") == F.col("b.recipe_id")) & (F.col("a.canonical_id") < F.col("b.canonical_id")))
    n = pairs.groupBy(F.col("a.canonical_id").alias("a"), F.col("b.canonical_id").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    one = facts.groupBy("canonical_id").agg(F.count("*").alias("k"))
    total = F.broadcast(facts.agg(F.count_distinct("recipe_id").alias("total")))
    df = n.join(one.select(F.col("canonical_id").alias("a"), F.col("k").alias("ka")), "a").join(one.select(F.col("canonical_id").alias("b"), F.col("k").alias("kb")), "b").crossJoin(total)
    return df.select("a", "b", "n", F.ln(F.col("n") * F.col("total") / (F.col("ka").cast("double") * F.col("kb"))).alias("pmi"))


def backbone(edges: DataFrame, weight: str = "pmi", alpha: float = 0.05) -> DataFrame:
    """Edges (a, b, weight > 0) that stand out at one end: (1 - w / strength) ^ (degree - 1) below alpha."""
    e = edges.where(F.col(weight) > 0)
    ends = e.select(F.col("a").alias("node"), weight).unionByName(e.select(F.col("b").alias("node"), weight))
    s = ends.groupBy("node").agg(F.sum(weight).alias("s"), F.count("*").alias("k"))
    df = e.join(s.select(F.col("node").alias("a"), F.col("s").alias("sa"), F.col("k").alias("ka")), "a").join(s.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.col("k").alias("kb")), "b")
    p = lambda strength, k: F.when(F.col(k) > 1, F.pow(1 - F.col(weight) / F.col(strength), F.col(k) - 1)).otherwise(1.0)
    return df.withColumn("p", F.least(p("sa", "ka"), p("sb", "kb"))).where(F.col("p") < alpha).select("a", "b", weight, "p")


def overlap(facts: DataFrame, left: str, right: str) -> DataFrame:
    """(unit, both, left_only, right_only) ingredients of two registers. facts: register, unit, canonical_id."""
    has = facts.where(F.col("register").isin(left, right)).groupBy("unit", "canonical_id").agg(F.max((F.col("register") == left).cast("int")).alias("l"), F.max((F.col("register") == right).cast("int")).alias("r"))
    n = lambda l, r: F.count_if((F.col("l") == l) & (F.col("r") == r))
    return has.groupBy("unit").agg(n(1, 1).alias("both"), n(1, 0).alias("left_only"), n(0, 1).alias("right_only"))


def presence_absence(weights: DataFrame, left: str, right: str) -> DataFrame:
    """(unit, share_present): of the squared differences between registers, the share where the left weighs more."""
    w = weights.where(F.col("register").isin(left, right))
    d = w.groupBy("unit", "canonical_id").agg(F.sum(F.when(F.col("register") == left, F.col("weight")).otherwise(-F.col("weight"))).alias("d"))
    return d.groupBy("unit").agg(F.try_divide(F.sum(F.when(F.col("d") > 0, F.col("d") * F.col("d")).otherwise(0.0)), F.sum(F.col("d") * F.col("d"))).alias("share_present"))
