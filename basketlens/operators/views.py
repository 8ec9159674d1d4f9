"""Analysis views: which recipes count, and under which labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 3, 25


def sized(recipes: DataFrame, facts: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """recipes with n_ingredients, where it is within the bounds (both inclusive)."""
    n = facts.groupBy("recipe_id").agg(F.count("*").alias("n_ingredients")).where(F.col("n_ingredients").between(least, most))
    return recipes.join(n, "recipe_id")


def clean(recipes: DataFrame, facts: DataFrame, confidence: tuple[str, ...] = ("high", "medium")) -> DataFrame:
    """The analysis view; other levels of confidence give its complements."""
    return sized(recipes.where(F.col("confidence").isin(*confidence)), facts)


def only_registers(recipes: DataFrame, registers: tuple[str, ...]) -> DataFrame:
    """To be applied before any weighting: a register that stays in changes every idf."""
    return recipes.where(F.col("register").isin(*registers))


def trusted(entries: DataFrame) -> DataFrame:
    """Vocabulary entries drafted by hand or reviewed."""
    return entries.where((F.col("drafted_by") == "hand") | F.col("reviewed_at").isNotNull())


def restricted(recipes: DataFrame, facts: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """recipes and facts with trusted entries only, the bounds applied again."""
    kept = facts.join(entries.select("canonical_id"), "canonical_id", "left_semi")
    return sized(recipes.drop("n_ingredients"), kept), kept


def excluding(recipes: DataFrame, ids: DataFrame) -> DataFrame:
    return recipes.join(ids.select("recipe_id"), "recipe_id", "left_anti")


def threshold_on(recipes: DataFrame, register: str, unit: str, least: int) -> DataFrame:
    """Units with fewer recipes than ``least`` lose theirs of this register; other registers pass untouched."""
    enough = recipes.where(F.col("register") == register).groupBy(unit).count().where(F.col("count") >= least).select(unit)
    mine = recipes.where(F.col("register") == register).join(enough, unit, "left_semi")
    return recipes.where(F.col("register") != register).unionByName(mine)


def by_source(recipes: DataFrame, register: str) -> DataFrame:
    """One register split into one per source."""
    name = F.when(F.col("register") == register, F.concat_ws(":", "register", "source_id")).otherwise(F.col("register"))
    return recipes.withColumn("register", name)


def list_confidence(kind: str) -> Column:
    """Confidence of a listing by its kind."""
    return F.when(F.col(kind) == "confirmed", "high").when(F.col(kind) == "listed", "medium").otherwise("low")


def resolve_region(recipes: DataFrame, provinces: DataFrame, own: str = "own_region") -> tuple[DataFrame, DataFrame]:
    """recipes with region (the province's, else their own), and the rows where both exist and differ."""
    df = recipes.join(provinces.select("province", F.col("region").alias("of_province")), "province", "left")
    clash = df.where(F.col("of_province") != F.col(own))
    return df.withColumn("region", F.coalesce("of_province", own)).drop("of_province"), clash


def resolved(recipes: DataFrame, provinces: DataFrame, own: str = "own_region") -> DataFrame:
    """As resolve_region(); refused where a recipe's own region is not its province's."""
    df, clash = resolve_region(recipes, provinces, own)
    n = clash.count()
    if n:
        raise ValueError(f"{n} recipes have a region that is not their province's")
    return df


def fact_rows(recipes: DataFrame, facts: DataFrame, unit: str) -> DataFrame:
    """(register, unit, recipe_id, canonical_id); rows without a unit are dropped before any weighting."""
    rows = recipes.select("recipe_id", "register", F.col(unit).alias("unit")).where("unit is not null")
    return rows.join(facts, "recipe_id").select("register", "unit", "recipe_id", "canonical_id")
