"""The data model bound to the driver's tables: recipes are orders, ingredients are part kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.session import bound_batches, ship


class Testbed:
    """Tables of one folder, and the model's relations over them."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)
        bound_batches(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def facts(self, by_recipe: bool = False) -> DataFrame:
        """(recipe_id, canonical_id), each pair once; dealt by recipe before, they are not shuffled again to be counted and joined."""
        part = self.table("part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("canonical_id"))
        lines = self.table("lineitem").select("l_partkey", F.col("l_orderkey").alias("recipe_id"))
        rows = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select("recipe_id", "canonical_id")
        return (rows.repartition("recipe_id") if by_recipe else rows).distinct()

    def places(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("province"), F.col("r_name").alias("region"))

    def recipes(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        p, s = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
        register = F.when(p.isin("1", "2"), "official").when(p.isin("3", "4"), "commercial").otherwise("domestic")
        confidence = F.when(s == "F", "high").when(s == "O", "medium").otherwise("low")
        return (
            o.join(c, o["o_custkey"] == c["c_custkey"])
            .join(self.places(), c["c_nationkey"] == F.col("n_nationkey"))
            .select(
                F.col("o_orderkey").alias("recipe_id"),
                register.alias("register"),
                F.col("c_mktsegment").alias("source_id"),
                "province",
                "region",
                confidence.alias("confidence"),
                F.when(s == "F", 1).when(s == "O", 2).otherwise(4).alias("tier"),
                F.to_date("o_orderdate").alias("published_at"),
            )
        )

    def mentions(self) -> DataFrame:
        """(source_id, register, recipe_id, raw): strings before mapping."""
        part = self.table("part").select("p_partkey", F.col("p_name").alias("raw"), "p_brand", "p_size")
        lines = self.table("lineitem").select("l_partkey", F.col("l_orderkey").alias("recipe_id"))
        rows = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select("recipe_id", "raw")
        return rows.join(self.recipes().select("recipe_id", "register", "source_id"), "recipe_id").select("source_id", "register", "recipe_id", "raw")


#: The same relations in DuckDB SQL, as the first part of a WITH list.
BASE_SQL = """
facts as (
  select distinct l_orderkey as recipe_id, p_brand || '/' || p_type as canonical_id
  from lineitem join part on l_partkey = p_partkey
),
recipes as (
  select o_orderkey as recipe_id,
         case when o_orderpriority[1] in ('1', '2') then 'official' when o_orderpriority[1] in ('3', '4') then 'commercial' else 'domestic' end as register,
         c_mktsegment as source_id, n_name as province, r_name as region,
         case o_orderstatus when 'F' then 'high' when 'O' then 'medium' else 'low' end as confidence,
         case o_orderstatus when 'F' then 1 when 'O' then 2 else 4 end as tier, cast(o_orderdate as date) as published_at
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
),
sized as (select recipe_id, count(*) as n_ingredients from facts group by recipe_id),
clean as (
  select r.*, n_ingredients from recipes r join sized using (recipe_id)
  where confidence in ('high', 'medium') and n_ingredients between 3 and 25
),
mentions as (
  select source_id, register, l_orderkey as recipe_id, p_name as raw
  from lineitem join part on l_partkey = p_partkey join recipes on l_orderkey = recipe_id
)"""
