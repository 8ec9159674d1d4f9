"""A study of labelled texts by region: who counts, in which cohort, and whether regions differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketlens.operators.inference import hash_cell
from basketlens.operators.ranking import numbered

LEAST = 8


def labelled(texts: DataFrame, confirmed: DataFrame, terms: DataFrame, key: str = "page_id") -> DataFrame:
    """texts with region and label_source: a label read by hand beats a region term; two terms make no label.

    confirmed: (page, region), pages with a ``view`` prefix; terms: (key, code). Without any confirmed
    label the join has gone wrong, so that is refused.
    """
    hand = confirmed.select(F.regexp_replace("page", "^view", "").alias(key), F.col("region").alias("by_hand"))
    if not hand.limit(1).count():
        raise ValueError("no confirmed labels")
    hand = hand.withColumn(key, F.col(key).cast(texts.schema[key].dataType))
    term = terms.groupBy(key).agg(F.count_distinct("code").alias("n"), F.min("code").alias("by_term")).where("n = 1").select(key, "by_term")
    out = texts.join(hand, key, "left").join(term, key, "left")
    source = F.when(F.col("by_hand").isNotNull(), "confirmed").when(F.col("by_term").isNotNull(), "term")
    return out.withColumn("region", F.coalesce("by_hand", "by_term")).withColumn("label_source", source).drop("by_hand", "by_term")


def cohorts(texts: DataFrame, sections: str, bounds: dict[str, int], least: int = LEAST) -> DataFrame:
    """(cohort, texts' columns) of labelled texts by their number of sections; cohorts under ``least`` texts are left out."""
    names = F.filter(F.array(*[F.when(F.col(sections) <= most, name) for name, most in bounds.items()]), lambda x: x.isNotNull())
    rows = texts.where("region is not null").withColumn("cohort", F.explode(names))
    enough = rows.groupBy("cohort").count().where(F.col("count") >= least).select("cohort")
    return rows.join(enough, "cohort", "left_semi")


def separations(units: DataFrame, groups: DataFrame) -> DataFrame:
    """(test, n, within, between, separation) of the mean cosine distance within and between regions.

    units: (test, id, region, term, value), vectors of length one; groups: (test, id, region). Sums of
    vectors give both means, so no pair is formed; vectors of zeros count as members.
    """
    sums = units.groupBy("test", "term", "region").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("d"))
    terms = sums.groupBy("test", "term").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.sum("d").alias("d"), F.sum("s").alias("s"))
    dots = terms.groupBy("test").agg(((F.sum("q") - F.sum("d")) / 2).alias("dot_in"), ((F.sum(F.col("s") * F.col("s")) - F.sum("d")) / 2).alias("dot_all"))
    sizes = groups.groupBy("test", "region").agg(F.count("*").alias("m"))
    n = sizes.groupBy("test").agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs_in"))
    x = n.join(dots, "test", "left").fillna(0.0, ["dot_in", "dot_all"])
    pairs = F.col("n") * (F.col("n") - 1) / 2 - F.col("pairs_in")
    w, b = 1 - F.try_divide("dot_in", "pairs_in"), 1 - F.try_divide(F.col("dot_all") - F.col("dot_in"), pairs)
    return x.select("test", "n", w.alias("within"), b.alias("between"), (b - w).alias("separation"))


def tests(groups: DataFrame, least: int = LEAST) -> DataFrame:
    """groups (id, region) of each test: all regions, each pair of them, and all but each one; too small ones are left out."""
    regions = groups.select("region").distinct()
    a, b = regions.select(F.col("region").alias("a")), regions.select(F.col("region").alias("b"))
    every = groups.select(F.lit("all").alias("test"), "id", "region")
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b"))  # a short list
    pairwise = groups.join(F.broadcast(pairs), F.col("region").isin(F.col("a"), F.col("b"))).select(F.concat_ws("|", F.lit("pair"), "a", "b").alias("test"), "id", "region")
    without = groups.join(F.broadcast(a), F.col("region") != F.col("a")).select(F.concat_ws("|", F.lit("without"), "a").alias("test"), "id", "region")
    rows = every.unionByName(pairwise).unionByName(without)
    enough = rows.groupBy("test").agg(F.count("*").alias("n"), F.count_distinct("region").alias("r")).where((F.col("r") > 1) & (F.startswith(F.col("test"), F.lit("pair")) | (F.col("n") >= least))).select("test")
    return rows.join(enough, "test", "left_semi")


def permuted(groups: DataFrame, draw: Column, n: int) -> DataFrame:
    """groups (test, id, region) with rep 0 as it is and regions shuffled within each test for reps 1 to n; draw is a number from test, rep and id."""
    reps = groups.select("test", "id").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("h", draw)
    placed = numbered(reps, ["test", "rep"], ["h", "id"], hash_cell(F.col("h")))
    sizes = groups.groupBy("test", "region").agg(F.count("*").alias("m"))
    spans = sizes.groupBy("test").agg(F.array_sort(F.collect_list(F.struct("region", "m"))).alias("l"))
    upto = F.transform("l", lambda x, i: F.struct(F.aggregate(F.slice("l", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, y: s + y["m"]).alias("hi"), x["region"].alias("region")))
    region = F.get(F.filter(upto, lambda x: x["hi"] > F.col("place")), F.lit(0))["region"]
    moved = placed.join(spans, "test").select("test", "id", region.alias("region"), "rep")
    return groups.select("test", "id", "region", F.lit(0).alias("rep")).unionByName(moved)


def judged(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(test, n, separation, p, lo, hi, p_holm, significant) from separations (test, rep, n, separation), rep 0 being the observed one.

    lo and hi are percentiles of the null; p is significant only below alpha; pairs are adjusted as one family.
    """
    null = F.when(F.col("rep") > 0, F.col("separation"))
    g = results.groupBy("test").agg(
        F.max(F.when(F.col("rep") == 0, F.col("n"))).alias("n"), F.max(F.when(F.col("rep") == 0, F.col("separation"))).alias("separation"), F.collect_list(null).alias("null"),
        F.percentile(null, F.lit(alpha / 2)).alias("lo"), F.percentile(null, F.lit(1 - alpha / 2)).alias("hi"),
    )
    reach = F.size(F.filter("null", lambda x: x >= F.col("separation") - 1e-12))
    is_pair = F.startswith(F.col("test"), F.lit("pair"))
    p = g.withColumn("p", (1 + reach) / (1 + F.size("null"))).withColumn("family", F.when(is_pair, "pairs").otherwise(F.col("test")))
    order, whole = Window.partitionBy("family").orderBy("p", "test"), Window.partitionBy("family")
    step = (F.count("*").over(whole) - F.row_number().over(order) + 1) * F.col("p")
    adjusted = p.withColumn("step", step).withColumn("p_holm", F.when(is_pair, F.least(F.lit(1.0), F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))))
    return adjusted.select("test", "n", "separation", "p", "lo", "hi", "p_holm", (F.coalesce("p_holm", "p") < alpha).alias("significant"))


def caption(units: Column, total: int, what: str = "provinces") -> Column:
    return F.format_string(f"n = %d of {total} {what}", units)


def drawn(weights: DataFrame) -> DataFrame:
    """Registers that have anything to draw; one without gets no panel."""
    return weights.where("weight > 0").select("register").distinct()


def pair_points(judged_: DataFrame, places: DataFrame, distance: Column) -> DataFrame:
    """Each pair of regions with its distance and how it is drawn: filled if significant. places: (region, lon, lat); distance from a_lon, a_lat, b_lon, b_lat."""
    pairs = judged_.where(F.startswith(F.col("test"), F.lit("pair"))).withColumns({"a": F.split_part("test", F.lit("|"), F.lit(2)), "b": F.split_part("test", F.lit("|"), F.lit(3))})
    of = lambda x: F.broadcast(places.select(F.col("region").alias(x), F.col("lon").alias(f"{x}_lon"), F.col("lat").alias(f"{x}_lat")))  # noqa: E731  as many rows as regions
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "separation", distance.alias("km"), F.when(F.col("significant"), "filled").otherwise("open").alias("mark"))
