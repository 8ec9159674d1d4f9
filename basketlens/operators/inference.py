"""Bootstrap, permutation and jackknife of register distances.

Random draws are hashes: the first 32 bits of the MD5 of seed, stream, replicate and place. They do
not depend on partitioning, and SQL elsewhere can make the same ones; ``multinomial`` draws from a
NumPy generator instead. Either gives members with rep; ``replicated`` takes them to distances, with the
counts of many replicates side by side, so that facts are joined once for all of these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketlens.operators import profiles
from basketlens.operators.profiles import GROUP
from basketlens.operators.ranking import numbered, range_cell, spanned
from basketlens.session import settled

SEED = 42
EPSILON = 1e-12


def draw(stream: str, *parts: Column, seed: int = SEED) -> Column:
    """A number below 2**32 from the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draw_sql(stream: str, *parts: str, seed: int = SEED) -> str:
    text = " || '|' || ".join([f"'{seed}'", f"'{stream}'", *[f"cast({p} as varchar)" for p in parts]])
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


def replicates(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(first), F.lit(last))))


def hash_cell(c: Column) -> Column:
    """A cell of 1024, in the order of a draw."""
    return F.shiftright(c, 22)


#: Picks of a group that one row stands for until they are dealt to tasks.
PICKS = 1 << 14


def _placed(times: DataFrame, ranked: DataFrame) -> DataFrame:
    """Members of drawn places. Spark takes drawn places for few, since what they are made of is small: unhinted, they would all go through the driver."""
    return times.hint("merge").join(ranked, [*GROUP, "place"]).select("rep", *GROUP, "recipe_id", "mult")


def bootstrap(members: DataFrame, last: int, first: int = 1) -> DataFrame:
    """Every group resampled to its own size with replacement, once for each replicate: members with rep."""
    ranked = numbered(members.select(*GROUP, "recipe_id"), GROUP, ["recipe_id"], range_cell(members, "recipe_id"))
    sizes = ranked.groupBy(*GROUP).agg(F.count("*").alias("size"))
    lots = replicates(sizes, first, last).withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(PICKS).cast("bigint"))))
    lots = lots.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # groups are few, so their picks would be made by few tasks
    picks = lots.withColumn("i", F.explode(F.sequence("start", F.least(F.col("start") + PICKS, F.col("size")) - 1)))
    picks = picks.withColumn("place", draw("boot", F.col("rep"), F.col("register"), F.col("unit"), F.col("i")) % F.col("size"))
    dealt = picks.select("rep", *GROUP, "place").repartition(*GROUP, "place")  # serves the counts and the join
    return _placed(dealt.groupBy("rep", *GROUP, "place").agg(F.count("*").alias("mult")), ranked)


def multinomial(members: DataFrame, last: int, first: int = 1, stream: int = 0, seed: int = SEED) -> DataFrame:
    """As bootstrap(), each replicate from a NumPy generator of its own over the groups in order. A task holds one group's counts at a time."""
    ranked = numbered(members.select(*GROUP, "recipe_id"), GROUP, ["recipe_id"], range_cell(members, "recipe_id"))
    groups = [tuple(r) for r in ranked.groupBy(*GROUP).agg(F.count("*")).orderBy(*GROUP).collect()]  # as many rows as registers and units make

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rep in (int(r) for b in batches for r in b["rep"]):
            rng = np.random.default_rng([seed, stream, rep])
            for register, unit, size in groups:
                mult = rng.multinomial(size, np.full(size, 1 / size))
                place = np.flatnonzero(mult)
                yield pd.DataFrame({"rep": rep, "register": register, "unit": unit, "place": place, "mult": mult[place]})

    reps = members.sparkSession.range(first, last + 1, 1, min(last - first + 1, 64)).withColumnRenamed("id", "rep")
    times = reps.mapInPandas(run, "rep int, register string, unit string, place bigint, mult bigint")
    return _placed(times, ranked)


def permute_registers(members: DataFrame, left: str, right: str, last: int, first: int = 1) -> DataFrame:
    """Within each unit, the pair's labels shuffled; other registers stay."""
    pair = members.where(F.col("register").isin(left, right))
    n_left = F.count_if(F.col("register") == left)
    ends = F.array(F.struct(n_left.alias("upto"), F.lit(left).alias("span")), F.struct(F.count("*").alias("upto"), F.lit(right).alias("span")))
    spans = pair.groupBy("unit").agg(ends.alias("e")).select("unit", F.inline("e")).where("upto > 0")
    spans = spans.groupBy("unit", "upto").agg(F.min_by("span", F.when(F.col("span") == left, 0).otherwise(1)).alias("span"))  # a unit without right ends with left
    drawn = replicates(pair, first, last).withColumn("h", draw("register", F.col("rep"), F.col("recipe_id"))).withColumnRenamed("register", "was")
    drawn = spanned(drawn, ["rep", "unit"], ["h", "recipe_id", "was"], hash_cell(F.col("h")), spans).withColumnRenamed("span", "register")
    fixed = replicates(members.where(~F.col("register").isin(left, right)), first, last)
    columns = ["rep", *GROUP, "recipe_id", "mult"]
    return drawn.select(*columns).unionByName(fixed.select(*columns))


def permute_units(members: DataFrame, last: int, first: int = 1) -> DataFrame:
    """Within each register, the unit labels shuffled; sizes stay."""
    sizes = members.groupBy(*GROUP).agg(F.count("*").alias("size"))
    spans = sizes.select("register", F.sum("size").over(Window.partitionBy("register").orderBy("unit")).alias("upto"), F.col("unit").alias("span"))
    drawn = replicates(members, first, last).withColumn("h", draw("unit", F.col("rep"), F.col("recipe_id"))).withColumnRenamed("unit", "was")
    placed = spanned(drawn, ["rep", "register"], ["h", "recipe_id", "was"], hash_cell(F.col("h")), spans)
    return placed.select("rep", "register", F.col("span").alias("unit"), "recipe_id", "mult")


#: Replicates whose counts stand side by side.
BLOCK = 50


def replicated(drawn: Callable[[int, int], DataFrame], facts: DataFrame, n: int, weighting: str, left: str, right: str) -> DataFrame:
    """register_distances() of n replicates with rep; drawn(last, first) gives members with rep.

    Facts are joined once for every BLOCK replicates, with a column of counts for each; only the
    counts per group and ingredient, which are few, become rows again.
    """
    out = None
    for first in range(1, n + 1, BLOCK):
        reps = range(first, min(first + BLOCK, n + 1))
        names = [f"m{r}" for r in reps]
        each = lambda make: F.array(*[F.struct(F.lit(r).alias("rep"), make(f"m{r}").alias("x")) for r in reps])  # noqa: B023, E731
        wide = drawn(reps[-1], first).groupBy(*GROUP, "recipe_id").agg(*[F.sum(F.when(F.col("rep") == r, F.col("mult"))).alias(m) for r, m in zip(reps, names)])
        hits = wide.join(facts, "recipe_id").groupBy(*GROUP, "canonical_id").agg(*[F.sum(m).alias(m) for m in names])
        hits = hits.select(*GROUP, "canonical_id", F.inline(each(F.col))).where("x > 0").withColumnRenamed("x", "hits")
        sizes = wide.groupBy(*GROUP).agg(*[F.sum(m).alias(m) for m in names]).select(*GROUP, F.inline(each(F.col))).where("x > 0").withColumnRenamed("x", "n_recipes")
        keys = ["rep", *GROUP]
        p = hits.join(sizes, keys).select(*keys, "canonical_id", "n_recipes", (F.col("hits") / F.col("n_recipes")).alias("prevalence"))
        one = profiles.distances(profiles.weighted(p, weighting, ["rep"]), left, right, ["rep"])
        out = one if out is None else out.unionByName(one)
    return out


def p_values(observed: DataFrame, null: DataFrame) -> DataFrame:
    """(1 + null distances that reach the observed one) / (1 + those there are), per unit."""
    both = null.select("unit", F.col("distance").alias("d0")).join(observed.select("unit", "distance"), "unit").where("distance is not null and d0 is not null")
    return both.groupBy("unit").agg(((1 + F.count_if(F.col("d0") >= F.col("distance") - EPSILON)) / (1 + F.count("*"))).alias("p"))


def holm(p: DataFrame, family: list[str], key: str) -> DataFrame:
    """p with p_holm: step-down over each family; null and NaN p-values are left out of it and stay null."""
    known = p.where(F.col("p").isNotNull() & ~F.isnan("p"))
    order = Window.partitionBy(*family).orderBy("p", key)
    whole = Window.partitionBy(*family)
    step = (F.count("*").over(whole) - F.row_number().over(order) + 1) * F.col("p")
    adjusted = known.withColumn("step", step).withColumn("p_holm", F.least(F.lit(1.0), F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return p.join(adjusted.select(*family, key, "p_holm"), [*family, key], "left")


def intervals(draws: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Percentile interval, mean and standard error of each unit's draws."""
    d = F.col("distance")
    return draws.where(d.isNotNull()).groupBy("unit").agg(
        F.count("*").alias("n_draws"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("se"),
        F.percentile(d, F.lit(alpha / 2)).alias("lo"), F.percentile(d, F.lit(1 - alpha / 2)).alias("hi"),
    )


def evidence(observed: DataFrame, draws: DataFrame, alpha: float = 0.05) -> DataFrame:
    """intervals() with the observed distance, bias, and the share of draws below it (ties count half)."""
    both = draws.select("unit", F.col("distance").alias("d")).join(observed.select("unit", "distance"), "unit").where("d is not null and distance is not null")
    share = both.groupBy("unit").agg(((F.count_if(F.col("d") < F.col("distance")) + 0.5 * F.count_if(F.col("d") == F.col("distance"))) / F.count("*")).alias("share"))
    stats = intervals(draws, alpha).join(observed, "unit").join(share, "unit")
    return stats.withColumn("bias", F.col("mean") - F.col("distance")).withColumn("outside", (F.col("distance") < F.col("lo")) | (F.col("distance") > F.col("hi")))


def more_evidence(e: DataFrame) -> DataFrame:
    """evidence() with the basic interval and the bias-corrected point, both mirrored at the observed distance."""
    twice = 2 * F.col("distance")
    return e.withColumns({"basic_lo": twice - F.col("hi"), "basic_hi": twice - F.col("lo"), "bc_point": twice - F.col("mean")})


def bias_corrected(draws: np.ndarray, observed: float, alpha: float = 0.05, acceleration: float = 0.0) -> tuple[float, float]:
    """Bias-corrected (and accelerated) interval of one unit's draws."""
    b = np.sort(draws[np.isfinite(draws)])
    if not b.size or not np.isfinite(observed):
        return float("nan"), float("nan")
    normal, n = NormalDist(), b.size
    share = ((b < observed).sum() + 0.5 * (b == observed).sum()) / n
    z0 = normal.inv_cdf(min(max(share, 1 / (n + 1)), n / (n + 1)))
    ends = []
    for q in (alpha / 2, 1 - alpha / 2):
        z = z0 + normal.inv_cdf(q)
        ends.append(float(np.quantile(b, normal.cdf(z0 + z / (1 - acceleration * z)))))
    return ends[0], ends[1]


def bias_corrected_intervals(observed: DataFrame, draws: DataFrame, alpha: float = 0.05, acceleration: DataFrame | None = None) -> DataFrame:
    """bc_lo and bc_hi per unit; with acceleration (unit, a) the BCa interval."""
    df = draws.select("unit", F.col("distance").alias("draw")).join(observed.select("unit", "distance"), "unit")
    df = df.withColumn("a", F.lit(0.0)) if acceleration is None else df.join(acceleration.select("unit", "a"), "unit", "left").fillna(0.0, ["a"])

    def one(g: pd.DataFrame) -> pd.DataFrame:
        lo, hi = bias_corrected(g["draw"].to_numpy(float), float(g["distance"].iloc[0]) if pd.notna(g["distance"].iloc[0]) else float("nan"), alpha, float(g["a"].iloc[0]))
        return pd.DataFrame({"unit": [g["unit"].iloc[0]], "bc_lo": [lo], "bc_hi": [hi]})

    return df.groupBy("unit").applyInPandas(one, "unit string, bc_lo double, bc_hi double")


#: Rows of profiles that are sent to every task.
SENT = 200_000


def jackknife(members: DataFrame, facts: DataFrame, left: str, right: str) -> DataFrame:
    """(left_out, unit, n_left, n_right, distance) of TF-IDF profiles with each recipe of the pair left out in turn.

    Leaving a recipe out scales its side and changes the terms of its own ingredients only: of one
    that others of the side have, its count; of one that only it has, the document frequency as well,
    and so the other side's weight. So each distance follows from the unit's sums and that recipe's
    rows, and nothing is recomputed or crossed. Sides under two recipes are skipped. Profiles, a row for
    each group and ingredient, are computed once; the recipes' rows meet them, with the sums, in one join.
    """
    p = settled(profiles.prevalence(members, facts))
    df = profiles.document_frequency(p)
    groups = F.broadcast(p.select("register", "unit").distinct().agg(F.count("*").alias("g")))
    idf = lambda d: F.ln((1 + F.col("g")) / (1 + d)) + 1
    w = p.where(F.col("register").isin(left, right)).join(df, "canonical_id").crossJoin(groups)
    w = w.select("register", "unit", "canonical_id", "n_recipes", "prevalence", "df", "g", (F.col("prevalence") * idf(F.col("df"))).alias("w"))
    other = w.select(F.when(F.col("register") == left, right).otherwise(left).alias("register"), "unit", "canonical_id", F.col("prevalence").alias("po"), F.col("w").alias("wo"))
    both = w.join(other, ["register", "unit", "canonical_id"], "left").fillna(0.0, ["po", "wo"])
    sums = both.groupBy("register", "unit").agg(F.max("n_recipes").alias("n"), F.sum(F.col("w") * F.col("w")).alias("ss"), F.sum(F.col("w") * F.col("wo")).alias("dot"))
    opposite = sums.select(F.when(F.col("register") == left, right).otherwise(left).alias("register"), "unit", F.col("ss").alias("oo"), F.col("n").alias("no"))
    sums = sums.join(opposite, ["register", "unit"]).where("n >= 2")
    f, n = F.col("n") / (F.col("n") - 1), F.col("n")
    known = both.drop("n_recipes").join(sums, ["register", "unit"])
    rows = members.where(F.col("register").isin(left, right)).join(facts, "recipe_id").join(F.broadcast(known) if p.count() <= SENT else known, ["register", "unit", "canonical_id"])
    hits = F.round(F.col("prevalence") * n)
    alone = hits == 1
    now = F.when(alone, 0.0).otherwise((hits - 1) / (n - 1) * idf(F.col("df")))
    other_now = F.when(alone, F.col("po") * idf(F.col("df") - 1)).otherwise(F.col("wo"))
    steps = rows.groupBy(F.col("recipe_id").alias("left_out"), "register", "unit").agg(
        F.sum(now * other_now - f * F.col("w") * F.col("wo")).alias("d_dot"),
        F.sum(now * now - f * f * F.col("w") * F.col("w")).alias("d_ss"),
        F.sum(other_now * other_now - F.col("wo") * F.col("wo")).alias("d_oo"),
        *[F.max(x).alias(x) for x in ("n", "no", "ss", "dot", "oo")],  # the same in all rows of a group
    )
    far = profiles.cosine(f * F.col("dot") + F.col("d_dot"), f * f * F.col("ss") + F.col("d_ss"), F.col("oo") + F.col("d_oo"))
    mine = F.col("register") == left
    return steps.select("left_out", "unit", F.when(mine, n - 1).otherwise(F.col("no")).alias("n_left"), F.when(mine, F.col("no")).otherwise(n - 1).alias("n_right"), far.alias("distance"))


def acceleration(left_out: DataFrame) -> DataFrame:
    """Per unit, from distances with one recipe left out each: sum(d^3) / (6 sum(d^2)^1.5), d being mean less value."""
    mean = F.avg("distance").over(Window.partitionBy("unit"))
    d = left_out.where("distance is not null").select("unit", (mean - F.col("distance")).alias("d"))
    return d.groupBy("unit").agg(F.coalesce(F.try_divide(F.sum(F.col("d") ** 3), 6 * F.sum(F.col("d") ** 2) ** 1.5), F.lit(0.0)).alias("a"))


def bootstrap_kernel(facts: DataFrame, weighting: str, n: int, left: str = "official", right: str = "commercial") -> DataFrame:
    """(unit, rep, distance) of n replicates drawn by NumPy, for facts (register, unit, recipe_id, canonical_id) of any number; units without a side are left out."""
    members = facts.select(*GROUP, "recipe_id").distinct().withColumn("mult", F.lit(1).cast("bigint"))
    pairs = facts.select("recipe_id", "canonical_id").distinct()
    far = replicated(lambda last, first: multinomial(members, last, first), pairs, n, weighting, left, right)
    return far.where("n_left > 0 and n_right > 0").select("unit", "rep", "distance")
