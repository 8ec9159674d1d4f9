"""Ranks, shares, sweeps, histograms, snapshots: what reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sweep(counts: DataFrame, group: list[str], least: int, most: int) -> DataFrame:
    """How many rows of (group..., n) reach each threshold, both ends inclusive, zeros kept."""
    levels = counts.sparkSession.range(least, most + 1).select(F.col("id").cast("int").alias("threshold"))
    return counts.crossJoin(F.broadcast(levels)).groupBy("threshold", *group).agg(F.count_if(F.col("n") >= F.col("threshold")).alias("n_units"))


def coverage(recipes: DataFrame, unit: str, source: str, labelled: Column) -> DataFrame:
    """Rows, labelled rows, and the largest source of each unit (ties: first by name)."""
    per = recipes.groupBy(unit, source).agg(F.count("*").alias("n"), F.count_if(labelled).alias("l"))
    top = F.min(F.struct((-F.col("n")).alias("n"), F.col(source).alias("s")))
    out = per.groupBy(unit).agg(F.sum("n").alias("recipe_count"), F.sum("l").alias("labelled_count"), top.alias("top"), F.count("*").alias("distinct_sources"))
    share = F.col("labelled_count") / F.col("recipe_count")
    return out.select(unit, "recipe_count", "labelled_count", share.alias("labelled_fraction"), F.col("top.s").alias("top_source_id"), (-F.col("top.n") / F.col("recipe_count")).alias("top_source_share"), "distinct_sources")


def unordered_pairs(df: DataFrame, column: str) -> DataFrame:
    """Each pair of different values once; for short lists."""
    a, b = df.select(F.col(column).alias("a")).distinct(), df.select(F.col(column).alias("b")).distinct()
    return a.join(F.broadcast(b), F.col("a") < F.col("b"))


def ranked(counts: DataFrame, key: str, n: str = "n", group: list[str] = []) -> DataFrame:  # noqa: B006
    """counts with rank (by n descending, key) and running share of the total.

    Ranks over the whole list need it in one order: meant for vocabularies, one row per string.
    """
    order = Window.partitionBy(*group).orderBy(F.desc(n), key)
    whole = Window.partitionBy(*group)
    running = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("rank", F.row_number().over(order)).withColumn("cum_share", running / F.sum(n).over(whole))


def numbered(df: DataFrame, group: list[str], order: list[str], cell: Column) -> DataFrame:
    """df with ``place``, from 0 in each group by the order; no task holds more than a cell of a group.

    cell must not fall where the order rises.
    """
    celled = df.withColumn("__cell", cell)
    counts = celled.groupBy(*group, "__cell").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*group, "__cell", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*group, "__cell").orderBy(*order)) - 1
    placed = celled.withColumn("__within", within).join(counts, [*group, "__cell"])
    return placed.withColumn("place", (F.col("__before") + F.col("__within")).cast("bigint")).select(*df.columns, "place")


def spanned(df: DataFrame, group: list[str], order: list[str], cell: Column, spans: DataFrame) -> DataFrame:
    """df with ``span``: in which of a group's spans a row's place, as of numbered(), is. spans: (some of the group's columns, upto, span), places ``upto`` - size to ``upto`` - 1.

    Only the last row of each span is sought, in its cell alone; all others are compared with it. So no
    more than these cells is sorted, and no row is moved. The order must leave no ties.
    """
    on = [c for c in group if c in spans.columns]
    celled = df.withColumn("__cell", cell)
    counts = celled.groupBy(*group, "__cell").agg(F.count("*").alias("__n"))
    after = F.sum("__n").over(Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0))
    ends = counts.withColumn("__after", after).join(spans, on).where((F.col("upto") > F.col("__after") - F.col("__n")) & (F.col("upto") <= F.col("__after")))
    ends = ends.groupBy(*group, "__cell").agg(F.first(F.col("__after") - F.col("__n")).alias("__before"), F.collect_list(F.struct("upto", "span")).alias("__ends"))
    key = F.struct(*order)
    within = F.row_number().over(Window.partitionBy(*group, "__cell").orderBy(*order))
    sought = celled.join(F.broadcast(ends), [*group, "__cell"]).withColumn("__place", within + F.col("__before"))  # a row for each group and span, at most
    last = sought.select(*group, key.alias("key"), F.explode(F.filter("__ends", lambda e: e["upto"] == F.col("__place"))).alias("e"))
    last = last.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("key", F.col("e.span").alias("span")))).alias("__last"))
    span = F.get(F.filter("__last", lambda x: x["key"] >= key), F.lit(0))["span"]
    return df.join(F.broadcast(last), group).withColumn("span", span).drop("__last")


def range_cell(df: DataFrame, column: str, cells: int = 1024) -> Column:
    """A cell for numbered(), in the order of a column of whole numbers; of other columns there is one cell."""
    if df.schema[column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return F.lit(0)
    low, high = df.agg(F.min(column), F.max(column)).first()
    return F.floor((F.col(column) - F.lit(low or 0)) / max(1, ((high or 0) - (low or 0)) // cells + 1))


def rank_reaching(ranks: DataFrame, share: float, group: list[str] = []) -> DataFrame:  # noqa: B006
    """First rank whose running share reaches ``share``."""
    reach = F.min(F.when(F.col("cum_share") >= share, F.col("rank"))).alias("rank_reaching")
    return ranks.groupBy(*group).agg(reach).withColumn("share", F.lit(share))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__last")
    return rows.groupBy(*key).agg(best).select(*key, *[F.col(f"__last.{c}").alias(c) for c in rest])


def snapshot_delta(snapshots: DataFrame, scope: str, day: str, value: str) -> DataFrame:
    """Change since the newest strictly older snapshot of the scope."""
    before = F.lag(value).over(Window.partitionBy(scope).orderBy(day))
    return snapshots.withColumn("delta", F.col(value) - before)


def with_zeros(counts: DataFrame, values: list[str], column: str, n: str = "n") -> DataFrame:
    """One row per value of a fixed list, in its order, zeros included."""
    rows = [(i, v) for i, v in enumerate(values)]
    fixed = counts.sparkSession.createDataFrame(rows, f"place int, `{column}` string")
    return F.broadcast(fixed).join(counts, column, "left").select("place", column, F.coalesce(n, F.lit(0)).alias(n))


def over_ceiling(counts: DataFrame, column: str, value: str, ceiling: float, n: str = "n") -> DataFrame:
    """Share of one value, and whether it exceeds the ceiling (equal is allowed)."""
    share = F.sum(F.when(F.col(column) == value, F.col(n)).otherwise(0)) / F.sum(n)
    return counts.agg(share.alias("share"), (share > ceiling).alias("over"))


def histogram(values: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Half-open bins, the last one closed; empty bins stay."""
    bins = list(zip(edges, edges[1:]))
    which = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(bins))):
        inside = (F.col(column) >= lo) & ((F.col(column) <= hi) if i == len(bins) - 1 else (F.col(column) < hi))
        which = F.when(inside, i).otherwise(which)
    counts = values.select(which.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    fixed = values.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(bins)], "bin int, lo double, hi double")
    return fixed.join(counts, "bin", "left").fillna(0, ["n"])


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_filled, share): null and blank count as missing."""
    filled = df.agg(F.count("*").alias("n"), *[F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c) for c in columns])
    return filled.unpivot("n", columns, "field", "n_filled").select("field", "n_filled", F.try_divide("n_filled", "n").alias("share"))


def upper_median(values: DataFrame, group: list[str], column: str) -> DataFrame:
    """The element at n // 2 of the sorted values."""
    order = Window.partitionBy(*group).orderBy(column)
    placed = values.where(F.col(column).isNotNull()).select(*group, column, F.row_number().over(order).alias("i"), F.count("*").over(Window.partitionBy(*group)).alias("n"))
    return placed.where(F.col("i") == F.floor(F.col("n") / 2) + 1).select(*group, F.col(column).alias("median"))


def top_variance(weights: DataFrame, n: int) -> DataFrame:
    """Ingredients whose weight varies most between groups (population variance, absent is 0; ties by id)."""
    groups = weights.select("register", "unit").distinct().agg(F.count("*").alias("g"))
    sums = weights.groupBy("canonical_id").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q")).crossJoin(F.broadcast(groups))
    v = sums.select("canonical_id", ((F.col("q") - F.col("s") * F.col("s") / F.col("g")) / F.col("g")).alias("variance"))
    top = v.orderBy(F.desc(F.round("variance", 12)), "canonical_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("variance", 12)), "canonical_id")))


def grid(weights: DataFrame, columns: DataFrame) -> DataFrame:
    """Every group with every listed ingredient; a group that has recipes but not the ingredient weighs 0."""
    groups = weights.select("register", "unit").distinct()
    return groups.crossJoin(F.broadcast(columns)).join(weights.select("register", "unit", "canonical_id", "weight"), ["register", "unit", "canonical_id"], "left").fillna(0.0, ["weight"])


def full_grid(weights: DataFrame, columns: DataFrame, registers: list[str]) -> DataFrame:
    """grid() over all units in every register: a group without any recipe has null, not 0, so that figures share their axes."""
    groups = weights.select("register", "unit").distinct().withColumn("__has", F.lit(True))
    fixed = weights.sparkSession.createDataFrame([(r,) for r in registers], "register string")
    every = weights.select("unit").distinct().crossJoin(F.broadcast(fixed)).join(groups, ["register", "unit"], "left").crossJoin(F.broadcast(columns))
    cells = every.join(weights.select("register", "unit", "canonical_id", "weight"), ["register", "unit", "canonical_id"], "left")
    return cells.select("register", "unit", "canonical_id", F.when(F.col("__has"), F.coalesce("weight", F.lit(0.0))).alias("weight"))


def every_kth(df: DataFrame, group: list[str], order: list[str], step: int, most: int) -> DataFrame:
    """A stratified sample: every step-th row of each group, ``most`` at most."""
    i = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("i", i).where((F.pmod(F.col("i") - 1, F.lit(step)) == 0) & (F.col("i") <= step * most)).drop("i")


def first_filled(df: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
    """Blanks take the first non-blank value of their group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    value = F.nullif(F.trim(column), F.lit(""))
    return df.withColumn(column, F.coalesce(value, F.first(value, ignorenulls=True).over(w)))


def unconflicted(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The first row of each key; keys with more than one value go."""
    one = df.groupBy(key).agg(F.count_distinct(value).alias("v")).where("v = 1").select(key)
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.join(one, key, "left_semi").withColumn("__i", first).where("__i = 1").drop("__i")


def age_days(day: Column, today: Column) -> Column:
    return F.datediff(today, day)


def scaled(value: Column, low: Column, high: Column, out_low: float, out_high: float) -> Column:
    """Linear from one range to another; the middle where the range is empty."""
    share = F.when(high == low, F.lit(0.5)).otherwise((value - low) / (high - low))
    return out_low + share * (out_high - out_low)


def radius(value: Column, most: Column, largest: float) -> Column:
    """Of a circle whose area is in proportion to the value."""
    return largest * F.sqrt(F.try_divide(value, most))


def dated_sections(lines: DataFrame, file: str, line: str, value: str) -> DataFrame:
    """(file, n_dated, latest) of a Markdown log's lines: sections that carry at least one date field, and the latest date in the file."""
    order = Window.partitionBy(file).orderBy(line)
    day = F.regexp_extract(value, r"\*\*Date[^*]*:\*\*\s*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    rows = lines.withColumn("__section", F.sum(F.startswith(F.col(value), F.lit("## ")).cast("int")).over(order)).withColumn("__day", F.nullif(day, F.lit("")))
    per = rows.groupBy(file, "__section").agg(F.max("__day").alias("__day"))
    return per.groupBy(file).agg(F.count_if((F.col("__section") > 0) & F.col("__day").isNotNull()).alias("n_dated"), F.max("__day").alias("latest"))


def examples(rows: DataFrame, group: str, order: list[str], clean: Column, most: int) -> DataFrame:
    """``most`` rows, one of each group, of those that are clean."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.where(clean).withColumn("__i", first).where("__i = 1").drop("__i").orderBy(group).limit(most)
