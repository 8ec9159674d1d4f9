"""What goes out: release tables with their checks and blockers, freezing, rebuilds, and reversible swaps."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketlens.functions import privacy, text


def withheld(rows: DataFrame, source: str, sources: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows of sources that may go out, and (what, n) of those that may not: counted, never written."""
    held = F.coalesce(F.col(source).isin(*sources), F.lit(False))
    return rows.where(~held), rows.agg(F.count_if(held).alias("n")).select(F.lit(f"rows of {', '.join(sources)}").alias("what"), "n")


def released_variants(aliases: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases (key, canonical_id) that stand in a released line (key), and (what, n) of the others."""
    seen = lines.select("key").distinct()
    return aliases.join(seen, "key", "left_semi"), aliases.join(seen, "key", "left_anti").agg(F.count("*").alias("n")).select(F.lit("variants not in a released source").alias("what"), "n")


@dataclass
class Release:
    """Tables by name, and what each must satisfy."""

    tables: dict[str, DataFrame]
    schemas: dict[str, StructType] = field(default_factory=dict)
    glossed: dict[str, str] = field(default_factory=dict)
    absent: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)

    def checks(self) -> DataFrame:
        """(name, passed, detail): columns as agreed, names glossed, no withheld source, no personal data."""
        spark = next(iter(self.tables.values())).sparkSession
        fixed = [(f"{t}: columns", [(f.name, f.dataType.simpleString()) for f in s] == self.tables[t].dtypes, ", ".join(self.tables[t].columns)) for t, s in self.schemas.items()]
        out = spark.createDataFrame(fixed, "name string, passed boolean, detail string")
        for t, column in self.glossed.items():
            n = self.tables[t].agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce(column, F.lit(""))) != "").alias("g"))
            out = out.unionByName(n.select(F.lit(f"{t}: glossed").alias("name"), (F.col("n") == F.col("g")).alias("passed"), F.format_string("%d of %d", "g", "n").alias("detail")))
        for t, (column, values) in self.absent.items():
            n = self.tables[t].agg(F.count_if(F.col(column).isin(*values)).alias("n"))
            out = out.unionByName(n.select(F.lit(f"{t}: nothing withheld").alias("name"), (F.col("n") == 0).alias("passed"), F.format_string("%d rows", "n").alias("detail")))
        for t, df in self.tables.items():
            n = privacy.scan(df, t).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"))
            out = out.unionByName(n.select(F.lit(f"{t}: no personal data").alias("name"), (F.col("n") == 0).alias("passed"), F.format_string("%d rows", "n").alias("detail")))
        return out

    def counts(self) -> DataFrame:
        out = None
        for t, df in self.tables.items():
            one = df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table"), "n_rows")
            out = one if out is None else out.unionByName(one)
        return out


def blockers(checks: DataFrame, open_: list[str]) -> DataFrame:
    """(blocker) of what stands in the way: failed checks, and what people have left open."""
    failed = checks.where(~F.col("passed")).select(F.concat(F.lit("check failed: "), "name").alias("blocker"))
    return failed.unionByName(checks.sparkSession.createDataFrame([(x,) for x in open_], "blocker string"))


def rebuilt(existing: DataFrame, new: DataFrame, key: list[str], validated: str) -> tuple[DataFrame, DataFrame]:
    """All rows of new but where a person has validated one with its key, which stays; and (key..., n) of what collided.

    Not validated rows of existing go.
    """
    kept = existing.where(F.coalesce(F.col(validated), F.lit(False)))
    keys = kept.select(*key).distinct()
    collided = new.join(keys, key, "left_semi").groupBy(*key).agg(F.count("*").alias("n"))
    return kept.unionByName(new.join(keys, key, "left_anti"), allowMissingColumns=True), collided


def coded(lines: DataFrame, coding: DataFrame, column: str, key: str, code: str) -> tuple[DataFrame, DataFrame]:
    """lines with an array column set anew: reset, then the union of the codes of a row's strings; and read back (n_rows, n_coded).

    lines: key, strings (array); coding: (string, codes). Rows without a coded string have null.
    """
    each = lines.select(key, F.explode("strings").alias("string")).join(coding, "string")
    found = each.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(code)))).alias(column))
    out = lines.drop(column).join(found, key, "left")
    return out, out.agg(F.count("*").alias("n_rows"), F.count(column).alias("n_coded"))


def content_digest(df: DataFrame, group: list[str] = []) -> DataFrame:  # noqa: B006
    """(group..., n_rows, digest): SHA-256 over the sums of the rows' SHA-256 in four parts, so that order does not matter and every copy counts."""
    shown = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns]
    row = F.sha2(F.concat_ws("\x1f", *shown), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    sums = df.groupBy(*group).agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("0")) for p in parts]), 256).alias("digest"))
    return sums.select(*group, "n_rows", "digest")


def freeze(tables: dict[str, DataFrame], counted: DataFrame, group: list[str], preconditions: dict[str, bool]) -> tuple[DataFrame, DataFrame]:
    """(table, n_rows, digest) of every table and (group..., n_rows, digest) of the counted one; refused with all that fails while a precondition does not hold."""
    failed = sorted(k for k, ok in preconditions.items() if not ok)
    failed += [f"{t}: {r['class']} ({r['n_rows']})" for t, df in tables.items() for r in privacy.scan(df, t).collect()]  # classes per table
    if failed:
        raise ValueError("not frozen: " + "; ".join(failed))
    out = None
    for t, df in tables.items():
        one = content_digest(df).select(F.lit(t).alias("table"), "n_rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out, content_digest(counted, group)


def health(tables: dict[str, DataFrame]) -> dict[str, int | None]:
    """Row counts only, for a status page; a table that cannot be read is None."""
    from basketlens.operators.reports import guarded

    out: dict[str, int | None] = {}
    for name, df in tables.items():
        rows = guarded(lambda df=df: df.agg(F.count("*").alias("n")))
        out[name] = None if rows is None else rows.first()["n"]
    return out


class Files:
    """Renames and deletes in the file system of a folder, each checked."""

    def __init__(self, spark, folder: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def move(self, old: str, new: str) -> None:
        self.fs.mkdirs(self.path(new).getParent())
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"could not move {old}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def swap(spark, folder: str, staged: dict[str, str]) -> None:
    """Puts staged folders in the place of tables, all or none: old ones are set aside first, and come back if any move fails."""
    files, aside, done = Files(spark, folder), f"{folder}/_aside-{uuid.uuid4().hex}", []
    try:
        for name, new in staged.items():
            if files.exists(f"{folder}/{name}"):
                files.move(f"{folder}/{name}", f"{aside}/{name}")
                done.append((f"{aside}/{name}", f"{folder}/{name}"))
            files.move(new, f"{folder}/{name}")
            done.append((f"{folder}/{name}", new))
    except Exception:
        for now, before in reversed(done):
            files.move(now, before)
        raise
    finally:
        files.remove(aside)


def append(folder: str, name: str, new: DataFrame, valid) -> None:
    """A table with more rows, if valid(table) holds for the whole of it; otherwise it stays as it was."""
    spark = new.sparkSession
    files, staging = Files(spark, folder), f"{folder}/_staging-{uuid.uuid4().hex}"
    try:
        old = spark.read.parquet(f"{folder}/{name}") if files.exists(f"{folder}/{name}") else None
        (new if old is None else old.unionByName(new)).write.parquet(f"{staging}/{name}")
        if not valid(spark.read.parquet(f"{staging}/{name}")):
            raise ValueError(f"{name}: not valid with the new rows")
        swap(spark, folder, {name: f"{staging}/{name}"})
    finally:
        files.remove(staging)


def public(report: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    """A report without the columns that list names."""
    return report.select(*[c for c in report.columns if c not in hidden])


def quantity_shown(grams: Column, has: Column) -> Column:
    """As a sheet shows it: grams, a quantity that is not converted, or none."""
    plain = F.regexp_replace(grams.cast("decimal(18,6)").cast("string"), r"\.?0+$", "")
    return F.when(grams.isNotNull(), F.concat(plain, F.lit(" g"))).when(has, "quantity not converted").otherwise("no quantity")


def cooking_sheet(rows: DataFrame) -> DataFrame:
    """(recipe_id, line, shown) of rows (recipe_id, category, name, quantity, modes): by category, then name; source text is not among the columns."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("recipe_id").orderBy("category", "name")
    shown = F.concat_ws(" | ", "category", "name", "quantity", F.array_join("modes", " + "))
    return rows.select("recipe_id", F.row_number().over(order).cast("long").alias("line"), shown.alias("shown"))


def source_domain(url: Column) -> Column:
    return text.host_of(url)
