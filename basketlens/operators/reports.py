"""Reports: status, readiness, inventories, and tracing numbers of a text to a table."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions import text


def guarded(read) -> DataFrame | None:
    """A part of a report that cannot be read, when planned or when run, is missing; the rest stands. Parts are few rows, which are read here."""
    try:
        df = read()
        return df.sparkSession.createDataFrame(df.collect(), df.schema)
    except (PySparkException, Py4JJavaError):
        return None


def readiness(done: Column, needed: Column, blocked: Column) -> Column:
    """yes, partial, no, n/a (nothing needed) or blocked."""
    return F.when(blocked, "blocked").when(needed == 0, "n/a").when(done >= needed, "yes").when(done > 0, "partial").otherwise("no")


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows, n_columns) in one pass per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


def inventory(df: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, field, n, n_filled): filled fields of each source."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(F.trim(F.col(c).cast("string")) != "").alias(c) for c in fields])
    return counts.unpivot([group, "n"], fields, "field", "n_filled")


def date_range(df: DataFrame, column: str) -> DataFrame:
    """(first, last, parseable, n) of a text column of dates."""
    d = F.try_to_timestamp(F.col(column).cast("string"))
    return df.agg(F.to_date(F.min(d)).alias("first"), F.to_date(F.max(d)).alias("last"), F.count(d).alias("parseable"), F.count("*").alias("n"))


def half_up(x: str, places: int) -> Decimal:
    return Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


def untraced(text: DataFrame, known: DataFrame) -> DataFrame:
    """(line, number): numbers of two digits or more in lines of a text that no known value gives when rounded half up.

    text: (line, value); known: (value string). Years are left out.
    """
    found = text.select("line", F.explode(F.regexp_extract_all("value", F.lit(r"\d+(?:\.\d+)?"), 0)).alias("number")).where(F.length(F.regexp_replace("number", r"\D", "")) >= 2)
    found = found.where(~F.col("number").rlike(r"^(19|20)\d\d$"))
    places = F.length(F.regexp_extract("number", r"\.(\d+)$", 1))
    numbers = found.select("line", "number", F.col("number").cast("decimal(30,10)").alias("n"), places.alias("places"))
    values = known.select(F.col("value").cast("decimal(30,10)").alias("v"))
    scaled = None
    for k in range(7):  # every number of decimals that texts give
        one = values.select(F.lit(k).alias("places"), F.round("v", k).cast("decimal(30,10)").alias("n"))
        scaled = one if scaled is None else scaled.unionByName(one)
    return numbers.join(scaled.distinct(), ["places", "n"], "left_anti").select("line", "number")


def empty_report(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "table string, n_rows bigint, n_columns int")


def extractors(texts: DataFrame) -> DataFrame:
    """(extractor, documents, failed, thai_chars, orphans, split_vowels, defects_per_1k) of texts (doc, extractor, text); a text that an extractor could not give is null."""
    t = text.nfc(F.col("text"))
    n = lambda pattern: F.coalesce(F.sum(F.regexp_count(t, F.lit(pattern))), F.lit(0))
    sums = texts.groupBy("extractor").agg(
        F.count("*").alias("documents"), F.count_if(F.col("text").isNull()).alias("failed"), n(r"[\u0e00-\u0e7f]").alias("thai_chars"),
        n(rf"(?U)\s[{text.COMBINING}]").alias("orphans"), n(r"(?U)[ก-ฮ]\s+า").alias("split_vowels"),
    )
    rate = F.coalesce(F.try_divide(1000.0 * (F.col("orphans") + F.col("split_vowels")), F.col("thai_chars")), F.lit(0.0))
    return sums.withColumn("defects_per_1k", F.round(rate, 2))


def source_audit(pages: DataFrame, source: str, signs: str, allowed: Column) -> DataFrame:
    """(source, pages, disallowed, with_metadata, hydrated, mean_text_share) of audited pages (pages.audit() in ``signs``); what robots disallow is counted and not read."""
    read = F.when(allowed, F.col(signs))
    return pages.groupBy(source).agg(
        F.count("*").alias("pages"), F.count_if(~allowed).alias("disallowed"), F.count_if(read["has_metadata"]).alias("with_metadata"), F.count_if(read["hydrated"]).alias("hydrated"),
        F.avg(read["text_share"]).alias("mean_text_share"),
    )


def mode_shares(lines: DataFrame, modes: str, unit: str, places: DataFrame, far: Column) -> DataFrame:
    """(unit, mode, share, km) of an array column: of a unit's coded rows, the share with each mode; places: (unit, lon, lat), far from lon and lat."""
    total = lines.where(F.size(modes) > 0).groupBy(unit).agg(F.count("*").alias("total"))
    n = lines.select(unit, F.explode(F.array_distinct(modes)).alias("mode")).groupBy(unit, "mode").agg(F.count("*").alias("n"))
    return n.join(total, unit).join(places.select(F.col("unit").alias(unit), far.alias("km")), unit).select(unit, "mode", F.try_divide("n", "total").alias("share"), "km")
