"""Readers with exact headers and column lists, payload unnesting, upserts, snapshots, staged publishing."""

from __future__ import annotations

import json
import tomllib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from basketlens.functions import privacy, text
from basketlens.operators.ranking import latest
from basketlens.operators.release import Files, content_digest, swap


def exact_csv(spark: SparkSession, path: str, columns: list[str], kept: list[str] | None = None) -> DataFrame:
    """A CSV whose header must be ``columns`` in order (a byte order mark is fine); cells as keys; only ``kept`` columns are read on."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    found = [c.lstrip("﻿") for c in raw.columns]
    if found != columns:
        raise ValueError(f"{path}: header is not the expected one ({len(found)} columns, expected {len(columns)})")
    df = raw.toDF(*columns).select(*(kept or columns))
    return df.select(*[text.key(F.col(c)).alias(c) for c in df.columns])


def required_parquet(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table with at least these columns of these types, and only they."""
    df = spark.read.parquet(path)
    have = dict(df.dtypes)
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"{path}: missing or mistyped columns: {', '.join(wrong)}")
    return df.select(*schema.names)


def toml_records(spark: SparkSession, path: str, schema: str, build: Callable[[dict], dict]) -> DataFrame:
    """One row per TOML file, by name; names that begin with _ are skipped. A file that fails gives its error, never its values."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.where(~F.element_at(F.split("path", "/"), -1).startswith("_") & F.col("path").endswith(".toml"))

    names = ["path", "error", *StructType.fromDDL(schema).names]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    rows.append({"path": p, "error": None, **build(tomllib.loads(bytes(c).decode()))})
                except Exception as e:  # noqa: BLE001  one bad file does not stop the run
                    rows.append({"path": p, "error": type(e).__name__})
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(parse, f"path string, error string, {schema}").orderBy("path")


def payload(rows: DataFrame, key: str, column: str) -> DataFrame:
    return rows.select(key, F.from_json(column, "k bigint").alias("p")).select(key, F.col("p.k").alias("k"))


def ingredient_lines(raw: DataFrame, key: str = "recipe_id", column: str = "parsed_json") -> DataFrame:
    """(key, position, heading, raw) of both payload shapes; positions in sections are section * 1000 + item."""
    shape = "ingredients array<struct<name_th:string>>, sections array<struct<heading:string, items:array<string>>>"
    p = raw.select(key, F.from_json(column, shape).alias("p"))
    flat = p.select(key, F.posexplode("p.ingredients").alias("i", "x")).select(key, (F.col("i") + 1).alias("position"), F.lit(None).cast("string").alias("heading"), F.col("x.name_th").alias("raw"))
    deep = p.select(key, F.posexplode("p.sections").alias("s", "x")).select(key, "s", "x.heading", F.posexplode("x.items").alias("i", "raw"))
    return flat.unionByName(deep.select(key, ((F.col("s") + 1) * 1000 + F.col("i") + 1).alias("position"), "heading", "raw"))


def markdown_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a Markdown table with as many cells as columns, in file order (line)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"(?<!\\)\|"), lambda x: F.trim(x))
    rows = lines.where(F.trim("value").startswith("|")).withColumn("c", cells).where((F.size("c") == len(columns)) & ~F.col("value").rlike(r"^[\s|:\-]+$"))
    return rows.select("line", *[F.col("c")[i].alias(x) for i, x in enumerate(columns)])


def unsettled(wanted: DataFrame, manifest: DataFrame, key: str = "url", retry_empty: bool = False) -> DataFrame:
    """What a crawl still has to fetch, by the manifest's outcomes."""
    done = manifest.where(F.col("outcome").isin(*(["fetched"] if retry_empty else ["fetched", "empty"])))
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str], updated: list[str], order: list[str] = []) -> DataFrame:  # noqa: B006
    """old with new rows; where a key is there already only the ``updated`` columns change, and null changes nothing.

    Of new rows with one key the last by ``order`` counts, and of equal ones the greatest in all columns.
    """
    n = latest(new, key, order or [c for c in new.columns if c not in key]).alias("n")
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in updated or c in key else F.when(F.col("o.__in"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    o = old.withColumn("__in", F.lit(True)).alias("o")
    cond = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return o.join(n, on, "full").select(*[pick(c).alias(c) for c in old.columns])


def insert_new(old: DataFrame, new: DataFrame, key: list[str], order: list[str] = []) -> DataFrame:  # noqa: B006
    """old with those new rows whose key it has not."""
    return upsert(old, new, key, [], order)


def replaced(old: DataFrame, new: DataFrame, key: list[str], order: list[str] = []) -> DataFrame:  # noqa: B006
    """old with new rows in the place of those with their key, whole."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(latest(new, key, order or [c for c in new.columns if c not in key]))


def numbered_upsert(old: DataFrame, new: DataFrame, key: list[str], identity: str, order: list[str] = []) -> DataFrame:  # noqa: B006
    """As replaced(), with a number for each row: known keys keep theirs, new ones get the next in the order of their key."""
    most = old.agg(F.coalesce(F.max(identity), F.lit(0)).alias("__most"))
    known = old.select(*key, identity)
    rows = latest(new, key, order or [c for c in new.columns if c not in key]).join(known, key, "left")
    fresh = rows.where(F.col(identity).isNull()).select(*key).withColumn("__next", F.row_number().over(Window.orderBy(*key)))  # new keys of one load
    rows = rows.join(fresh, key, "left").crossJoin(F.broadcast(most)).withColumn(identity, F.coalesce(identity, F.col("__most") + F.col("__next"))).select(*old.columns)
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(rows)


def summed_upsert(old: DataFrame, new: DataFrame, key: list[str], counters: list[str]) -> DataFrame:
    """Counters of new rows added to those of old, key by key."""
    both = old.select(*key, *counters).unionByName(new.select(*key, *counters))
    return both.groupBy(*key).agg(*[F.sum(c).alias(c) for c in counters])


def not_in_files(old: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """Rows that the files no longer have: reported, never deleted."""
    return old.join(files.select(*key).distinct(), key, "left_anti")


def publish(frames: dict[str, DataFrame], folder: str) -> None:
    """All tables or none: written to a staging folder, scanned for personal data, then swapped in; what was there comes back if that fails."""
    spark = next(iter(frames.values())).sparkSession
    staging = f"{folder}/_staging-{uuid.uuid4().hex}"
    try:
        for name, df in frames.items():
            df.write.parquet(f"{staging}/{name}.parquet")
        leaks = [r for name in frames for r in privacy.scan(spark.read.parquet(f"{staging}/{name}.parquet"), name).collect()]  # classes per table
        if leaks:
            raise ValueError("not published: " + "; ".join(f"{r['table']}: {r['class']} ({r['n_rows']})" for r in leaks))
        swap(spark, folder, {f"{name}.parquet": f"{staging}/{name}.parquet" for name in frames})
    finally:
        Files(spark, folder).remove(staging)


def snapshot(df: DataFrame, folder: str, day: str, settings: dict) -> None:
    """A dated CSV of four decimals, NaN as empty, beside the settings that made it; df is a report."""
    numbers = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    shown = [F.when(F.col(c).isNull() | F.isnan(c), "").otherwise(F.format_string("%.4f", c)).alias(c) if c in numbers else F.col(c) for c in df.columns]
    df.select(*shown).coalesce(1).write.mode("overwrite").csv(f"{folder}/{day}.csv", header=True)
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{day}.json")


def merge_sheet(lines: DataFrame, existing: DataFrame, key: str, human: list[str]) -> DataFrame:
    """A coding sheet anew: counts from lines, human columns kept, vanished strings kept with n = 0."""
    return lines.join(existing.select(key, *human), key, "full").fillna(0, ["n"])


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows, digest): a digest of the rows that does not depend on their order, and to which every copy of a row counts."""
    out = None
    for name, df in tables.items():
        one = content_digest(df).select(F.lit(name).alias("table"), "n_rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def log_appended(rows: DataFrame, folder: str) -> None:
    """Rows added to an append-only manifest; those of bodies that are not 200 keep no body."""
    body = F.when(F.col("status") == 200, F.col("body")) if "body" in rows.columns else None
    (rows if body is None else rows.withColumn("body", body)).write.mode("append").parquet(folder)


def enumerated_outcome(status: Column, body: Column, magic: bytes = b"%PDF") -> Column:
    """What a request for an enumerated address gave: found, missing (404 is an answer), soft_missing (200 without the magic bytes), or failed."""
    real = F.coalesce(F.substring(body, 1, len(magic)) == F.lit(magic), F.lit(False))
    return F.when(status == 404, "missing").when((status == 200) & real, "found").when(status == 200, "soft_missing").otherwise("failed")
