"""Constraints as data: a rule list gives violation counts, one row each, never values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Constraint:
    table: str
    name: str
    count: Callable[[Tables], DataFrame]


def check(table: str, name: str, holds: Column) -> Constraint:
    """A condition on a row; null is no violation, as in SQL."""
    return Constraint(table, name, lambda t: t[table].agg(F.count_if(~holds).alias("violations")))


def not_null(table: str, column: str) -> Constraint:
    return Constraint(table, f"{column} not null", lambda t: t[table].agg(F.count_if(F.col(column).isNull()).alias("violations")))


def unique(table: str, *columns: str) -> Constraint:
    def count(t: Tables) -> DataFrame:
        n = t[table].dropna(subset=list(columns)).groupBy(*columns).count().where("count > 1")
        return n.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations"))

    return Constraint(table, f"{', '.join(columns)} unique", count)


def references(table: str, column: str, other: str, key: str) -> Constraint:
    def count(t: Tables) -> DataFrame:
        return t[table].where(F.col(column).isNotNull()).join(t[other].select(F.col(key).alias(column)), column, "left_anti").agg(F.count("*").alias("violations"))

    return Constraint(table, f"{column} references {other}", count)


def one_of(table: str, column: str, values: tuple[str, ...]) -> Constraint:
    return check(table, f"{column} in list", F.col(column).isin(*values))


def subset_of(table: str, column: str, values: tuple[str, ...]) -> Constraint:
    """Every element of an array is in the list."""
    return check(table, f"{column} within list", F.size(F.array_except(column, F.array(*[F.lit(v) for v in values]))) == 0)


def in_order(table: str, first: str, second: str) -> Constraint:
    return check(table, f"{first} <= {second}", F.col(first) <= F.col(second))


def violations(tables: Tables, rules: list[Constraint]) -> DataFrame:
    """(table, rule, violations) of all rules, those without violations included."""
    out = None
    for r in rules:
        one = r.count(tables).select(F.lit(r.table).alias("table"), F.lit(r.name).alias("rule"), F.col("violations").cast("long").alias("violations"))
        out = one if out is None else out.unionByName(one)
    return out


def refuse(tables: Tables, rules: list[Constraint]) -> None:
    """Raises with every rule that is broken, all in one report."""
    broken = violations(tables, rules).where("violations > 0").collect()  # as many rows as rules
    if broken:
        raise ValueError("; ".join(f"{r['table']}: {r['rule']} ({r['violations']})" for r in broken))


def fidelity(rows: DataFrame, key: str, state: str) -> DataFrame:
    """(key, loss, lost, degraded): lost counts 2, degraded 1, anything else nothing."""
    s = F.col(state)
    score = F.when(s == "lost", 2).when(s == "degraded", 1).otherwise(0)
    return rows.groupBy(key).agg(F.sum(score).cast("long").alias("loss"), F.count_if(s == "lost").alias("lost"), F.count_if(s == "degraded").alias("degraded"))
