"""Tables behind figures: order of a heatmap's rows, and panels of prevalence against distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.operators.geo import distance_km

def _least_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min over k of a[i, k] + b[k, j]."""
    return np.stack([(row[:, None] + b).min(axis=0) for row in a])


def _turned(node, d: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Leaves of a tree (an int, or two nodes), and the least sum of neighbours' distances for each first and last leaf."""
    if isinstance(node, int):
        return [node], np.zeros((1, 1))
    (left, a), (right, b) = _turned(node[0], d), _turned(node[1], d)
    n, m = len(left), len(right)
    across = _least_plus(_least_plus(a, d[np.ix_(left, right)]), b)
    best = np.full((n + m, n + m), np.inf)
    best[:n, n:], best[n:, :n] = across, across.T
    return left + right, best


def _placed(node, first: int, last: int, d: np.ndarray) -> list[int]:
    """The leaves of a tree in the best order that begins and ends so."""
    if isinstance(node, int):
        return [node]
    for one, two in ((node[0], node[1]), (node[1], node[0])):
        (left, a), (right, b) = _turned(one, d), _turned(two, d)
        if first in left and last in right:
            cost = a[left.index(first)][:, None] + d[np.ix_(left, right)] + b[:, right.index(last)][None, :]
            k, m = np.unravel_index(int(cost.argmin()), cost.shape)
            return _placed(one, first, left[k], d) + _placed(two, right[m], last, d)
    raise ValueError("no such leaves")


def leaf_order(d: np.ndarray, zero: np.ndarray) -> list[int]:
    """Rows so that similar ones stand side by side: average linkage on distances, its merges turned for the least sum of neighbours' distances.

    Zero rows come last, in their order; two rows or fewer stay as they are.
    """
    live, rest = np.flatnonzero(~zero).tolist(), np.flatnonzero(zero).tolist()
    if len(live) <= 2:
        return live + rest
    trees: dict[int, tuple[object, list[int]]] = {i: (i, [i]) for i in live}
    while len(trees) > 1:
        keys = sorted(trees)
        _, a, b = min((d[np.ix_(trees[i][1], trees[j][1])].mean(), i, j) for n, i in enumerate(keys) for j in keys[n + 1 :])
        x, y = trees.pop(a), trees.pop(b)
        trees[a] = ((x[0], y[0]), x[1] + y[1])
    tree = next(iter(trees.values()))[0]
    leaves, best = _turned(tree, d)
    i, j = np.unravel_index(int(best.argmin()), best.shape)
    order = _placed(tree, leaves[i], leaves[j], d)
    return min(order, order[::-1]) + rest


def seriated(grid: DataFrame, row: str, column: str, value: str) -> list[str]:
    """Row names of a figure's grid in drawing order. Cosines are taken in Spark; the driver gets one number for each two rows of the figure."""
    g = grid.groupBy(row, column).agg(F.sum(value).alias("v")).where("v <> 0")
    a, b = g.select(F.col(row).alias("a"), column, F.col("v").alias("x")), g.select(F.col(row).alias("b"), column, F.col("v").alias("y"))
    dots = {(r["a"], r["b"]): r["dot"] for r in a.join(b, column).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot")).collect()}
    names = [r[0] for r in grid.select(row).distinct().orderBy(row).collect()]
    zero = np.array([(x, x) not in dots for x in names])
    norm = np.array([np.sqrt(dots.get((x, x), 1.0)) for x in names])
    d = 1 - np.array([[dots.get((x, y), 0.0) for y in names] for x in names]) / np.outer(norm, norm)
    return [names[i] for i in leaf_order(d, zero)]


def panels(prevalence: DataFrame, places: DataFrame, origin: tuple[float, float], patterns: dict[str, str]) -> DataFrame:
    """(panel, unit, distance_km, share): of a unit's recipes, the share with an ingredient whose name has the panel's pattern.

    prevalence: (unit, recipe_id, name); places: (unit, lon, lat).
    """
    tests = [F.max(F.contains(F.col("name"), F.lit(p)).cast("int")).alias(f"p{i}") for i, p in enumerate(patterns.values())]
    per = prevalence.groupBy("unit", "recipe_id").agg(*tests).groupBy("unit").agg(*[F.avg(f"p{i}").alias(n) for i, n in enumerate(patterns)])
    long = per.unpivot("unit", list(patterns), "panel", "share")
    far = distance_km(F.lit(origin[0]), F.lit(origin[1]), F.col("lon"), F.col("lat"))
    return long.join(places, "unit").select("panel", "unit", far.alias("distance_km"), "share")
