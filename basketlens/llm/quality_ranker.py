"""Quality classifier: Bradley-Terry ranking of documents by preference pairs.

Each text becomes a vector of measures over the whole text: ratios of form, and the shares of its
words, lower-cased (A-Z), that fall into each of WORD_CELLS cells by hash. Pairs of a preferred and
another document give feature differences; logistic loss on these learns one weight per feature, so a
document's utility is a linear score. The threshold is the quantile of training utilities that leaves
below it the share of documents not preferred; the score is the logistic of the distance to it, set
so that the threshold has score CUT. The fit uses a bounded sample of labelled rows (``max_rows``,
chosen by a hash of the key, in the order of keys) and ``pairs`` pairs; scoring covers every row.

Null or empty text has all measures zero and is scored as such. A very long text is read whole.
Repeated labels of a document are averaged (half counts as not preferred); repeated rows are scored
each. Equal utilities get equal scores. Only key, text and label are read, so other columns may have
any names. With one class only, or none, there are no pairs and every score is CUT where that class is
the preferred one, else 0. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.quality_rules import STOP_WORDS
from basketlens.llm.runtime import binary_texts, ready, trimmed

CUT = 0.7
FEATURES = (
    "log_words", "word_bytes", "stop_share", "distinct_share", "repeat_next", "dup_lines", "upper_share", "digit_share",
    "period_share", "bang_share", "pipe_share", "symbol_share", "other_punct", "line_words", "mixed_long", "lone_marks",
)
WORD_CELLS = 64
SIZE = len(FEATURES) + WORD_CELLS
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".?", b"!", b"|", b"#*$%&<>", b",;:'\"()-"), 1):
    _CLASS[list(_chars)] = _k


def features(text: bytes) -> np.ndarray:
    out = np.zeros(SIZE)
    words = text.split()
    n = len(words)
    if not n:
        return out
    low = text.lower().split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    by = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    size = sum(map(len, words))
    out[: len(FEATURES)] = (
        np.log(n), size / n, sum(map(_STOP.__contains__, low)) / n, len(set(low)) / n,
        sum(map(bytes.__eq__, low, low[1:])) / n, 1 - len(set(lines)) / len(lines), by[1] / size, by[2] / size,
        by[3] / n, by[4] / n, by[5] / n, by[6] / n, by[7] / n, np.log(n / len(lines)),
        sum(len(w) > 24 for w in words) / n, sum(len(w) == 1 for w in words) / n,
    )
    cell = np.fromiter(map(zlib.crc32, low), np.int64, n) % WORD_CELLS
    out[len(FEATURES) :] = np.bincount(cell, minlength=WORD_CELLS) / n
    return out


class Ranker:
    """Weights, scaling and threshold; about a kilobyte."""

    def __init__(self, x: np.ndarray, preferred: np.ndarray, pairs: int = 100_000, penalty: float = 1e-3, seed: int = 17):
        good, bad = np.flatnonzero(preferred), np.flatnonzero(~preferred)
        self.mean, self.weights, self.threshold, self.scale = np.zeros(SIZE), np.zeros(SIZE), 0.0, 1.0
        self.flat = CUT if good.size else 0.0
        self.fitted = bool(good.size and bad.size)
        if not self.fitted:
            return
        self.mean, sd = x.mean(axis=0), x.std(axis=0)
        self.unit = np.where(sd > 1e-9, sd, 1.0)
        z = self.squash(x)
        draw = np.random.default_rng(seed)
        d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
        w = np.zeros(z.shape[1])
        for _ in range(25):  # Newton steps on the logistic loss of the differences
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad = -(d * p[:, None]).mean(axis=0) + penalty * w
            hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(w.size)
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w
        u = np.sort(z @ w)
        k = min(max(1, bad.size), u.size - 1)
        self.threshold = (u[k - 1] + u[k]) / 2
        self.scale = max(1e-6, float(u.std()) / 2)

    def squash(self, x: np.ndarray) -> np.ndarray:
        """Standard units, and the squares of those of form, cut off where values are extreme."""
        z = np.clip((x - self.mean) / self.unit, -8, 8)
        return np.hstack([z, np.minimum(z[:, : len(FEATURES)] ** 2, 16)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.flat)
        distance = (self.squash(x) @ self.weights - self.threshold) / self.scale
        return 1 / (1 + np.exp(-np.clip(distance + np.log(CUT / (1 - CUT)), -500, 500)))


def _mapped(docs: DataFrame, key: str, text: str, schema: str, make) -> DataFrame:
    ready(docs.sparkSession)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in binary_texts(batch.column(1))]).reshape(-1, SIZE)
            names, columns = zip(*make(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *names])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {schema}")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000) -> Ranker:
    """labels: (key, label 0/1) of the documents to learn from; nulls are left out."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.avg(label) > 0.5).alias("preferred"))
    n = known.count()
    share = min(1.0, 0.95 * max_rows / max(1, n))  # within the bound though hashes scatter
    picked = known.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    rows = docs.select(F.col(key), F.col(text)).join(F.broadcast(picked), key).orderBy(key, F.xxhash64(text))  # at most max_rows keys
    got = _mapped(rows.select("preferred", F.col(text)), "preferred", text, "x binary", lambda x: [("x", pa.array([v.astype("<f4").tobytes() for v in x], pa.binary()))]).toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), "<f4").astype(float).reshape(-1, SIZE)
    return Ranker(x, np.array(got["preferred"].to_pylist(), bool))


def score(docs: DataFrame, ranker: Ranker, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1) and predicted (1 from CUT on)."""

    def make(x: np.ndarray):
        s = ranker.score(x)
        return [("score", pa.array(s, pa.float64())), ("predicted", pa.array((s >= CUT).astype(np.int32), pa.int32()))]

    return _mapped(docs, key, text, "score double, predicted int", make)
