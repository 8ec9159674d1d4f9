"""Language identification: multinomial naive Bayes over hashed character 1- to 3-grams.

Texts are lower-cased and padded with a space at both ends; each n-gram is hashed into one of
2**BITS buckets. Counts of all training texts are summed per language and bucket; the smoothed
log-probability matrix (languages x buckets) is broadcast. Its size depends on the number of
languages only, at most MOST_LANGUAGES (67 MB); more different values are refused as no languages.
A null text, or one without any letter (a character that str.isalpha() takes for one), gets ``und``
and score 0; so does every text if there is nothing to learn from. Ties go to the first language in
alphabetical order. Repeated rows count each and get the same prediction. A very long text is read in
parts. Only key, text and language are read, so other columns may have any names. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.runtime import ready, trimmed

ORDERS = 3
CHUNK = 1 << 19
BITS = 16
MOST_LANGUAGES = 256
#: Log-probabilities that are gathered at once.
GATHERED = 1 << 22


def chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """(text index, string, own characters) in lots of about CHUNK characters.

    A long text comes in several strings; each has ORDERS - 1 characters more than its own, so that
    every n-gram is seen once.
    """
    at, parts, own, size = [], [], [], 0
    for i, t in enumerate(texts):
        t = f" {t.lower()} "
        for k in range(0, len(t), CHUNK):
            part = t[k : k + CHUNK + ORDERS - 1]
            at.append(i)
            parts.append(part)
            own.append(CHUNK)
            size += len(part)
            if size >= CHUNK:
                yield np.array(at), parts, np.array(own)
                at, parts, own, size = [], [], [], 0
    if parts:
        yield np.array(at), parts, np.array(own)


def buckets(parts: list[str], own: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: buckets of all positions, and which of them are n-grams of their part."""
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    start = np.cumsum(length) - length
    pos = np.arange(code.size) - np.repeat(start, length)
    mixed = code * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    gram = mixed
    for n in range(1, ORDERS + 1):
        if n > 1:
            gram = gram * np.uint32(0x01000193)
            gram[: gram.size - n + 1] ^= mixed[n - 1 :]
        h = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        yield (h >> np.uint32(32 - bits)).astype(np.int64), pos < np.repeat(np.minimum(own, length - n + 1), length)


def learn(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities (rows: buckets, one of zeros, and the languages' shares)."""
    ready(docs.sparkSession)
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    shares = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"{lang} has more than {MOST_LANGUAGES} different values")
    langs = sorted(shares)

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            of = np.array(batch.column(0).to_pylist(), object)
            texts = np.array(batch.column(1).to_pylist(), object)
            for x in set(of):
                total = sums.setdefault(x, np.zeros(1 << BITS, np.int64))
                for _, parts, own in chunks(texts[of == x].tolist()):
                    for b, ok in buckets(parts, own):
                        total += np.bincount(b[ok], minlength=1 << BITS)
        for x, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([x] * at.size, pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    summed = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << BITS, len(langs)))
    if langs and summed.num_rows:
        which = {x: i for i, x in enumerate(langs)}
        counts[summed["bucket"].to_numpy(), [which[x] for x in summed["lang"].to_pylist()]] = summed["n"].to_numpy()
    smooth = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * counts.shape[0]))
    prior = np.log(np.array([shares[x] for x in langs], float) / max(1, sum(shares.values())))
    return langs, np.vstack([smooth, np.zeros((1, len(langs))), prior[None]]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score, the posterior probability of lang_pred."""
    langs, table = model
    held = docs.sparkSession.sparkContext.broadcast(table)
    kind = docs.schema[key].dataType.simpleString()

    @trimmed
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = held.value
        for batch in batches:
            raw = batch.column(1).to_pylist()
            sums = np.tile(logp[-1].astype(np.float64), (len(raw), 1))
            letters = [bool(t and langs and any(map(str.isalpha, t))) for t in raw]
            texts = [t if ok else "" for t, ok in zip(raw, letters)]
            for at, parts, own in chunks(texts) if langs else ():
                length = np.fromiter(map(len, parts), np.int64, len(parts))
                part_of, step = np.repeat(np.arange(len(parts)), length), max(1, GATHERED // len(langs))
                total = np.zeros((len(parts), len(langs)))
                for b, ok in buckets(parts, own):
                    b[~ok] = 1 << BITS
                    for k in range(0, b.size, step):
                        of = part_of[k : k + step]
                        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                        total[of[first]] += np.add.reduceat(logp[b[k : k + step]], first, axis=0, dtype=np.float64)
                np.add.at(sums, at, total)
            if langs:
                best = sums.argmax(axis=1)
                p = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                pred = [langs[i] if ok else "und" for i, ok in zip(best, letters)]
                p = np.where(letters, p, 0.0)
            else:
                pred, p = ["und"] * len(raw), np.zeros(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(p, pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(score, f"`{key}` {kind}, lang_pred string, score double")
