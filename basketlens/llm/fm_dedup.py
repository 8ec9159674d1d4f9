"""Cross-document substring dedup on words, with a compressed FM-index per shard.

A word is removed where a window of ``length`` words covers it whose words also start in a document
with a smaller key; windows stay within documents and are judged on the input.

Content-defined phrases (phrases.py) gather the windows of each document. Equal stretches are one
text to search, filed with the least document that has it. Documents above that one lose the whole
stretch. What is left to decide is which windows also stand in other stretches, in a smaller
document; only stretches with a common anchor can share one. They are dealt by anchor into shards.
Each shard is indexed: suffix array, Burrows-Wheeler transform in a wavelet matrix of packed bits with
rank counts, and least documents of suffix ranges. Stretches stream against it, a few at a time: backward
search gives matching statistics, how many words up to a place stand elsewhere in the shard, too. Where
these reach a window's length, and its range of suffixes holds a smaller document, the window is reported.
Anchors in more than ``crowd`` stretches are split: these
stretches are cut anew by grams twice as long, as often as needed, up to grams as long as a window. So no
task has to hold a crowd, and what is left of it goes the same way.

Keys are integers. Rows with a null key lose nothing and take nothing from others; null text has no
words. Rows that repeat key and text get the same result, and count once. A very long text is hashed in
parts; its words and removed spans are held whole. Only key and text are read, so other columns may have
any names. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.phrases import finer, merged, phrase_lots
from basketlens.llm.prefix_free import _runs, in_lots
from basketlens.llm.runtime import binary_texts, cut, dealt_anew, ready, trimmed

GRAM = 8
#: Words of stretches in one index.
LOT = 200_000


def parsed(docs: DataFrame, length: int) -> DataFrame:
    """docs: doc, text. One row per phrase: s1, s2 (hash of its stretch), anchor, doc, t (hash of the text), first, last."""

    @trimmed
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s1", "s2", "anchor", "doc", "t", "first", "last"]
        types = [pa.int64()] * 5 + [pa.int32()] * 2

        def lot(hashes: list[bytes], grams: list[bytes], rest: list[tuple]) -> pa.RecordBatch:
            s, a = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2), np.frombuffer(b"".join(grams), "<i8")
            doc, t, first, last = (np.concatenate(x) for x in zip(*rest))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((s[:, 0], s[:, 1], a, doc, t, first, last), types)], names=names)

        for batch in batches:
            hashes, grams, rest = [], [], []
            for doc, t in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1))):
                words = t.split()
                t_hash = text_hash(t)
                for first, last, at in phrase_lots(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), length, GRAM):
                    hashes += [xxhash.xxh3_128_digest(b" ".join(words[a:b])) for a, b in zip(first.tolist(), (last + length).tolist())]
                    grams += [xxhash.xxh3_64_digest(b" ".join(words[a : a + GRAM])) for a in at.tolist()]
                    rest.append((np.full(first.size, doc), np.full(first.size, t_hash), first, last))
                    if len(hashes) > 200_000:
                        yield lot(hashes, grams, rest)
                        hashes, grams, rest = [], [], []
            if hashes:
                yield lot(hashes, grams, rest)

    return docs.where("doc is not null").mapInArrow(parse, "s1 bigint not null, s2 bigint not null, anchor bigint, doc bigint, t bigint, first int, last int")


def text_hash(text: bytes) -> int:
    """As Spark's xxhash64 of the text."""
    h = xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


class Wavelet:
    """A wavelet matrix: rank of a symbol before positions, from packed bits and running counts."""

    def __init__(self, symbols: np.ndarray):
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        row = symbols
        for level in reversed(range(self.depth)):
            bit = (row >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-bit.size % 64 + 64, bool)]), bitorder="little").view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1]]).astype(np.int32))
            self.zeros.append(int((~bit).sum()))
            row = np.concatenate([row[~bit], row[bit]])
        every = np.arange(int(symbols.max(initial=0)) + 1)
        self.start = self._down(every, np.zeros(every.size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(reversed(range(self.depth))):
            word = at >> 6
            ones = self.counts[i][word] + np.bitwise_count(self.words[i][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> level & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._down(symbol, at) - self.start[symbol]


BLOCK = 64


class Least:
    """The least of values in ranges, from least values of blocks and within them: three numbers a value and a table over blocks."""

    def __init__(self, values: np.ndarray):
        whole = np.full(-(-values.size // BLOCK) * BLOCK, np.iinfo(np.int32).max, np.int32)
        whole[: values.size] = values
        rows = whole.reshape(-1, BLOCK)
        self.values, self.upto = whole, np.minimum.accumulate(rows, axis=1).ravel()
        self.onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table, step = [self.upto[BLOCK - 1 :: BLOCK]], 1
        while 2 * step <= self.table[0].size:
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))
            step *= 2

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of each range [lo, hi), which is not empty."""
        out = self.values[lo]
        first, last = lo // BLOCK, (hi - 1) // BLOCK
        apart = np.flatnonzero(first < last)
        out[apart] = np.minimum(self.onward[lo[apart]], self.upto[hi[apart] - 1])
        between = apart[last[apart] - first[apart] > 1]
        a, n = first[between] + 1, last[between] - first[between] - 1
        level = np.frexp(n.astype(float))[1] - 1
        for j in np.unique(level):
            of = level == j
            t, at = self.table[j], between[of]
            out[at] = np.minimum(out[at], np.minimum(t[a[of]], t[a[of] + n[of] - (1 << int(j))]))
        within, step = np.flatnonzero(first == last), 1
        while within.size:
            within = within[lo[within] + step < hi[within]]
            out[within] = np.minimum(out[within], self.values[lo[within] + step])
            step += 1
        return out


class FMIndex:
    """Sequences of positive symbols, with the document of each: the transform in packed bits, and the least document of suffix ranges."""

    def __init__(self, sequences: list[np.ndarray], docs: np.ndarray):
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.int32)
        inside = np.ones(text.size, bool)
        inside[ends] = False
        text[inside] = np.concatenate(sequences)
        # separators differ among themselves and precede all symbols
        rank = text.astype(np.int64) + len(sequences)
        rank[ends] = np.arange(len(sequences))
        n = 1
        while True:
            after = np.concatenate([rank[n:] + 1, np.zeros(min(n, rank.size), np.int64)])[: rank.size]
            both = (rank << 32) | after
            order = np.argsort(both, kind="stable")
            s = both[order]
            rank = np.empty(text.size, np.int64)
            rank[order] = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]))
            n *= 2
            if rank[order[-1]] == text.size - 1:
                break
        self.size = text.size
        self.bwt = Wavelet(text[order - 1])
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.docs, number = np.unique(docs, return_inverse=True)
        self.least = Least(np.repeat(number.astype(np.int32), lengths + 1)[order])

    def matching(self, symbols: np.ndarray, last: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of places in a stream of symbols: how many symbols up to and with each place stand at two places of the index or more, at most ``most``; and the range of suffixes that begin with them."""
        lo, hi = np.zeros(last.size, np.int64), np.full(last.size, self.size)
        matched, live = np.zeros(last.size, np.int32), np.arange(last.size)
        for k in range(most):
            c = symbols[last[live] - k]
            a, b = self.below[c] + self.bwt.rank(c, lo[live]), self.below[c] + self.bwt.rank(c, hi[live])
            some = b - a > 1
            live = live[some]
            lo[live], hi[live] = a[some], b[some]
            matched[live] += 1
            if not live.size:
                break
        return matched, lo, hi

    def least_doc(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.docs[self.least.find(lo, hi)]


#: Symbols of stretches that stream against an index at once.
STREAM = 50_000


def shared_windows(stretches: list[tuple[bytes, ...]], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """For each sequence of words, its window starts that also stand in a smaller document's sequence.

    The sequences are indexed, and then stream against the index a few at a time.
    """
    number: dict[bytes, int] = {}
    sequences = [np.array([number.setdefault(w, len(number) + 1) for w in s], np.int32) for s in stretches]
    index = FMIndex(sequences, docs)
    out: list[np.ndarray] = []
    k = 0
    while k < len(sequences):
        sizes = np.cumsum([len(x) for x in sequences[k : k + STREAM // length]])
        n = max(1, int(np.searchsorted(sizes, STREAM)))
        lot, own = sequences[k : k + n], docs[k : k + n]
        counts = np.array([len(x) - length + 1 for x in lot])
        starts = np.concatenate([[0], sizes[: len(lot) - 1]])
        last = np.concatenate([np.arange(s + length - 1, s + length - 1 + c) for s, c in zip(starts, counts)])
        matched, lo, hi = index.matching(np.concatenate(lot), last, length)
        smaller, whole = np.zeros(last.size, bool), matched == length
        smaller[whole] = index.least_doc(lo[whole], hi[whole]) < np.repeat(own, counts)[whole]
        out += [np.flatnonzero(x) for x in np.split(smaller, np.cumsum(counts)[:-1])]
        k += len(lot)
    return out


def repeated(docs: DataFrame, length: int = 50, crowd: int = 20_000) -> DataFrame:
    """doc, t and spans: array of (first << 32 | last - first) of window starts to remove; documents without any are absent. docs: doc, text."""
    ready(docs.sparkSession)
    rows = parsed(docs, length)
    filed = rows.groupBy("s1", "s2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.first("anchor").alias("anchor"))
    # all uses read the same columns of rows and filed, so that Spark makes each once
    read = F.coalesce("anchor", "most", "least").isNotNull()
    span = F.expr("shiftleft(cast(first as bigint), 32) + last - first").alias("span")
    several = dealt_anew(filed.where(read & (F.col("most") > F.col("least"))).select("s1", "s2", "least"), "s1", "s2")
    above = rows.drop("anchor").join(several, ["s1", "s2"]).where("doc > least").select("doc", "t", span, F.lit(None).cast("bigint").alias("anchor"), F.lit(0).cast("bigint").alias("m"))
    shared = filed.groupBy("anchor").agg(F.count("*").alias("m"), F.min("least").alias("lo"), F.max("least").alias("hi"), F.max("most").alias("read"))
    shared = shared.where("lo < hi and read is not null").select("anchor", "m")
    wanted = filed.where(read).join(shared, "anchor").select("s1", "s2", "least", "anchor", "m")
    found = rows.drop("anchor").join(wanted, ["s1", "s2"]).where("doc <= least").select("doc", "t", span, "anchor", "m")
    settled = cut(above.unionByName(found))
    whole = settled.where("m = 0").select("doc", "t", "span")
    open_ = settled.where("m > 0").select("anchor", "m", "doc", "t", F.shiftrightunsigned("span", 32).cast("int").alias("first"), (F.shiftrightunsigned("span", 32) + F.col("span").bitwiseAND(0xFFFFFFFF)).cast("int").alias("last"))
    wanted = open_.groupBy("doc", "t").agg(F.collect_set(F.struct("anchor", "m", "first", "last")).alias("open"))

    @trimmed
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if (r["doc"], r["t"]) in seen:  # a repeated row
                    continue
                seen.add((r["doc"], r["t"]))
                w = (r["text"] or "").encode().split()
                out += [(o["anchor"], o["m"], r["doc"], r["t"], o["first"], b" ".join(w[o["first"] : o["last"] + length])) for o in r["open"]]
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(list(zip(*out)) or [[]] * 6, kinds)], names=["anchor", "m", "doc", "t", "first", "stretch"])

    stretches = cut(with_hash(docs).join(wanted, ["doc", "t"]).select("doc", "t", "text", "open").mapInArrow(fetch, "anchor bigint, m bigint, doc bigint, t bigint, first int, stretch binary"))

    def search(lot: list[dict]) -> list[tuple]:
        unique: dict[bytes, int] = {}
        least: list[int] = []
        for r in lot:
            i = unique.setdefault(r["stretch"], len(unique))
            if i == len(least):
                least.append(r["doc"])
            least[i] = min(least[i], r["doc"])
        hits = shared_windows([tuple(s.split()) for s in unique], np.array(least), length)
        return [(r["doc"], r["t"], (r["first"] + a) << 32 | (b - a)) for r in lot for a, b in _runs(hits[unique[r["stretch"]]])]

    def searched(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition("anchor").sortWithinPartitions("anchor")
        return ordered.mapInArrow(in_lots("anchor", lambda r: len(r["stretch"]) // 6, search, ["doc", "t", "span"], [pa.int64()] * 3, LOT), "doc bigint, t bigint, span bigint")

    out, gram = whole.unionByName(searched(stretches.where(F.col("m") <= crowd))), GRAM
    crowded = stretches.where(F.col("m") > crowd)
    while gram < length and crowded.limit(1).count():
        gram = finer(gram, length)
        whole, stretches = _refiled(crowded, length, gram)
        out = out.unionByName(whole).unionByName(searched(stretches.where(F.col("m") <= crowd)))
        crowded = stretches.where(F.col("m") > crowd)
    return out.groupBy("doc", "t").agg(F.collect_set("span").alias("spans"))


def _refiled(crowded: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Stretches of crowded anchors, cut by longer grams: the spans that this settles (doc, t, span), and those still open, as they came."""

    @trimmed
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                words = r["stretch"].split()
                for first, last, at in phrase_lots(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), length, gram):
                    for a, b, c in zip(first.tolist(), last.tolist(), at.tolist()):
                        part = b" ".join(words[a : b + length])
                        out.append((*struct.unpack("<qq", xxhash.xxh3_128_digest(part)), struct.unpack("<q", xxhash.xxh3_64_digest(b" ".join(words[c : c + gram])))[0], r["doc"], r["t"], r["first"] + a, r["first"] + b, part))
            kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(list(zip(*out)) or [[]] * 8, kinds)], names=["s1", "s2", "anchor", "doc", "t", "first", "last", "stretch"])

    rows = cut(crowded.mapInArrow(parse, "s1 bigint, s2 bigint, anchor bigint, doc bigint, t bigint, first int, last int, stretch binary"))
    filed = rows.groupBy("s1", "s2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.first("anchor").alias("a"))
    shared = filed.groupBy(F.col("a").alias("anchor")).agg(F.count("*").alias("m"), F.min("least").alias("lo"), F.max("least").alias("hi")).where("lo < hi").select("anchor", "m")
    judged = rows.join(dealt_anew(filed.drop("a"), "s1", "s2").hint("merge"), ["s1", "s2"])
    span = F.expr("shiftleft(cast(first as bigint), 32) + last - first").alias("span")
    whole = judged.where("doc > least").select("doc", "t", span)
    left = judged.where("doc <= least").join(dealt_anew(shared, "anchor").hint("merge"), "anchor")
    return cut(whole), cut(left.select("anchor", "m", "doc", "t", "first", "stretch"))


def with_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("t", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, crowd: int = 20_000) -> DataFrame:
    """key, n_words, runs (array of removed word ranges [start, end)) and kept (binary: words left, one space between)."""
    plain = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    spans = repeated(plain, length, crowd)

    @trimmed
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, kept = [], [], []
            for t, x in zip(binary_texts(batch.column(1)), batch.column(2).to_pylist()):
                s = np.array(x or [], np.int64)
                a, b = merged(s >> 32, (s >> 32) + (s & 0xFFFFFFFF) + length)
                words = t.split()
                at = np.concatenate([[0], np.stack([a, b], 1).ravel(), [len(words)]]).tolist()
                n.append(len(words))
                runs.append([{"start": i, "end": j} for i, j in zip(a.tolist(), b.tolist())])
                kept.append(b" ".join([w for i, j in zip(at[::2], at[1::2]) for w in words[i:j]]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary())], names=["doc", "n_words", "runs", "kept"])

    left = with_hash(plain).join(spans, ["doc", "t"], "left").select("doc", "text", "spans").mapInArrow(take, "doc bigint, n_words bigint, runs array<struct<start:bigint,end:bigint>>, kept binary")
    return left.withColumnRenamed("doc", key)
