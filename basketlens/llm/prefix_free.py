"""Exact substring dedup by prefix-free parsing.

Every byte that a string of ``length`` bytes covers is removed, if that string also starts anywhere
else in the corpus; matches stay within documents and are judged on the input.

Content-defined phrases (see phrases.py) cut each text at rolling-hash triggers. The dictionary of
distinct phrase stretches is counted over the corpus. A stretch found twice settles all its
windows. Of the others, only those can hold a repeated window whose anchor k-gram stands in another
stretch as well; their bytes are dealt by anchor, so windows that might be equal meet, and each
lot is put in corpus order by prefix-free parsing: finer triggers cut it into phrases that overlap,
the suffix array of the dictionary of phrases and that of the parse give the order of all suffixes,
and neighbours that agree on ``length`` bytes are repeats. Anchors in more than ``crowd`` stretches
are split: these stretches are cut anew by grams twice as long, as often as needed, up to grams as long as
a window. So no task has to hold a crowd, and what is left of it goes the same way.

Identical texts share a key and hence their result. Null is empty text. Texts under ``length`` bytes
keep all. A very long text is hashed in parts; its removed spans are held whole. Counts are combined
before shuffles, and joins on hot phrases can be split at run time. Columns may have any names. An empty
table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.phrases import finer, merged, phrase_lots
from basketlens.llm.runtime import binary_texts, cut, dealt_anew, ready, renamed, text_key, text_keys, trimmed

GRAM = 32
#: Bytes of stretches that are put in order at once.
LOT = 400_000



def parsed(docs: DataFrame, text: str, length: int) -> DataFrame:
    """One row per phrase: s1, s2 (hash of its stretch), anchor, k1, k2 (key of its text), first, last."""

    @trimmed
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s1", "s2", "anchor", "k1", "k2", "first", "last"]
        types = [pa.int64()] * 5 + [pa.int32()] * 2

        def lot(hashes: list[bytes], grams: list[bytes], rest: list[tuple]) -> pa.RecordBatch:
            s = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            a = np.frombuffer(b"".join(grams), "<i8")
            k1, k2, first, last = (np.concatenate(x) for x in zip(*rest))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((s[:, 0], s[:, 1], a, k1, k2, first, last), types)], names=names)

        for batch in batches:
            hashes, grams, rest = [], [], []
            for t in binary_texts(batch.column(0)):
                key = text_key(t)
                for first, last, at in phrase_lots(np.frombuffer(t, np.uint8), length, GRAM):
                    hashes += [xxhash.xxh3_128_digest(t[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())]
                    grams += [xxhash.xxh3_64_digest(t[a : a + GRAM]) for a in at.tolist()]
                    rest.append((np.full(first.size, key[0]), np.full(first.size, key[1]), first, last))
                    if len(hashes) > 200_000:
                        yield lot(hashes, grams, rest)
                        hashes, grams, rest = [], [], []
            if hashes:
                yield lot(hashes, grams, rest)

    return docs.select(text).mapInArrow(parse, "s1 bigint not null, s2 bigint not null, anchor bigint, k1 bigint, k2 bigint, first int, last int")


def ranks(symbols: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """The rank of each suffix up to its end, by doubling; equal ones share it.

    symbols: uint8, joined strings that each end in 0. left: symbols up to and with that end.
    longest: the largest of these numbers.
    """
    padded = np.concatenate([symbols, np.zeros(8, np.uint8)])
    key = np.zeros(symbols.size, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | np.where(left > i, padded[i : i + symbols.size], 0).astype(np.uint64)
    n = 8
    while True:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(symbols.size, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]))
        if n >= longest or int(rank[order[-1]]) == symbols.size - 1:
            return rank
        after = np.concatenate([rank[n:] + 1, np.zeros(min(n, symbols.size), np.int64)])[: symbols.size]
        key = (rank.astype(np.uint64) << np.uint64(32)) | np.where(left > n, after, 0).astype(np.uint64)
        n *= 2


def sequence_ranks(numbers: np.ndarray, longest: int) -> np.ndarray:
    """As ranks(), of a sequence of non-negative numbers; past the end all are less than any."""
    rank, n = np.unique(numbers, return_inverse=True)[1].astype(np.int64), 1
    while n < longest:
        after = np.concatenate([rank[n:] + 1, np.zeros(min(n, rank.size), np.int64)])[: rank.size]
        rank = np.unique((rank << 32) | after, return_inverse=True)[1]
        n *= 2
    return rank


def corpus_order(texts: list[bytes], trigger_width: int = 6, modulus: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined, the order of its suffixes, and where the texts start.

    A text byte counts one more than it is, and a text ends in 0; UTF-8 has no byte 255.
    """
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = starts + lengths
    folded = joined + np.uint8(1)
    folded[ends] = 0
    # triggers: windows whose hash is 0 modulo the modulus, and the start of each text
    h = np.zeros(folded.size, np.uint32)
    for i in range(trigger_width):
        h[: folded.size - i] = h[: folded.size - i] * np.uint32(0x01000193) + (folded[i:] + np.uint32(1)) * np.uint32(0x9E3779B1)
    hit = ((h >> np.uint32(7)) % np.uint32(modulus)) == 0
    text_of = np.repeat(np.arange(len(texts)), lengths + 1)
    hit &= np.arange(folded.size) + trigger_width <= ends[text_of]
    hit[starts] = True
    at = np.flatnonzero(hit)
    # a phrase reaches from its trigger through the next one, or through the end of its text
    until = np.append(at[1:] + trigger_width, 0)
    closes = np.append(text_of[at[1:]] != text_of[at[:-1]], True)
    until[closes] = ends[text_of[at[closes]]] + 1
    whole = folded.tobytes()
    dictionary: dict[bytes, int] = {}
    parse = np.fromiter((dictionary.setdefault(whole[a:b], len(dictionary)) for a, b in zip(at.tolist(), until.tolist())), np.int64, at.size)
    words = np.frombuffer(b"".join(w + b"\0" * (w[-1:] != b"\0") for w in dictionary), np.uint8)
    sizes = np.fromiter((len(w) + (w[-1:] != b"\0") for w in dictionary), np.int64, len(dictionary))
    word_at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    suffix = ranks(words, np.repeat(word_at + sizes, sizes) - np.arange(words.size), int(sizes.max()))
    # the parse in terms of the dictionary's order, with a mark where a text ends
    mark = np.zeros(at.size + len(texts), np.int64)
    place = np.arange(at.size) + text_of[at]
    mark[place] = suffix[word_at[parse]] + 1
    follow = sequence_ranks(mark, int(np.bincount(text_of[at]).max()) + 1)
    # every position belongs to the phrase of the last trigger up to it
    phrase = np.cumsum(hit) - 1
    offset = np.arange(folded.size) - at[phrase]
    first = suffix[word_at[parse[phrase]] + offset]
    then = follow[place[phrase] + 1]
    return folded, np.argsort(first << 32 | then), starts


def repeated_windows(texts: list[bytes], windows: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, which of its first ``windows`` starts have an equal string of ``length`` bytes at another."""
    folded, order, starts = corpus_order(texts)
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    counted = np.zeros(folded.size + 1, np.int64)
    np.add.at(counted, starts, 1)
    np.add.at(counted, starts + windows, -1)
    order = order[np.cumsum(counted[:-1])[order] > 0]
    # neighbours, eight bytes at a time while they agree; the last eight may overlap those before
    eight = np.ndarray(joined.size - 7, "<u8", joined, strides=(1,)) if length >= 8 else joined
    step = 8 if length >= 8 else 1
    equal = np.ones(max(0, order.size - 1), bool)
    alive = np.arange(equal.size)
    for i in sorted({*range(0, length - step + 1, step), length - step}):
        same = eight[order[alive] + i] == eight[order[alive + 1] + i]
        equal[alive[~same]] = False
        alive = alive[same]
    hit = np.zeros(folded.size, bool)
    hit[order[:-1][equal]] = True
    hit[order[1:][equal]] = True
    return [np.flatnonzero(hit[s : s + w]) for s, w in zip(starts, windows)]


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if starts.size:
        gap = np.flatnonzero(np.diff(starts) != 1)
        yield from zip(starts[np.concatenate([[0], gap + 1])].tolist(), starts[np.concatenate([gap, [starts.size - 1]])].tolist())


def in_lots(order_of: str, size: Callable[[dict], int], work: Callable[[list[dict]], list[tuple]], names: list[str], types: list, most: int) -> Callable:
    """A mapInArrow function over rows sorted by a column: ``work`` gets lots of whole groups of about ``most``."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, weight = [], 0

        def done() -> pa.RecordBatch:
            out = list(zip(*work(lot))) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(out, types)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if weight >= most and row[order_of] != lot[-1][order_of]:
                    yield done()
                    lot, weight = [], 0
                lot.append(row)
                weight += size(row)
        if lot:
            yield done()

    return run


def repeated(docs: DataFrame, text: str = "text", length: int = 200, crowd: int = 20_000) -> DataFrame:
    """k1, k2 (key of a text) and spans: array of (first << 32 | last - first) of repeated window starts; texts without any are absent."""
    ready(docs.sparkSession)
    rows = parsed(docs, text, length)
    known = ("anchor", "r1", "r2", "rf", "rl")
    counts = rows.groupBy("s1", "s2").agg(F.count("*").alias("n"), *[F.first(x).alias(y) for x, y in zip(("anchor", "k1", "k2", "first", "last"), known)])
    # all uses read all columns of the counts, so that Spark makes them once
    read = F.coalesce(*known).isNotNull()
    shared = counts.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.min(F.coalesce(*known)).alias("read")).where("m > 1 and least = 1 and read is not null").select("anchor", "m")
    span = F.expr("shiftleft(cast(first as bigint), 32) + last - first").alias("span")
    twice = dealt_anew(counts.where(read & (F.col("n") > 1)).select("s1", "s2", "n"), "s1", "s2")
    same = rows.drop("anchor").join(twice, ["s1", "s2"]).select("k1", "k2", span, F.lit(None).cast("bigint").alias("anchor"), F.lit(0).cast("bigint").alias("m"), "n")
    shares = counts.join(shared, "anchor").select(F.col("r1").alias("k1"), F.col("r2").alias("k2"), F.expr("shiftleft(cast(rf as bigint), 32) + rl - rf").alias("span"), "anchor", "m", "n")
    settled = cut(same.unionByName(shares))
    open_ = settled.where("m > 0").select("anchor", "m", "n", "k1", "k2", F.shiftrightunsigned("span", 32).cast("int").alias("first"), (F.shiftrightunsigned("span", 32) + F.col("span").bitwiseAND(0xFFFFFFFF)).cast("int").alias("last"))

    # the bytes of the stretches that are still open
    wanted = open_.groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "m", "n", "first", "last")).alias("open"))

    @trimmed
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if (r["k1"], r["k2"]) in seen:  # another copy of the text
                    continue
                seen.add((r["k1"], r["k2"]))
                t = (r["text"] or "").encode()
                out += [(o["anchor"], o["m"], o["n"], r["k1"], r["k2"], o["first"], t[o["first"] : o["last"] + length]) for o in r["open"]]
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names=["anchor", "m", "n", "k1", "k2", "first", "stretch"])

    stretches = cut(text_keys(docs.select(F.col(text).alias("text")), "text").join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "open").mapInArrow(fetch, "anchor bigint, m bigint, n bigint, k1 bigint, k2 bigint, first int, stretch binary"))

    def order(lot: list[dict]) -> list[tuple]:
        unique: dict[bytes, int] = {}
        for r in lot:
            unique.setdefault(r["stretch"], len(unique))
        texts = list(unique)
        hits = repeated_windows(texts, np.array([len(t) - length + 1 for t in texts]), length)
        return [(r["k1"], r["k2"], (r["first"] + a) << 32 | (b - a)) for r in lot if r["n"] == 1 for a, b in _runs(hits[unique[r["stretch"]]])]

    def ordered(rows: DataFrame) -> DataFrame:
        near = rows.repartition("anchor").sortWithinPartitions("anchor")
        return near.mapInArrow(in_lots("anchor", lambda r: len(r["stretch"]), order, ["k1", "k2", "span"], [pa.int64()] * 3, LOT), "k1 bigint, k2 bigint, span bigint")

    out, gram = settled.where("m = 0").select("k1", "k2", "span").unionByName(ordered(stretches.where(F.col("m") <= crowd))), GRAM
    crowded = stretches.where(F.col("m") > crowd)
    while gram < length and crowded.limit(1).count():
        gram = finer(gram, length)
        whole, stretches = _refiled(crowded, length, gram)
        out = out.unionByName(whole).unionByName(ordered(stretches.where(F.col("m") <= crowd)))
        crowded = stretches.where(F.col("m") > crowd)
    return out.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def _refiled(crowded: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Stretches of crowded anchors, cut by longer grams: the spans that this settles (k1, k2, span), and those still open, as they came, with how often each is found (n)."""

    @trimmed
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                t = r["stretch"]
                for first, last, at in phrase_lots(np.frombuffer(t, np.uint8), length, gram):
                    for a, b, c in zip(first.tolist(), last.tolist(), at.tolist()):
                        part = t[a : b + length]
                        out.append((*struct.unpack("<qq", xxhash.xxh3_128_digest(part)), struct.unpack("<q", xxhash.xxh3_64_digest(t[c : c + gram]))[0], r["k1"], r["k2"], r["n"], r["first"] + a, r["first"] + b, part))
            kinds = [pa.int64()] * 6 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(list(zip(*out)) or [[]] * 9, kinds)], names=["s1", "s2", "anchor", "k1", "k2", "own", "first", "last", "stretch"])

    rows = cut(crowded.mapInArrow(parse, "s1 bigint, s2 bigint, anchor bigint, k1 bigint, k2 bigint, own bigint, first int, last int, stretch binary"))
    place = F.struct("k1", "k2", "first")
    counts = rows.groupBy("s1", "s2").agg(F.sum("own").alias("n"), F.first("anchor").alias("a"), F.min(place).alias("one"))
    shared = counts.groupBy(F.col("a").alias("anchor")).agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("anchor", "m")
    judged = rows.join(dealt_anew(counts.drop("a"), "s1", "s2").hint("merge"), ["s1", "s2"])
    span = F.expr("shiftleft(cast(first as bigint), 32) + last - first").alias("span")
    whole = judged.where("n > 1 and own = 1").select("k1", "k2", span)
    left = judged.where(place == F.col("one")).join(dealt_anew(shared, "anchor").hint("merge"), "anchor")
    return cut(whole), cut(left.select("anchor", "m", "n", "k1", "k2", "first", "stretch"))


def covered(spans: list[int] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint removed byte runs of a text."""
    s = np.array(spans or [], np.int64)
    return merged(s >> 32, (s >> 32) + (s & 0xFFFFFFFF) + length)


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, crowd: int = 20_000) -> DataFrame:
    """key, n_bytes, runs (array of removed [start, end)) and kept (binary: the bytes left) of every row."""
    return _stripped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), repeated(docs, text, length, crowd), length).withColumnRenamed("key", key)


def _stripped(docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    kind = docs.schema["key"].dataType.simpleString()

    @trimmed
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, kept = [], [], []
            for t, x in zip(binary_texts(batch.column(1)), batch.column(2).to_pylist()):
                a, b = covered(x, length)
                at = np.concatenate([[0], np.stack([a, b], 1).ravel(), [len(t)]]).tolist()
                n.append(len(t))
                runs.append([{"start": i, "end": j} for i, j in zip(a.tolist(), b.tolist())])
                kept.append(b"".join(t[i:j] for i, j in zip(at[::2], at[1::2])))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary())], names=["key", "n_bytes", "runs", "kept"])

    return text_keys(docs, "text").join(spans, ["k1", "k2"], "left").select("key", "text", "spans").mapInArrow(take, f"key {kind}, n_bytes bigint, runs array<struct<start:bigint,end:bigint>>, kept binary")


def clean(docs: DataFrame, text: str = "text", length: int = 200, crowd: int = 20_000) -> DataFrame:
    """docs, with their own columns, and each text less its repeated strings.

    A character of which only some bytes are covered goes as a whole. Rows that had words and have
    none left are dropped; rows without repeats stay as they are, nulls included.
    """
    plain, names, column = renamed(docs, text)
    spans = repeated(plain.select(column), column, length, crowd)
    place = plain.columns.index(column)

    @trimmed
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(place).to_pylist(), np.ones(batch.num_rows, bool)
            for i, x in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if x:
                    t = texts[i].encode()
                    a, b = covered(x, length)
                    at = np.concatenate([[0], np.stack([a, b], 1).ravel(), [len(t)]]).tolist()
                    texts[i] = "".join(t[j:k].decode(errors="ignore") for j, k in zip(at[::2], at[1::2]))
                    keep[i] = bool(texts[i].strip(" \t\n\v\f\r")) or not t.strip()
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(keep))

    left = text_keys(plain, column).join(spans, ["k1", "k2"], "left").select(*plain.columns, "spans").mapInArrow(take, plain.schema)
    return left.select(*[F.col(y).alias(x) for x, y in names.items()])
