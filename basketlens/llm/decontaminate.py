"""Benchmark decontamination: pairs of words as seeds, then Smith-Waterman alignment.

Texts are lower-cased (A-Z), ASCII punctuation is taken as space, and words are compared whole. An
item is aligned with a text: match 2, mismatch and gap -1. The score is the best local alignment as a
share of that of an exact copy; from ``least`` on, the document counts as holding the item.

Which words are aligned is found without loss, whatever the corpus' size. Of an alignment of an item
of L words with that score, at least least * L - 1 matched words have the next one at most two words
on, in the item and in the text, since each wider step costs 2 or more. So pairs of words at most two
apart are seeds, those at the rarest SEEDED of the item's words by frequencies of the whole corpus;
where as many of these are met near one diagonal as must be among them, the words around are aligned.

Items under SHORT words would match by chance: there, from each word, the shortest n-gram expected
fewer than ``rare`` times in the corpus, words independent of each other, is a seed; an item without
such an n-gram is its own seed.

Test items are the query side. They are taken in blocks of at most BLOCK_WORDS words, each held in
full by every task; texts are never shuffled. In a block, items of the same words are sought once.
Null or empty items match nothing, null or empty texts hold nothing; repeated items and rows are
reported each, and keys may be null or of any type. Very long texts are searched whole. Where the item
key has the name of the key or of a measure, it is given as ``item_`` and its name. Of other columns
any name will do. Empty tables give no matches, and leave all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from basketlens.llm.runtime import binary_texts, ready, trimmed

BLOCK_WORDS = 2_000_000
#: Seeds longer than this are not looked for; a whole item may be longer.
LONGEST = 12
#: Items of fewer words are found by rare n-grams only.
SHORT = 8
#: Share of an item's words at which pairs are seeds.
SEEDED = 0.75
_FLAGS = 1 << 20
_FOLD = bytes(ord(chr(i).lower()) if 65 <= i <= 90 else 32 if 33 <= i <= 47 or 58 <= i <= 64 or 91 <= i <= 96 or 123 <= i <= 126 else i for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Items:
    """A block of test items: their words as numbers from 1, and their seeds."""

    def __init__(self, keys: list, texts: list[bytes]):
        same: dict[tuple[bytes, ...], list] = {}
        for k, t in zip(keys, texts):
            same.setdefault(tuple(words_of(t)), []).append(k)
        self.keys, split = list(same.values()), list(same)
        self.number: dict[bytes, int] = {}
        for words in split:
            for w in words:
                self.number.setdefault(w, len(self.number) + 1)
        self.items = [np.array([self.number[w] for w in words], np.int32) for words in split]

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words (0: in no item), with a 0 after each text; and where each text begins."""
        split = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        get = self.number.get
        for s, words in zip(starts.tolist(), split):
            out[s : s + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
        return out, starts

    @staticmethod
    def grams(ids: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
        h = np.zeros(at.size, np.uint64)
        for k in range(n):
            h = (h ^ ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def seed(self, counts: np.ndarray, total: int, rare: float, least: float) -> None:
        """counts: occurrences of each number in the corpus of ``total`` words."""
        share = np.maximum(counts, 1) / max(total, 1)
        found: dict[int, list[tuple[int, int]]] = {}
        pairs: list[tuple[int, int, int, int]] = []
        self.sizes = np.array([w.size for w in self.items], np.int64)
        #: How far gaps can move an alignment, and how many seeds it has at least.
        self.slack = np.floor((2 - 2 * least) * self.sizes).astype(np.int64) + 1
        self.need = np.ones(self.sizes.size, np.int64)
        for i, words in enumerate(self.items):
            chance, any_ = share[words], False
            if words.size >= SHORT:
                after = chance[1:] + np.append(chance[2:], 0)
                taken = np.argsort(chance[:-1] * after, kind="stable")
                all_ = math.ceil(least * words.size - 1 - 1e-9)
                taken = taken[: max(math.ceil(SEEDED * taken.size), taken.size - all_ + 1)]
                self.need[i] = max(1, all_ - (words.size - 1 - taken.size))
                pairs += [(words[a], words[a + d], i, a) for a in taken.tolist() for d in (1, 2) if a + d < words.size]
                continue
            for a in range(words.size):
                expected = total * np.cumprod(chance[a : a + LONGEST])
                short = np.flatnonzero(expected < rare)
                if short.size:
                    found.setdefault(int(short[0]) + 1, []).append((i, a))
                    any_ = True
            if words.size and not any_:
                found.setdefault(words.size, []).append((i, 0))
        both = np.array(sorted(set(pairs)), np.int64).reshape(-1, 4)
        key = both[:, 0] << 32 | both[:, 1]
        order = np.argsort(key, kind="stable")
        self.pairs = (key[order], both[order, 2:])
        self.flags = np.zeros(_FLAGS, bool)
        self.flags[self.flag(both[:, 0], both[:, 1])] = True
        self.seeds = {}
        for n, places in found.items():
            h = np.array([self.grams(self.items[i], n, np.array([a]))[0] for i, a in places], np.uint64)
            order = np.argsort(h)
            self.seeds[n] = (h[order], np.array(places, np.int64)[order])

    @staticmethod
    def flag(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) * 0x9E3779B1 ^ b.astype(np.int64) * 0x85EBCA6B) >> 7 & (_FLAGS - 1)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """item, place in it, and place in ids, of every seed that occurs."""
        out = [np.zeros((0, 3), np.int64)]
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        looked = []
        for n, (h, places) in self.seeds.items():
            if ids.size < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            looked.append((h, places, at, self.grams(ids, n, at)))
        for d in (1, 2):  # a pair over the end of a text is a hit too many, no more
            at = np.flatnonzero((ids[:-d] > 0) & (ids[d:] > 0))
            at = at[self.flags[self.flag(ids[at], ids[at + d])]]
            looked.append((*self.pairs, at, ids[at].astype(np.int64) << 32 | ids[at + d]))
        for h, places, at, key in looked:
            lo, hi = np.searchsorted(h, key, "left"), np.searchsorted(h, key, "right")
            some = hi > lo
            size = (hi - lo)[some]
            which = np.repeat(lo[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out.append(np.column_stack([places[which], np.repeat(at[some], size)]))
        all_ = np.concatenate(out)
        return all_[:, 0], all_[:, 1], all_[:, 2]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its window, and where in the window it ends; many at a time."""
    score, end = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda i: (len(windows[i]), len(items[i])))
    k = 0
    while k < len(order):
        widest = max(len(windows[order[min(k + 255, len(order) - 1)]]), 1)
        lot = order[k : k + max(1, min(256, 400_000 // widest))]
        k += len(lot)
        m, n = max(len(items[i]) for i in lot), max(len(windows[i]) for i in lot)
        a, b = np.full((len(lot), m), -1, np.int32), np.zeros((len(lot), n), np.int32)
        for r, i in enumerate(lot):
            a[r, : len(items[i])], b[r, : len(windows[i])] = items[i], windows[i]
        slope = np.arange(n, dtype=np.int32)
        h = np.zeros((len(lot), n), np.int32)
        best, at = np.zeros(len(lot), np.int32), np.zeros(len(lot), np.int64)
        for j in range(m):
            step = np.where(a[:, j, None] == b, 2, -1).astype(np.int32)
            step[:, 1:] += h[:, :-1]
            h = np.maximum(np.maximum(step, h - 1), 0)
            h = np.maximum(h, np.maximum.accumulate(h + slope, axis=1) - slope)  # gaps in the item
            top = h.max(axis=1)
            better = top > best
            at[better] = h[better].argmax(axis=1)
            best = np.maximum(best, top)
        score[lot], end[lot] = best, at + 1
    return score, end


def matches(block: Items, texts: list[bytes], least: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word and end of the words compared) of every item that a text holds."""
    ids, starts = block.ids(texts)
    item, place, at = block.hits(ids)
    if not item.size:
        return []
    text = np.searchsorted(starts, at, "right") - 1
    order = np.lexsort((at - place, item, text))
    item, place, at, text = item[order], place[order], at[order], text[order]
    # hits with as many others near their diagonal as an alignment must have
    other = lambda i, j: (item[i] != item[j]) | (text[i] != text[j])
    diagonal, need = at - place, block.need[item]
    last = np.minimum(np.arange(at.size) + need - 1, at.size - 1)
    full = np.flatnonzero((last - np.arange(at.size) == need - 1) & ~other(np.arange(at.size), last) & (diagonal[last] - diagonal <= block.slack[item]))
    within = np.zeros(at.size + 1, np.int64)
    np.add.at(within, full, 1)
    np.add.at(within, last[full] + 1, -1)
    keep = np.cumsum(within[:-1]) > 0
    item, place, diagonal, text, need = item[keep], place[keep], diagonal[keep], text[keep], need[keep]
    if not item.size:
        return []
    lo = np.maximum(diagonal - block.slack[item], starts[text])
    hi = np.minimum(diagonal + block.sizes[item] + block.slack[item] + 1, np.append(starts[1:], ids.size)[text] - 1)
    # windows of an item in a text that overlap are one
    new = np.concatenate([[True], other(np.arange(1, item.size), np.arange(item.size - 1)) | (lo[1:] > hi[:-1])])
    window, first = np.cumsum(new) - 1, np.flatnonzero(new)
    met = np.bincount(np.unique(np.column_stack([window, place]), axis=0)[:, 0], minlength=first.size)
    end = np.append(first[1:], item.size) - 1
    enough = met >= need[first]
    pairs = list(zip(*(x[enough].tolist() for x in (text[first], item[first], lo[first], hi[end]))))
    if not pairs:
        return []
    score, _ = align([block.items[i] for _, i, _, _ in pairs], [ids[a:b] for *_, a, b in pairs])
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for (t, i, a, b), s in zip(pairs, score.tolist()):
        share = s / (2 * block.items[i].size)
        if share >= least and share > best.get((t, i), (0.0,))[0]:
            best[t, i] = (share, int(a - starts[t]), int(b - starts[t]))
    return [(t, i, *x) for (t, i), x in best.items()]


def blocks(docs: DataFrame, items: DataFrame, text: str, item_key: str, item_text: str, rare: float, least: float) -> Iterator[Items]:
    """Test items with their seeds, by words of all docs."""
    size = items.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0] // 2
    parts = 1 + int(size) // BLOCK_WORDS
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64(item_key, item_text), F.lit(parts)) == part) if parts > 1 else items
        got = rows.select(F.col(item_key).alias("k"), F.col(item_text).alias("t")).where("t is not null").orderBy("k", "t").collect()
        block = Items([r["k"] for r in got], [r["t"].encode() for r in got])

        @trimmed
        def count(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(len(block.number) + 1, np.int64), 0
            for batch in batches:
                texts = binary_texts(batch.column(0))
                for k in range(0, len(texts), 1000):
                    ids, _ = block.ids(texts[k : k + 1000])
                    total += np.bincount(ids, minlength=total.size)
                    n += ids.size - len(texts[k : k + 1000])
            total[0] = n
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["word", "n"])

        counts = np.zeros(len(block.number) + 1)
        for word, n in docs.select(text).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect():
            counts[word] = n
        block.seed(counts, int(counts[0]), rare, least)
        yield block


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", rare: float = 0.01, least: float = 0.45) -> DataFrame:
    """key, item_key, score, and the words [first_word, end_word) around it, of every item in every document."""
    ready(docs.sparkSession)
    measures = ["score", "first_word", "end_word"]
    named = f"key_{key}" if key in measures else key
    item_named = f"item_{item_key}" if item_key in (named, *measures) else item_key
    schema = f"`{named}` {docs.schema[key].dataType.simpleString()}, `{item_named}` {items.schema[item_key].dataType.simpleString()}, score double, first_word bigint, end_word bigint"
    kind = to_arrow_type(items.schema[item_key].dataType)
    found = None
    for block in blocks(docs, items, text, item_key, item_text, rare, least):

        @trimmed
        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = binary_texts(batch.column(1))
                for k in range(0, len(texts), 1000):
                    got = [(t, x, *rest) for t, i, *rest in matches(block, texts[k : k + 1000], least) for x in block.keys[i]]
                    t, i, s, a, b = list(zip(*got)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([k + x for x in t], pa.int64())), pa.array(list(i), kind), pa.array(list(s), pa.float64()), pa.array(list(a), pa.int64()), pa.array(list(b), pa.int64())],
                        names=[named, item_named, *measures],
                    )

        here = docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
        found = here if found is None else found.unionByName(here)
    return found


def drop(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", rare: float = 0.01, least: float = 0.45) -> DataFrame:
    """The rows of docs that hold no test item, with their own columns."""
    ready(docs.sparkSession)
    place = docs.columns.index(text)
    left = docs
    for block in blocks(docs, items, text, item_key, item_text, rare, least):

        @trimmed
        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep, texts = np.ones(batch.num_rows, bool), binary_texts(batch.column(place))
                for k in range(0, len(texts), 1000):
                    keep[[k + t for t, *_ in matches(block, texts[k : k + 1000], least)]] = False
                yield batch.filter(pa.array(keep))

        left = left.mapInArrow(run, left.schema)
    return left
