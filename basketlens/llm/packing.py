"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

A document is its token ids and an end id; only a document longer than the capacity is cut, into
pieces of the capacity and a shorter last one. Bins are planned over the histogram of piece lengths,
which has no more entries than the capacity, so the plan sees all pieces of the corpus and its size
does not depend on them. A bin is filled greedily, largest fitting length first; then its smallest
piece, if it is the only one, too, gives way to the two unpacked pieces that together fit the widened
gap most tightly, as long as that narrows the gap. The same choices are made again while every length
has as many pieces left as they take at any moment, so a bin's pattern is repeated that often at once.
Pieces find their places by their rank among pieces of their length: a running rank within the task,
plus the counts of earlier tasks.

Null text is empty text: one end id. Repeated rows, and rows without a key, are packed each. An empty
table gives no rows. A very long text is cut like any other, with its ids in memory at once. Only key
and text are read, so other columns may have any names.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketlens.llm.runtime import cut, ready, trimmed

#: When a Python worker keeps the ids of more words, it starts again without any.
CACHED_WORDS = 500_000
#: ASCII punctuation but the apostrophe, which can join the letters before or after it.
MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of whole texts from a tokenizer that drops white space, word by word with a cache.

    A text is split at spaces, tabs and line feeds. The tokenizer treats these as borders in any
    case, so the ids of the parts, joined, are the ids of the text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Which ids close a run of letters.
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        #: Words, and for each its ids' number and place in the table.
        self.words = pa.array([""], pa.large_string())
        self.sizes, self.begins, self.table = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")
        self.cores: dict[str, bytes] = {"": b""}

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, unsigned and joined, and where each text begins, with the end of the last."""
        texts = texts.cast(pa.large_string()).fill_null("")
        split = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " "), " ")
        words = split.flatten().dictionary_encode()
        if len(self.words) > CACHED_WORDS:
            self.forget()
        which = pc.index_in(words.dictionary, self.words)
        fresh = words.dictionary.filter(which.is_null())
        self.add(fresh)
        which = which.to_numpy(zero_copy_only=False)
        unknown = np.isnan(which)
        which = np.where(unknown, 0, which).astype(np.int64)
        which[unknown] = np.arange(len(self.words) - len(fresh), len(self.words))
        index = which[words.indices.to_numpy()]
        n = self.sizes[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.begins[index] - ends[:-1], n)
        at += np.arange(at.size)
        lists = split.offsets.to_numpy()
        return self.table[at], ends[lists - lists[0]]

    def add(self, fresh: pa.Array) -> None:
        new = self.encoded(fresh.to_pylist())
        sizes = np.fromiter(map(len, new), np.int64, len(new)) // 4
        self.words = pa.concat_arrays([self.words, fresh])
        self.begins = np.concatenate([self.begins, self.table.size + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.table = np.concatenate([self.table, np.frombuffer(b"".join(new), "<u4")])

    def encoded(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word.

        The tokenizer lower-cases, and parts letters from a run of marks behind them, in any case. So
        letters and marks are encoded apart, each once.
        """
        cores = self.cores
        runs, others, lows, marks = {}, {}, [], []
        for w in words:
            core = w.rstrip(MARKS)
            mark = w[len(core) :] if len(core) < len(w) else ""
            if core.isascii() and core.isalpha():
                core = core.lower()
            elif not core.isalpha() or not core.lower().isalpha():
                core, mark = w, ""
                others[w] = None
            if core not in cores:
                runs[core] = None
            lows.append(core)
            marks.append(mark)
        self.letters([x for x in runs if x not in others])
        self.one_by_one([x for x in {*others, *marks} if x not in cores])
        return [cores[c] + cores[m] if m else cores[c] for c, m in zip(lows, marks)]

    def one_by_one(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.cores[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def letters(self, words: list[str], lot: int = 1000) -> None:
        """Words of letters only, many in one text: each ends in the one id of its ids that closes a run."""
        lots = [words[k : k + lot] for k in range(0, len(words), lot)]
        for some, e in zip(lots, self.tokenizer.encode_batch_fast([" ".join(x) for x in lots], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if ends.size != len(some):  # a tokenizer without such ids
                self.one_by_one(some)
                continue
            raw, at = ids.tobytes(), (4 * ends).tolist()
            self.cores.update({w: raw[i:j] for w, i, j in zip(some, [0, *at], at)})


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32, and task and rank for placing; ids (array) on request."""
    ready(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint" + ", ids array<int>" * with_ids

    @trimmed
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, ranks = encoder(tokenizer).ids, TaskContext.get().partitionId(), {}
        end, step = np.array([end_id], "<u4").tobytes(), capacity
        for batch in batches:
            rows, kept = ([], [], [], [], [], []), []
            flat, begins = encode(batch.column(1))
            begins = begins.tolist()
            for i, (low, high) in enumerate(zip(begins, begins[1:])):
                for p, at in enumerate(range(low, high + 1, step)):
                    part = flat[at : min(at + step, high)]
                    n, crc = part.size, zlib.crc32(part)
                    if n < step:  # the last piece, which the end id closes
                        n, crc = n + 1, zlib.crc32(end, crc)
                    ranks[n] = ranks.get(n, -1) + 1
                    for column, x in zip(rows, (i, p, at - low, n, crc, ranks[n])):
                        column.append(x)
                    if with_ids:
                        kept.append(np.append(part, np.array([end_id] * (n - part.size), "<u4")).astype("i4"))
            own = batch.column(0).take(pa.array(rows[0], pa.int64()))
            out = [own, pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5]), pa.array([task] * len(own), pa.int32()), pa.array(rows[5], pa.int64())]
            names = [key, "piece", "start", "length", "ids_crc32", "task", "rank"]
            if with_ids:
                out, names = [*out, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(cut_up, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, largest first; how many such bins) that use up all counts."""
    n = np.zeros(capacity + 1, np.int64)
    for length, c in counts.items():
        n[length] += c
    lengths = np.arange(capacity + 1)
    bins = []
    while True:
        fits = np.maximum.accumulate(np.where(n > 0, lengths, 0))  # the largest length there is, up to each
        if not fits[capacity]:
            return bins
        left = n.copy()

        def largest(most: int) -> int:
            x = int(fits[most])
            while x and left[x] <= 0:
                x = int(fits[x - 1])
            return x

        chosen, gap, fewest = [], capacity, n.copy()
        while gap and (x := largest(gap)):
            chosen.append(x)
            left[x] -= 1
            gap -= x
        np.minimum(fewest, left, out=fewest)
        while gap:
            small = min(chosen)
            room = gap + small
            there = np.maximum.accumulate(np.where(left > 0, lengths, 0))
            a = np.flatnonzero(left[: room + 1] > 0)
            if not a.size:
                break
            b = there[np.minimum(a, room - a)]
            # a length can be used twice only where two pieces have it
            once = (b == a) & (left[a] < 2)
            b = np.where(once, there[np.maximum(np.minimum(a - 1, room - a), 0)], b)
            sums = np.where(b > 0, a + b, 0)
            best = int(sums.argmax())
            if sums[best] <= small:
                break
            chosen.remove(small)
            chosen += [int(a[best]), int(b[best])]
            left[a[best]] -= 1
            left[b[best]] -= 1
            np.minimum(fewest, left, out=fewest)
            left[small] += 1
            gap = room - int(sums[best])
        used, each = np.unique(chosen, return_counts=True)
        times = 1 + int((fewest[used] // each).min())
        n[used] -= each * times
        bins.append((sorted(chosen, reverse=True), times))


class Places:
    """Where the piece of a length with a rank goes, as arrays for binary search."""

    def __init__(self, bins: list[tuple[list[int], int]]):
        taken: dict[int, int] = {}
        slots, self.offsets, first = [], [], 0
        for lengths, times in bins:
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            for x in sorted(set(lengths)):
                at = [int(s) for s, y in zip(starts, lengths) if y == x]
                slots.append((x, taken.get(x, 0), first, len(at), len(self.offsets)))
                self.offsets += at
                taken[x] = taken.get(x, 0) + len(at) * times
            first += times
        slots.sort()
        self.length, self.rank, self.first, self.each, self.at = np.array(slots, np.int64).reshape(-1, 5).T
        self.offsets = np.array(self.offsets, np.int64)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted((self.length << 44) + self.rank, (length << 44) + rank, "right") - 1
        j = rank - self.rank[i]
        return self.first[i] + j // self.each[i], self.offsets[self.at[i] + j % self.each[i]]


def place(cut_pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces() with sequence_id and offset in place of task and rank."""
    cut_pieces = cut(cut_pieces)
    own = cut_pieces.columns
    counts = cut_pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("earlier"))
    places = Places(plan({int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity))
    fields = {f.name: f.dataType.simpleString() for f in cut_pieces.schema if f.name not in ("task", "rank")}
    schema = ", ".join(f"`{k}` {v}" for k, v in fields.items()) + ", sequence_id bigint, offset bigint"

    @trimmed
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank, more = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank", "earlier"))
            found = places.find(length, rank + more)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in fields), *(pa.array(x, pa.int64()) for x in found)], names=[*fields, "sequence_id", "offset"])

    return cut_pieces.join(earlier, ["task", "length"]).select(*own, "earlier").mapInArrow(put, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return place(pieces(docs, tokenizer, capacity, end_id, key, text, with_ids), capacity)
