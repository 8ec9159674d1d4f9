"""SimHash near-duplicate groups through a Gray-order hierarchical index.

A fingerprint bit is set where over half of a text's shingle hashes have it set. Fingerprints that
differ in at most ``most`` bits are linked. Each distinct fingerprint is filed under ``most + 1``
blocks of its bits; two linked ones agree on a block, so they meet in a bucket. A bucket over
``crowd`` is filed again by blocks of its other bits, as often as needed, so no bucket is large.

In a lot of buckets, fingerprints are sorted by the Gray rank of their bits, which puts those with
few differences side by side. Upper nodes hold the bits that all below share, as mask and pattern.
Pairs of nodes are compared from the roots down: differing shared bits count against all pairs below,
so a pair over the limit is pruned with all its members; a pair whose worst case is within the limit
is joined at once; and members that are in one group already are passed by. Each lot gives at most
one link per fingerprint, so a dense bucket never yields its pairs. Links are then joined over the
whole corpus (components.py).

A text with fewer words than a shingle is one shingle; one without words, or null, has fingerprint
zero and is linked like any other. Repeated rows share a fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.components import stars
from basketlens.llm.runtime import binary_texts, cut, dealt_anew, ready, renamed, text_key, text_keys, trimmed

SEED = 42
BITS = 64
FAN = 4
#: Pairs of nodes whose members are compared at once.
PARENTS = 1 << 15
#: Cells in which shingles are counted, to tell rare from common ones; any count gives the same result.
CELLS = 1 << 20
_CELL_PART = 1 << 12
_CELL_SHIFT = np.uint64(44)


def fingerprint(text: bytes, width: int) -> int:
    """Of the lower-cased (A-Z) text's word shingles, repeats included, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    total = np.zeros(BITS, np.int64)
    for k in range(0, h.size, 1 << 15):
        part = h[k : k + (1 << 15)]
        total += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > h.size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (the fingerprint's bits as a signed long) of every row."""
    ready(docs.sparkSession)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in binary_texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[key, "fp"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp bigint")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each bit string in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def blocks_of(mask: int, parts: int) -> list[int]:
    """The set bits of the mask, dealt into that many masks of neighbouring bits; empty ones are left out."""
    bits = [i for i in range(BITS) if mask >> i & 1]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:]) if i < j]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Joined:
    """Sets of members, each named by its least."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


class GrayIndex:
    """The hierarchy over buckets of fingerprints: levels of nodes with shared bits."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), bucket))
        self.order, self.fp = order, fp[order]
        b = bucket[order]
        new = np.concatenate([[True], b[1:] != b[:-1]])
        place = np.arange(b.size) - np.flatnonzero(new)[np.cumsum(new) - 1]
        first = np.arange(b.size)  # of each node, its first member
        self.levels = [(first, self.fp, np.full(b.size, ~np.uint64(0)), None)]
        step = 1
        while place.max(initial=0) >= step:
            step *= FAN
            above = np.flatnonzero(place[first] % step == 0)  # nodes of this level that open one above
            ones = np.bitwise_and.reduceat(self.levels[-1][1] & self.levels[-1][2], above)
            zeros = np.bitwise_and.reduceat(~self.levels[-1][1] & self.levels[-1][2], above)
            children = np.append(above, first.size)
            first = first[above]
            self.levels.append((first, ones, ones | zeros, children))

    def joined(self, most: int) -> Joined:
        """Members within ``most`` bits of each other in a bucket, linked."""
        sets, n = Joined(self.fp.size), self.fp.size
        ends = [np.append(first[1:], n) for first, *_ in self.levels]
        top = len(self.levels) - 1
        roots = np.arange(self.levels[top][0].size)
        todo = [(top, roots, roots)]
        while todo:  # depth first, PARENTS pairs at a time, so that what waits stays small
            level, a, b = todo.pop()
            if a.size > PARENTS:
                todo.append((level, a[PARENTS:], b[PARENTS:]))
                a, b = a[:PARENTS], b[:PARENTS]
            first, pattern, mask, children = self.levels[level]
            # groups that are one set already
            low = np.minimum.reduceat(sets.root, first)
            one = low == np.maximum.reduceat(sets.root, first)
            keep = ~(one[a] & one[b] & (low[a] == low[b]))
            a, b = a[keep], b[keep]
            shared = mask[a] & mask[b]
            apart = np.bitwise_count((pattern[a] ^ pattern[b]) & shared)
            keep = apart <= most
            a, b, shared, apart = a[keep], b[keep], shared[keep], apart[keep]
            sure = apart + np.bitwise_count(~shared) <= most
            if sure.any():  # every member of both is within the limit of every other
                x, y = a[sure], b[sure]
                sets.link(first[x], first[y])
                for node in (x, y):
                    size = ends[level][node] - first[node]
                    inside = np.repeat(first[node], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
                    sets.link(inside, np.repeat(first[node], size))
                a, b = a[~sure], b[~sure]
            if not a.size or not level:
                continue
            i = children[a][:, None, None] + np.arange(FAN)[:, None]
            j = children[b][:, None, None] + np.arange(FAN)[None, :]
            i, j = np.broadcast_arrays(i, j)
            real = (i < children[a + 1][:, None, None]) & (j < children[b + 1][:, None, None]) & ((a != b)[:, None, None] | (i <= j))
            if level == 1:
                real &= i != j
            todo.append((level - 1, i[real], j[real]))
        return sets


def links(fps: DataFrame, most: int, crowd: int = 20_000) -> DataFrame:
    """a, b: pairs of distinct fingerprints that link all that are within ``most`` bits (through others, too).

    fps: fp (distinct).
    """
    fps = fps.select("fp")
    found: DataFrame | None = None
    # (mask of bits that a bucket's members agree on) -> fingerprints filed there
    level = fps.select("fp", F.lit(0).cast("bigint").alias("mask"))
    masks = [0]
    while True:
        parts = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(m | p)) for p in blocks_of(~m & (1 << BITS) - 1, most + 1)]))])
        filed = level.select("fp", F.explode(F.element_at(parts, F.col("mask"))).alias("mask"))
        masks = sorted({m | p for m in masks for p in blocks_of(~m & (1 << BITS) - 1, most + 1)})
        filed = filed.withColumn("bucket", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = filed.groupBy("mask", "bucket").agg(F.count("*").alias("n")).where("n > 1")
        full = cut(sizes.where(F.col("n") > crowd))
        hot = full.limit(1).count() > 0 and any(m != (1 << BITS) - 1 for m in masks)
        small = filed.join(full.select("mask", "bucket"), ["mask", "bucket"], "left_anti") if hot else filed
        got = small.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket").mapInArrow(_joiner(most), "a bigint, b bigint")
        found = got if found is None else found.unionByName(got)
        if not hot:
            return found
        level = cut(filed.join(full.select("mask", "bucket"), ["mask", "bucket"]).select("fp", "mask").distinct())
        masks = [int(r[0]) & (1 << BITS) - 1 for r in full.select("mask").distinct().collect()]  # block masks, not data


def _joiner(most: int, lot: int = 200_000):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(mask: np.ndarray, bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = (mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1])
            number = np.concatenate([[0], np.cumsum(new)])
            alone = np.bincount(number) == 1
            keep = ~alone[number]
            fp = fp[keep].view(np.uint64)
            if not fp.size:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
            index = GrayIndex(number[keep], fp)
            root = index.joined(most).root
            at = np.flatnonzero(root != np.arange(root.size))
            own = index.fp.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[root[at]])], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            held.append(tuple(batch.column(x).to_numpy(zero_copy_only=False) for x in ("mask", "bucket", "fp")))
            size += batch.num_rows
            if size < lot:
                continue
            mask, bucket, fp = (np.concatenate(x) for x in zip(*held))
            border = np.flatnonzero((mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1]))
            if not border.size:
                held = [(mask, bucket, fp)]
                continue
            k = int(border[-1]) + 1
            yield done(mask[:k], bucket[:k], fp[:k])
            held, size = [(mask[k:], bucket[k:], fp[k:])], mask.size - k
        if size:
            yield done(*(np.concatenate(x) for x in zip(*held)))

    return run


def near_groups(prints: DataFrame, most: int = 4, key: str = "doc_id", crowd: int = 20_000) -> DataFrame:
    """key, fp and component_id, the least key that is reachable over links, of every row of fingerprints()."""
    prints = cut(prints)
    distinct = cut(prints.groupBy("fp").agg(F.min(key).alias("least")))
    of = stars(links(distinct, most, crowd))
    rooted = distinct.join(of, distinct["fp"] == of["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    group = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(group, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(key, "fp", "component_id")


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of the lower-cased (A-Z) text; of fewer words, one of all; of none, 0."""
    words = text.lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, h.size - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, h.size)):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (a.size + b.size - both)


def _cells(docs: DataFrame, column: str, width: int) -> np.ndarray:
    """How many shingles of all rows fall into each of CELLS cells by hash: as a cell's count, so rare or common."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for t in binary_texts(batch.column(0)):
                np.add.at(total, (shingles(t, width) >> _CELL_SHIFT).astype(np.int64), 1)
        parts = total.reshape(-1, _CELL_PART)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table["n"].to_pylist())
        return pa.table({"part": table["part"][:1].cast(pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    cells = np.zeros((CELLS // _CELL_PART, _CELL_PART), np.int64)
    for part, n in docs.select(column).mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():
        cells[part] = np.frombuffer(n, np.int64)
    return cells.reshape(-1)


def prefix(grams: np.ndarray, cells: np.ndarray, least: float) -> np.ndarray:
    """The first shingles in the common order, rare cells first: two sets with Jaccard ``least`` share one of these."""
    ordered = grams[np.lexsort((grams, cells[(grams >> _CELL_SHIFT).astype(np.int64)]))]
    return ordered[: grams.size - math.ceil(least * grams.size - 1e-9) + 1]


def _can(size: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether rows i and j, whose first common shingle stands at these places, can have so many in common."""
    return np.minimum(size[i] - at[i], size[j] - at[j]) >= np.ceil(least / (1 + least) * (size[i] + size[j]) - 1e-6)


NAMES = ["h", "id", "size", "at"]


def _buckets(judge, whole, crowd: int, lot: int = 200_000):
    """A function on batches of rows (h, id, size, at) sorted by h, some buckets at a time: judge() gets those of at most ``crowd`` rows, whole() the rows of others."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, large = 0, None  # large: the bucket at the end of what is done, if it has over crowd rows

        def done(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, large
            h = columns[0]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.append(first, h.size))
            big = sizes > crowd
            big[0] |= large is not None and h[0] == large
            ready_, held, rows = np.ones(first.size, bool), [], 0
            ready_[-1] = last or big[-1]
            large = int(h[-1]) if big[-1] else None
            for keep, what in ((ready_ & ~big, judge), (ready_ & big, whole)):
                if keep.any():
                    at = np.repeat(keep, sizes)
                    yield what(dict(zip(NAMES, (x[at] for x in columns))))
            if not ready_[-1]:
                held, rows = [[x[first[-1] :] for x in columns]], int(sizes[-1])

        for batch in batches:
            held.append([batch.column(x).to_numpy(zero_copy_only=False) for x in NAMES])
            rows += batch.num_rows
            if rows >= lot:
                yield from done([np.concatenate(x) for x in zip(*held)], False)
        if rows:
            yield from done([np.concatenate(x) for x in zip(*held)], True)

    return run


def _neighbours(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of all pairs of rows with the same h (sorted), by their distance."""
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.append(first, h.size))
    left = np.repeat(first + sizes, sizes) - np.arange(h.size)  # rows of the bucket from this one on
    i = np.flatnonzero(left > 1)
    step = 1
    while i.size:
        yield i, i + step
        step += 1
        i = i[left[i] > step]


def _paired(least: float, crowd: int):
    """Rows (h, id, size, at) that can be similar to another of their bucket; of buckets over ``crowd`` rows, all."""

    def judge(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        new = np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["id"][1:] != x["id"][:-1])])
        x = {k: v[new] for k, v in x.items()}  # copies of a text are one
        keep = np.zeros(x["h"].size, bool)
        for i, j in _neighbours(x["h"]):
            can = _can(x["size"], x["at"], i, j, least)
            keep[i[can]] = keep[j[can]] = True
        return whole({k: v[keep] for k, v in x.items()})

    def whole(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v) for v in x.values()], names=NAMES)

    return _buckets(judge, whole, crowd)


def _pairs(least: float, crowd: int):
    """u and v, pairs of a bucket that can be similar; of buckets over ``crowd`` rows, the rows: h, u (id), size, at."""
    names = ["h", "u", "v", "size", "at"]

    def judge(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        pairs = [np.zeros((0, 2), np.int64)]
        for i, j in _neighbours(x["h"]):
            can = (x["id"][i] != x["id"][j]) & _can(x["size"], x["at"], i, j, least)
            pairs.append(np.column_stack([x["id"][i[can]], x["id"][j[can]]]))
        got = np.unique(np.concatenate(pairs), axis=0)
        none = pa.nulls(len(got), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(got[:, 0]), pa.array(got[:, 1]), none.cast(pa.int32()), none.cast(pa.int32())], names=names)

    def whole(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x["h"]), pa.array(x["id"]), pa.nulls(x["h"].size, pa.int64()), pa.array(x["size"]), pa.array(x["at"])], names=names)

    return _buckets(judge, whole, crowd)


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) with Jaccard ``least`` or more. sets: id, grams."""

    @trimmed
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch.column(x).to_pylist() for x in ("ugrams", "vgrams")))
            close = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(close, pa.bool_()))

    of = lambda x: dealt_anew(sets.select(F.col("id").alias(x), F.col("grams").alias(f"{x}grams")), x).hint("merge")
    return cut(pairs.join(of("v"), "v").join(of("u"), "u").select("u", "v", "ugrams", "vgrams").mapInArrow(compare, "u bigint, v bigint"))


def _leaders(texts: DataFrame, most: int, crowd: int) -> DataFrame:
    """u and v: the text nearest to the bitwise majority of a fingerprint group, and each other of the group. texts: k1, fp."""
    star = stars(links(cut(texts.select("fp").distinct()), most, crowd))
    rooted = cut(texts.join(star.hint("merge"), texts["fp"] == star["node"], "left").select(F.col("k1").alias("id"), "fp", F.coalesce("root", "fp").alias("root")))
    bits = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(1)).alias(f"b{i}") for i in range(BITS)]
    centre = F.expr(" | ".join(f"case when 2 * b{i} > m then shiftleft(1L, {i}) else 0L end" for i in range(BITS)))
    centres = rooted.groupBy("root").agg(F.count("*").alias("m"), *bits).where("m > 1").select("root", centre.alias("centre"))
    near = cut(rooted.join(dealt_anew(centres, "root").hint("merge"), "root").select("root", "id", F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))).alias("d")))
    first = near.groupBy("root").agg(F.min(F.struct("d", "id")).getField("id").alias("u"))
    return cut(near.join(dealt_anew(first, "root").hint("merge"), "root").where("id <> u").select("u", F.col("id").alias("v")))


def _crowded(live: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Similar pairs (u, v) of rows (h, id, size, at) in large buckets, enough to join all that are similar through others.

    In a round, some rows of each bucket, one of each cell by hash, are compared with all of it. They
    leave the bucket then, and so does of similar texts each but the least everywhere: it goes in any
    case. Cells become more with each round. Hot buckets can be split in all of these joins.
    """
    found, cells = None, 8
    enough = F.least(F.col("size") - F.col("at"), F.col("usize") - F.col("uat")) >= F.ceil(F.lit(least / (1 + least)) * (F.col("size") + F.col("usize")) - 1e-6)
    while live.limit(1).count():
        cell = F.pmod(F.xxhash64("id"), F.lit(cells))
        first = cut(live.groupBy("h", cell.alias("cell")).agg(F.min(F.struct("id", "size", "at")).alias("x")).select("h", F.col("x.id").alias("lead"), F.col("x.size").alias("usize"), F.col("x.at").alias("uat")))
        met = live.join(dealt_anew(first, "h").hint("merge"), "h").where((F.col("id") != F.col("lead")) & enough)
        similar = _similar(met.select(F.least("id", "lead").alias("u"), F.greatest("id", "lead").alias("v")).distinct(), sets, least)
        found = similar if found is None else found.unionByName(similar)
        goes = stars(similar.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("node").alias("id"))
        led = dealt_anew(first.select("h", F.col("lead").alias("id")), "h", "id")
        left = live.join(led.hint("merge"), ["h", "id"], "left_anti").join(dealt_anew(goes, "id").hint("merge"), "id", "left_anti")
        live = cut(left.select(*NAMES))
        cells *= 8
    return found


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, most: int = 6, crowd: int = 20_000, near: int = 1000) -> DataFrame:
    """docs less near copies: of texts that are joined by Jaccard similarity ``least``, directly or through others, some stay, and no two that stay have it.

    Similarity is that of the sets of shingles of ``width`` words. Rows with the same text are one
    document, of which the row with the least key stays. First, fingerprints of the distinct words
    within ``most`` bits form groups, and in each the text nearest to the bitwise majority is compared
    with all others: those similar to it go. The rest is joined exactly: with shingles in a common
    order, rare ones first, similar texts share one of the first few, at places that leave enough for
    the similarity. All such pairs are compared; where a shingle has over ``near`` texts, in rounds.
    Of texts joined by similar pairs, one stays.

    Keys are integers; a null key comes before all others. Repeated rows (key and text) count as one,
    as do null and empty texts. A text under ``width`` words is one shingle. A very long text is one
    set, held whole. Columns may have any names. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    plain, names, column = renamed(docs, text)
    keyed = text_keys(plain.withColumn("a", F.coalesce(F.col(names[key]).cast("bigint"), F.lit(-(1 << 63)))), column)

    @trimmed
    def fingers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_texts(batch.column(1))
            fp = np.array([fingerprint(b" ".join(set(t.lower().split())), 1) for t in texts], np.uint64)
            k = np.array([text_key(t) for t in texts], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(fp.view(np.int64))], names=["a", "k1", "k2", "fp"])

    rows = keyed.select("a", column).mapInArrow(fingers, "a bigint, k1 bigint, k2 bigint, fp bigint")
    texts = cut(rows.groupBy("k1", "k2").agg(F.min("a").alias("a"), F.first("fp").alias("fp"), F.count("*").alias("n")))
    led = _leaders(texts, most, crowd)

    cells = docs.sparkSession.sparkContext.broadcast(_cells(keyed, column, width))

    @trimmed
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                new = {}
                for i, x in enumerate(part.column(0).to_pylist()):
                    if x not in seen:  # copies of a text are filed once, as far as this task remembers
                        new.setdefault(x, i)
                seen.update(new)
                if len(seen) > 500_000:
                    seen.clear()
                if not new:
                    continue
                sets = [shingles(t, width) for t in binary_texts(part.column(1).take(pa.array(list(new.values()))))]
                first = [prefix(x, cells.value, least) for x in sets]
                n = [x.size for x in first]
                at = np.concatenate([np.arange(x) for x in n])
                own = np.repeat(np.array(list(new), np.int64), n), np.repeat([x.size for x in sets], n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(own[0]), pa.array(own[1].astype(np.int32)), pa.array(at.astype(np.int32))], names=NAMES)

    spec = "h bigint, id bigint, size int, at int"
    filed = lambda df: df.repartition("h").sortWithinPartitions("h", "id")
    live = cut(filed(keyed.select("k1", column).mapInArrow(postings, spec)).mapInArrow(_paired(least, near), spec))

    @trimmed
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, width).tobytes() for t in binary_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "grams"])

    of_row = ["a", "k1", "k2"]
    asked = live.select("id").unionByName(led.select(F.col("u").alias("id"))).unionByName(led.select(F.col("v").alias("id"))).distinct()
    asked = asked.join(texts.select(*of_row).hint("merge"), F.col("id") == F.col("k1")).select(*of_row)
    own = cut(keyed.select(*of_row, column).join(asked.hint("merge"), of_row).dropDuplicates(of_row).select("k1", column).mapInArrow(sets, "id bigint, grams binary"))

    copies = _similar(led, own, least).select(F.col("v").alias("id"))
    rest = live.join(dealt_anew(copies, "id").hint("merge"), "id", "left_anti").select(*NAMES)
    met = cut(filed(rest).mapInArrow(_pairs(least, near), "h bigint, u bigint, v bigint, size int, at int"))
    joined = _similar(met.where("v is not null").select("u", "v").distinct(), own, least)
    many = _crowded(met.where("v is null").select("h", F.col("u").alias("id"), "size", "at").distinct(), own, least)
    if many is not None:
        joined = joined.unionByName(many)
    other = stars(joined.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("node").alias("id"))
    kept = texts.join(dealt_anew(copies.unionByName(other), "id").hint("merge"), F.col("k1") == F.col("id"), "left_anti").select(*of_row)
    left = keyed.join(kept.hint("merge"), of_row)
    repeats = texts.agg(F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).first()[0]
    if repeats:  # a repeated row has the key and text of the one that stays
        left = left.dropDuplicates(of_row)
    return left.select(*[F.col(y).alias(x) for x, y in names.items()])
