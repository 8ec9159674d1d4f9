"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

Tokens are the words of the lower-cased (A-Z) text and one end. Each word has a path of classes, one at
each of LEVELS: the first BY_ENDING by a hash of its ending, the others by a hash of the word. The
model's probability of a token is the product of those of its classes, each by a softmax over the
classes of its level given the words before it and the classes above, and that of the token in its last
class. Logits are sums of weights of
hashed features: the word before (n-gram), the one before that (skip) and the pair of both, whole words
or, for the classes by ending, endings of the latter two; on top of a prior, the log shares of the classes
below the class above. Weights are trained by gradient steps: each task runs
AdaGrad over its own training tokens, and tasks' weights are averaged, each row by how often the task
saw it, in a tree of sums; ``rounds`` such passes are made. How rows are dealt to tasks thus enters the
weights. In the last class, which frequent words have nearly for themselves, tokens have add-one
relative frequency over all training tokens, with one share for all unknown tokens of the class, so the
probabilities of a context sum to one.

Exact counts of words cannot be held anywhere as a whole. Rows are dealt into blocks of about
BLOCK_BYTES by a hash of key and text; a block counts its words, counts are summed by word, and a word's
sum goes back only to blocks that cannot know it themselves, because other blocks have the word, too.
Each block is then scored with its counts. What is sent grows with the corpus, what a task holds does not.

Null text is empty: one end token. Rows with a null key are scored, and are training text as the
condition says. Repeated rows are scored each; those of one key and text share a block. A very long text
is one row of its block. Only key and text are read, so other columns may have any names. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.runtime import cut, ready, release, trimmed

#: Classes of each level below one of the level above, and rows of weights for each of its features.
LEVELS = (8, 8, 8, 8)
ROWS = (1 << 12, 1 << 13, 1 << 13, 1 << 15)
#: Levels whose class is a hash of the ending.
BY_ENDING = 3
#: Features at the levels by ending, and at the others.
FEATURES = (2, 3)
LEAVES = math.prod(LEVELS)
BLOCK_BYTES = 32_000_000
STEP = 8192
#: Tokens that are learned from or scored at once.
LOT = 1 << 17
#: Longer words go by a digest, of equal length whatever the word.
LONG = 40
END = b""
_CHUNK_ROWS = 1024


def word_key(word: bytes) -> bytes:
    """The word, or for a long one its digests and last three bytes behind a byte that UTF-8 has not."""
    return word if len(word) <= LONG else b"\xff" + hashlib.md5(word).digest() + zlib.crc32(word).to_bytes(4, "little") + word[-3:]


def _bytewise() -> np.ndarray:
    """What crc32 does to each value of a byte."""
    h = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        h = np.where(h & np.uint32(1), h >> np.uint32(1) ^ np.uint32(0xEDB88320), h >> np.uint32(1))
    return h


_BYTEWISE = _bytewise()


def key_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of the word of each key, the bytes of data from begin to end: of all keys at once, byte by byte."""
    size, out = end - begin, np.zeros(begin.size, np.uint32)
    live = np.flatnonzero(size > 0)
    at, h, left = begin[live], np.full(live.size, 0xFFFFFFFF, np.uint32), size[live]
    while live.size:
        h = _BYTEWISE[(h ^ data[at]) & np.uint32(255)] ^ h >> np.uint32(8)
        at, left = at + 1, left - 1
        if not left.all():
            out[live[left == 0]] = ~h[left == 0]
            more = left > 0
            live, at, h, left = live[more], at[more], h[more], left[more]
    digest = np.flatnonzero(size > 20)
    digest = digest[data[begin[digest]] == 0xFF]
    out[digest] = sum(data[begin[digest] + 17 + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def hashes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each word key a hash of the word's ending (up to three bytes) and one of the word; both are 0 for the end only."""
    keys = keys.cast(pa.large_binary())
    if not len(keys):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    offsets = np.frombuffer(keys.buffers()[1], "<i8")[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2], np.uint8) if keys.buffers()[2] else np.zeros(1, np.uint8)
    begin, end = offsets[:-1], offsets[1:]
    a, b, c = (np.where(end - begin > k, data[np.maximum(end - 1 - k, 0) % max(data.size, 1)], 0).astype(np.uint32) for k in range(3))
    h = (a | b << np.uint32(8) | c << np.uint32(16)) * np.uint32(0x9E3779B1)
    some = end > begin
    ending = np.where(some, _mixed(h ^ (h >> np.uint32(15))) | np.uint32(1), np.uint32(0))
    return ending, np.where(some, np.maximum(key_hashes(data, begin, end), 1), np.uint32(0)).astype(np.uint32)


class Tokens:
    """The tokens of some texts, as places in a list of word keys, of which the first is the end's."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat = split.flatten()
        some = pc.not_equal(flat, "")
        none = np.flatnonzero(~some.to_numpy(zero_copy_only=False))  # before the first and after the last word
        lists = split.offsets.to_numpy() - split.offsets[0].as_py()
        #: Where the tokens of each text begin, with the end of the last.
        self.begin = lists - np.searchsorted(none, lists) + np.arange(lists.size)
        if none.size:
            flat = flat.filter(some)
        coded = flat.dictionary_encode()
        del split, flat, some  # as large as the texts, or larger
        self._led = np.zeros(2 + int(self.begin[-1]), np.int32)  # led by two ends
        self.at = self._led[2:]
        inside = np.ones(self.at.size, bool)
        inside[self.begin[1:] - 1] = False
        self.at[inside] = coded.indices.to_numpy()
        self.at += inside
        words = coded.dictionary.cast(pa.large_binary())
        long = pc.greater(pc.binary_length(words), LONG)
        if pc.any(long).as_py():
            words = pc.replace_with_mask(words, long, pa.array([word_key(w) for w in words.filter(long).to_pylist()], pa.large_binary()))
        self.keys = pa.concat_arrays([pa.array([END], pa.large_binary()), words])

    def lots(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Tokens in lots of LOT: which, and the hashes of their ending and word, with those of two tokens before."""
        ending, word = hashes(self.keys)
        for k in range(0, self.at.size, LOT):
            own = self._led[k : k + LOT + 2]
            yield slice(k, k + own.size - 2), np.take(ending, own), np.take(word, own)


def paths(ending: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """The class of each token at each level."""
    out, h = [], _mixed(ending ^ np.uint32(0x2545F491))
    for level, size in enumerate(LEVELS):
        if level == BY_ENDING:
            h = _mixed(word ^ np.uint32(0x2545F491))
        out.append((h % np.uint32(size)).astype(np.int64))
        h = h // np.uint32(size)
    return out


def leaf(path: list[np.ndarray]) -> np.ndarray:
    out = path[0]
    for c, size in zip(path[1:], LEVELS[1:]):
        out = out * size + c
    return out


def key_leaves(keys: pa.Array) -> np.ndarray:
    """Last class of each word key, as a number."""
    return leaf(paths(*hashes(keys)))


def features(level: int) -> int:
    return FEATURES[level >= BY_ENDING]


def contexts(ending: np.ndarray, word: np.ndarray, path: list[np.ndarray]) -> list[np.ndarray]:
    """For each level, the rows of its weights that each token's features name, and that of the prior that the classes above name: (features + 1, tokens); nothing reaches over an end.

    ending and word begin with those of the two tokens before.
    """
    e1, w1 = ending[1:-1], word[1:-1]
    over = w1 == 0
    w2 = np.where(over, np.uint32(0), word[:-2])
    e2 = np.where(over, np.uint32(0), ending[:-2])
    pair = (w1 * np.uint32(0x01000193)) ^ (w2 * np.uint32(0xC2B2AE35))
    ends = (e1 * np.uint32(0x01000193)) ^ (e2 * np.uint32(0xC2B2AE35))
    out, above = [], np.zeros(w1.size, np.uint32)
    for level, rows in enumerate(ROWS):
        shift = np.uint32(33 - rows.bit_length())
        of = []
        for k, x in enumerate((ends, e2) if level < BY_ENDING else (w1, w2, pair)):
            h = _mixed(x ^ (above * np.uint32(0x9E3779B1)) ^ np.uint32((k + 1) * 0x7F4A7C15 & 0xFFFFFFFF)) * np.uint32(0xC2B2AE3D)
            of.append((h >> shift).astype(np.int64) + k * rows)
        of.append(above.astype(np.int64))
        out.append(np.stack(of))
        above = above * np.uint32(LEVELS[level]) + path[level].astype(np.uint32)
    return out


def shapes() -> list[tuple[int, int]]:
    """Rows and columns of the weights of each level."""
    return [(features(level) * rows, LEVELS[level]) for level, rows in enumerate(ROWS)]


def priors(tokens: np.ndarray) -> list[np.ndarray]:
    """For each level the log shares of its classes below each class above, add-one, from the training tokens of each leaf."""
    out, n = [], tokens.astype(np.float64)
    for size in reversed(LEVELS):
        n = n.reshape(-1, size)
        out.append(np.log((n + 1) / (n.sum(axis=1, keepdims=True) + size)).astype(np.float32))
        n = n.sum(axis=1)
    return out[::-1]


def logits(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The prior and the sums of the weights that tokens' features name: (tokens, classes)."""
    z = np.take(prior, rows[-1], axis=0)  # many times as fast as prior[rows[-1]]
    for r in rows[:-1]:
        z += np.take(weights, r, axis=0)
    return np.clip(z, -60, 60, out=z)  # far beyond what is learned, and short of an overflow


def over_classes(x: np.ndarray) -> np.ndarray:
    """Sum of each row, as a product, which is many times as fast for so few columns."""
    return x @ np.ones(x.shape[1], x.dtype)


def class_logs(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural-log probabilities of all classes of a level: (tokens, classes)."""
    z = logits(weights, prior, rows)
    return z - np.log(over_classes(np.exp(z)))[:, None]


def token_logs(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural-log probability of each token's class."""
    out = np.empty(target.size, np.float32)
    for k in range(0, target.size, STEP):
        z, y = logits(weights, prior, rows[:, k : k + STEP]), target[k : k + STEP]
        own = np.take(z.ravel(), np.arange(0, z.size, z.shape[1]) + y)
        out[k : k + STEP] = own - np.log(over_classes(np.exp(z, out=z)))
    return out


class Learner:
    """AdaGrad over a task's tokens."""

    def __init__(self, weights: list[np.ndarray], prior: list[np.ndarray], rate: float = 0.3, batch: int = 1 << 17):
        self.w, self.prior, self.rate, self.batch = [w.copy() for w in weights], prior, rate, batch
        self.square = [np.ones(w.shape, np.float32) for w in weights]
        self.seen = [np.zeros(len(w), np.int64) for w in weights]

    def learn(self, tokens: Tokens) -> None:
        for _, ending, word in tokens.lots():
            path = paths(ending[2:], word[2:])
            rows = contexts(ending, word, path)
            for k in range(0, path[0].size, self.batch):
                for level, of in enumerate(rows):
                    self.step(level, of[:, k : k + self.batch], path[level][k : k + self.batch])

    def step(self, level: int, rows: np.ndarray, target: np.ndarray) -> None:
        w, square, seen, size, n = self.w[level], self.square[level], self.seen[level], ROWS[level], target.size
        g = np.empty((LEVELS[level], n))
        for i in range(0, n, STEP):
            p = logits(w, self.prior[level], rows[:, i : i + STEP])
            np.exp(p, out=p)
            np.divide(p.T, over_classes(p), out=g[:, i : i + STEP])
        g[target, np.arange(n)] -= 1
        for f in range(features(level)):
            at = rows[f] - f * size
            often = np.bincount(at)
            met = np.flatnonzero(often)
            step = np.stack([np.bincount(at, of)[met] for of in g], axis=1).astype(np.float32)
            often, met = often[met], met + f * size
            seen[met] += often
            square[met] += step**2
            w[met] -= self.rate * step / np.sqrt(square[met])


def train(docs: DataFrame, prior: list[np.ndarray], text: str = "text", rounds: int = 1) -> list[np.ndarray]:
    """Weights of each level from all rows of docs."""
    ready(docs.sparkSession)
    weights = [np.zeros(x, np.float32) for x in shapes()]
    rows = docs.select(F.col(text))
    tasks = max(1, rows.rdd.getNumPartitions())
    fan = math.isqrt(tasks - 1) + 1
    schema = "level int, part int, branch int, total binary, seen binary"
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = ["level", "part", "branch", "total", "seen"]
    for _ in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast(weights)

        @trimmed
        def learn(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            learner = Learner(held.value, prior)
            for batch in batches:
                learner.learn(Tokens(batch.column(0)))
            branch = TaskContext.get().partitionId() % fan
            for level, (w, seen) in enumerate(zip(learner.w, learner.seen)):
                parts = range(0, len(w), _CHUNK_ROWS)
                total = w * seen[:, None].astype(np.float32)
                out = [[level] * len(parts), [i for i, _ in enumerate(parts)], [branch] * len(parts), [total[k : k + _CHUNK_ROWS].tobytes() for k in parts], [seen[k : k + _CHUNK_ROWS].tobytes() for k in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table["total"].to_pylist()).astype(np.float32)
            seen = sum(np.frombuffer(x, np.int64) for x in table["seen"].to_pylist())
            out = [[table[x][0].as_py()] for x in ("level", "part", "branch")] + [[total.tobytes()], [seen.tobytes()]]
            release()
            return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)

        sums = rows.mapInArrow(learn, schema).groupBy("level", "part", "branch").applyInArrow(add, schema).groupBy("level", "part").applyInArrow(add, schema)
        for r in sums.toLocalIterator():  # as many rows as the weights have chunks
            seen, w = np.frombuffer(r["seen"], np.int64), weights[r["level"]]
            at = slice(r["part"] * _CHUNK_ROWS, r["part"] * _CHUNK_ROWS + seen.size)
            mean = np.frombuffer(r["total"], np.float32).reshape(seen.size, -1) / np.maximum(seen, 1)[:, None]
            w[at] = np.where(seen[:, None] > 0, mean, w[at])
    return weights


def own_counts(tokens: Tokens, train_: pa.ChunkedArray) -> np.ndarray:
    """How often each key of tokens stands in rows that are learned from."""
    learned = np.repeat(train_.combine_chunks().to_numpy(zero_copy_only=False).astype(bool), np.diff(tokens.begin))
    return np.bincount(tokens.at[learned], minlength=len(tokens.keys))


def shared_counts(blocked: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Of blocked rows (block, train, text): (block, word, n) where the block cannot tell the word's count n itself; and of each leaf the training tokens and the different ones."""

    def count(table: pa.Table) -> pa.Table:
        tokens = Tokens(table["text"].combine_chunks())
        n = own_counts(tokens, table["train"])
        block = pa.array(np.full(n.size, table["block"][0].as_py(), np.int32))
        out = pa.Table.from_arrays([block, tokens.keys.cast(pa.binary()), pa.array(n)], names=["block", "word", "own"])
        release()
        return out

    own = cut(blocked.select("block", "train", "text").groupBy("block").applyInArrow(count, "block int, word binary, own bigint"))
    summed = cut(own.groupBy("word").agg(F.sum("own").alias("n"), F.count("*").alias("blocks")))

    @trimmed
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, distinct = np.zeros(LEAVES, np.int64), np.zeros(LEAVES, np.int64)
        for batch in batches:
            of, n = key_leaves(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            tokens += np.bincount(of, n, LEAVES).astype(np.int64)
            distinct += np.bincount(of[n > 0], minlength=LEAVES)
        at = np.flatnonzero(tokens)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(tokens[at]), pa.array(distinct[at])], names=["leaf", "n", "distinct"])

    tokens, distinct = np.zeros(LEAVES, np.int64), np.zeros(LEAVES, np.int64)
    per = summed.select("word", "n").mapInArrow(sums, "leaf int, n bigint, distinct bigint").groupBy("leaf").agg(F.sum("n"), F.sum("distinct"))
    for at, n, v in per.collect():  # at most LEAVES rows
        tokens[at], distinct[at] = n, v
    several = summed.where("blocks > 1").select("word", "n").hint("merge")
    return cut(own.join(several, "word").where("n <> own").select("block", "word", "n")), tokens, distinct


def score(docs: DataFrame, train_rows: Column, key: str = "doc_id", text: str = "text", rounds: int = 1) -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row.

    base_score is the add-one unigram score over all training tokens.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), train_rows.alias("train"), F.col(text).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = 1 + int(total) // BLOCK_BYTES
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("int"))
    shared, tokens, distinct = shared_counts(blocked)
    n_all, v_all = int(tokens.sum()), int(distinct.sum())
    prior = priors(tokens)
    weights = train(rows.where("train"), prior, rounds=rounds)
    held = docs.sparkSession.sparkContext.broadcast(weights)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def judge(table: pa.Table, counted: pa.Table) -> pa.Table:
        w, in_leaf = held.value, np.log10(tokens + distinct + 1.0)
        said = Tokens(table["text"].combine_chunks())
        counts = own_counts(said, table["train"])
        known = pc.index_in(said.keys.cast(pa.binary()), counted["word"].combine_chunks()).to_numpy(zero_copy_only=False)
        other = ~np.isnan(known)
        counts[other] = counted["n"].to_numpy()[known[other].astype(np.int64)]
        seen = np.log10(counts + 1.0)
        logs = np.empty(said.at.size)
        for own, ending, word in said.lots():
            path = paths(ending[2:], word[2:])
            logs[own] = -in_leaf[leaf(path)]
            for level, rows_ in enumerate(contexts(ending, word, path)):
                logs[own] += token_logs(w[level], prior[level], rows_, path[level]) / math.log(10)
        n = np.diff(said.begin)
        if n.size:
            per = lambda x: np.add.reduceat(x, said.begin[:-1], dtype=x.dtype if x.dtype.kind == "f" else np.int64)
            base = per(seen[said.at])
            columns = [n, per((counts > 0)[said.at]), np.full(n.size, n_all), base - n * math.log10(n_all + v_all + 1), base + per(logs)]
        else:
            columns = [n] * 3 + [np.zeros(0)] * 2
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        out = pa.Table.from_arrays([table["key"].combine_chunks(), table["train"].combine_chunks(), *(pa.array(x, k) for x, k in zip(columns, kinds))], names=["key", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        release()
        return out

    return blocked.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(judge, schema).withColumnRenamed("key", key)
