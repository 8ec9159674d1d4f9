import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basketlens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=15))
def test_plan_uses_every_piece_once(counts):
    bins = packing.plan(counts, 40)
    used = Counter()
    for lengths, times in bins:
        assert sum(lengths) <= 40
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in bins) <= 2 * max(1, -(-total // 40))


def test_two_smaller_pieces_replace_the_smallest():
    # greedy gives 6 + 3 with a gap of 1; 2 + 2 fill the widened gap of 4
    assert ([6, 2, 2], 1) in packing.plan({6: 1, 3: 1, 2: 2}, 10)


def test_word_ids_equal_the_tokenizer():
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    for t in ["", " ", "The, the. THE!!", "don't stop's it's", "a<|endoftext|>b", "x\x0by\x85z é́ İ ßſ", "1,2.3 a.b,c '.'", "日本語 текст"]:
        assert encoder.ids(pa.array([t]))[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_ids_of_many_texts_whatever_is_kept(monkeypatch):
    r, tokenizer = random.Random(3), Tokenizer.from_file(PATH)
    pool = "abCDE ' .,!?-#$ éÉßİΣσſ½²①Ⅷñ\u0338\u0301<=\u0345日я\x0b\x0c\r\x85\n\t019"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [None]
    for keep in (10, 500_000):
        monkeypatch.setattr(packing, "CACHED_WORDS", keep)
        encoder = packing.WordEncoder(PATH)
        for k in range(0, len(texts), 500):
            ids, at = encoder.ids(pa.array(texts[k : k + 510]).slice(3))
            for t, a, b in zip(texts[k + 3 : k + 510], at, at[1:]):
                assert ids[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def one_by_one(counts: dict, capacity: int) -> list:
    """The same choices, piece by piece, without a histogram."""
    left, bins = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True), []
    while left:
        chosen, gap = [], capacity
        for x in list(left):
            if x <= gap:
                chosen.append(x)
                left.remove(x)
                gap -= x
        while gap:
            small = min(chosen)
            pairs = [(-(a + b), a, b) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= gap + small]
            if not pairs:
                break
            total, a, b = min(pairs)
            chosen.remove(small)
            left.remove(a)
            left.remove(b)
            left = sorted([*left, small], reverse=True)
            chosen += [a, b]
            gap += small + total
        bins.append(sorted(chosen, reverse=True))
    return bins


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=9))
def test_plan_equals_choosing_one_by_one(counts):
    got = [x for x, times in packing.plan(counts, 40) for _ in range(times)]
    expected = one_by_one(counts, 40)
    assert [sum(x) for x in got] == [sum(x) for x in expected] and got == expected


def test_pieces_and_places(docs, rows):
    tokenizer = Tokenizer.from_file(PATH)
    got = packing.pack(docs, PATH, 128).collect()
    expected = []
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        expected += [(i, p, 128 * p, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for p, x in enumerate(ids[k : k + 128] for k in range(0, len(ids), 128))]
    order = lambda rows: sorted(rows, key=repr)
    assert order((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == order(expected)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 128


def test_empty_table(nothing):
    assert packing.pack(nothing, PATH).count() == 0
