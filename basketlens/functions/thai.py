"""Repairs and tokens that need word segmentation, over any segmenter of known words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from basketlens.functions.text import COMBINING

SARA_AA, SARA_AM = "า", "ำ"
_RUN, _SPLIT_AM = re.compile("[฀-๿]+"), re.compile(f"([ก-ฮ][{COMBINING}]*)\\s+{SARA_AA}")

# Measures, preparations and function words that are no ingredients.
MEASURES = "กรัม กก กิโลกรัม ขีด ช้อนโต๊ะ ช้อนชา ช้อน ถ้วย ตวง ลูก ใบ หัว แว่น ต้น ฟอง ตัว มล ลิตร ซีซี กำ ช่อ ฝัก กลีบ ก้อน แผ่น ชิ้น ขวด ห่อ ถุง กระป๋อง ปอนด์ ออนซ์ ทัพพี นิ้ว เม็ด ชุด แง่ง หยด กระปุก กล่อง ขีดครึ่ง ซอง"
PREPARATIONS = "หั่น สับ บด ซอย โขลก ทุบ ลวก ต้ม ปิ้ง ย่าง ทอด แกะ ล้าง ผ่า นึ่ง คั่ว ตำ ป่น ฉีก บุบ เจียว ผัด ปอก ขูด สไลซ์ เต๋า แช่ หมัก ตี ร่อน กรอง คน เคี่ยว ละลาย พัก เด็ด โรย ฝาน สะเด็ด"
FUNCTION_WORDS = "สำหรับ พอ พอให้ ตามชอบ ตาม ชอบ เล็กน้อย ประมาณ หรือ และ ที่ ของ ใช้ ไว้ ให้ ท่วม อย่าง นิด หน่อย ครับ ค่ะ คะ นะ เตรียม ส่วนผสม กับ ใน จาก เป็น มี ไม่ ก็ แล้ว ๆ ได้ ต่อ ด้วย เพิ่ม ตกแต่ง เสิร์ฟ ราด ครึ่ง ทั้ง อีก ส่วน ท่าน คน"
STOP = frozenset(f"{MEASURES} {PREPARATIONS} {FUNCTION_WORDS}".split())

Segmenter = Callable[[str], list[str]]


def fewest_words(words: Iterable[str]) -> Segmenter:
    """Cuts a run into pieces, of which as few as can be are unknown, and then as few as can be in all."""
    known = frozenset(words)
    longest = max(map(len, known), default=1)

    @lru_cache(maxsize=50_000)
    def cut(run: str) -> tuple[str, ...]:
        best: list[tuple[int, int, int]] = [(0, 0, 0)]  # unknown, pieces, where the last piece starts
        for end in range(1, len(run) + 1):
            unknown, pieces, _ = best[end - 1]
            choice = (unknown + (run[end - 1] not in known), pieces + 1, end - 1)
            for start in range(max(0, end - longest), end):
                if run[start:end] in known:
                    choice = min(choice, (best[start][0], best[start][1] + 1, start))
            best.append(choice)
        out, end = [], len(run)
        while end:
            start = best[end][2]
            out.append(run[start:end])
            end = start
        return tuple(reversed(out))

    return lambda run: list(cut(run))


def cost(run: str, segment: Segmenter, words: frozenset[str]) -> tuple[int, int]:
    """(unknown pieces, pieces): the lower, the better a reading."""
    pieces = [p for p in segment(run) if p.strip()]
    return sum(p not in words for p in pieces), len(pieces)


def repair_am(text: str, segment: Segmenter, words: frozenset[str]) -> tuple[str, int, int, int]:
    """A consonant parted from its vowel: joined as it is, or as sara am, whichever reads better; a tie stays as found.

    Gives the text and how many were read as sara am, joined, and left.
    """
    n = {"am": 0, "aa": 0, "left": 0}

    def reading(m: re.Match, vowel: str) -> tuple[int, int]:
        whole, at = text[: m.start()] + m.group(1) + vowel + text[m.end() :], m.start()
        run = next(r for r in _RUN.finditer(whole) if r.start() <= at < r.end())
        return cost(run.group(), segment, words)

    def choose(m: re.Match) -> str:
        am, aa = reading(m, SARA_AM), reading(m, SARA_AA)
        which = "am" if am < aa else "aa" if aa < am else "left"
        n[which] += 1
        return m.group() if which == "left" else m.group(1) + (SARA_AM if which == "am" else SARA_AA)

    fixed = _SPLIT_AM.sub(choose, text)
    return fixed, n["am"], n["aa"], n["left"]


def tokens(line: str, segment: Segmenter) -> list[str]:
    """Content words of an ingredient line: brackets, then numbers go; pieces of two characters or more that are no stop words."""
    plain = re.sub(r"\([^)]*\)|\*+", " ", unicodedata.normalize("NFC", line))
    plain = re.sub(r"[0-9๐-๙]+(?:[./+\-][0-9๐-๙]+)*", " ", plain)
    pieces = (p for part in plain.split() for run in re.findall("[฀-๿]+|[^฀-๿]+", part) for p in (segment(run) if _RUN.match(run) else [run]))
    return [p for p in pieces if len(p) >= 2 and p not in STOP and re.search("[ก-๙a-zA-Z]", p)]


def word_count(text: str, segment: Segmenter) -> int:
    """Words of Thai runs as segmented, and others as they stand."""
    return sum(len(segment(r)) if _RUN.match(r) else 1 for r in re.findall("[฀-๿]+|[A-Za-z0-9]+", text))


def repaired(c: Column, words: Iterable[str]) -> Column:
    """struct(text, am, joined, ambiguous); the word list goes with the function."""
    known = frozenset(words)
    kind = StructType([StructField("text", StringType()), *[StructField(x, IntegerType()) for x in ("am", "joined", "ambiguous")]])

    @F.pandas_udf(kind)
    def run(text: pd.Series) -> pd.DataFrame:
        segment = fewest_words(known)
        return pd.DataFrame([repair_am(x, segment, known) if x is not None else (None, 0, 0, 0) for x in text], columns=["text", "am", "joined", "ambiguous"])

    return run(c)


def line_tokens(c: Column, words: Iterable[str]) -> Column:
    known = frozenset(words)

    @F.pandas_udf(ArrayType(StringType()))
    def run(text: pd.Series) -> pd.Series:
        segment = fewest_words(known)
        return text.map(lambda x: tokens(x, segment) if x is not None else None)

    return run(c)


def words_in(c: Column, words: Iterable[str]) -> Column:
    """As word_count()."""
    known = frozenset(words)

    @F.pandas_udf(IntegerType())
    def run(text: pd.Series) -> pd.Series:
        segment = fewest_words(known)
        return pd.Series([None if x is None else word_count(x, segment) for x in text], dtype="Int32")

    return run(c)
