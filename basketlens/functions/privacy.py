"""Redaction of personal data, in order, and the broader scan that must find nothing afterwards.

Reports carry classes and counts, never values.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

from basketlens.functions.text import COMBINING

REDACTED = "[REDACTED]"

# Labels, honorifics, and words that follow an honorific in titles and dishes.
HONORIFICS = ("นางสาว", "นาง", "นาย", "น.ส.", "ด.ช.", "ด.ญ.")
TITLES = ("นายอำเภอ", "นางเธอ", "นายแพทย์", "นางพยาบาล", "นายช่าง", "นายทหาร", "นายกเทศมนตรี", "นายกองค์การ", "นายกรัฐมนตรี", "นายกสภา", "นายกอบต", "นายกเหล่ากาชาด")
FOODS = ("นางฟ้า", "นางเล็ด", "นางลอย")

_D, _GAP = "[0-9๐-๙]", r"[ \t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"
_HON = "(?:" + "|".join(map(re.escape, HONORIFICS)) + ")"
_ANCHORED = rf"(?:(?<![ก-๎])|(?<=คุณ)){_HON}(?![{COMBINING}])"
_SEP = r"[ \t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\-]?"
_PHONE = rf"(?<!{_D})0{_D}{{1,2}}{_SEP}{_D}{{3,4}}{_SEP}{_D}{{4}}(?!{_D})"

# The redaction and leak patterns.
#: (class, pattern), applied in this order on the running text; a first group is a label and stays.
PATTERNS = tuple(
    (c, re.compile(p))
    for c, p in (
        ("phone", rf"(หมายเลขโทรศัพท์){_GAP}*[:：]?{_GAP}*{_D}[0-9๐-๙ \t\u00a0\-]{{6,}}"),
        ("phone", _PHONE),
        ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
        ("name", rf"(ชื่อผู้ให้ข้อมูล){_GAP}*[^\n]{{0,60}}"),
        ("name", r"(ลงชื่อ)[^\n]{0,80}?ผู้เสนอ"),
        ("name", rf"คุณ{_GAP}*[A-Za-z][A-Za-z0-9_.\-]{{2,}}(?:{_GAP}+[A-Za-z][A-Za-z0-9_.\-]+){{0,2}}"),
        ("name", rf"\({_GAP}*{_HON}[^)\n]{{0,50}}\)"),
        ("name", rf"{_ANCHORED}{_GAP}*[ก-๙]{{2,}}(?:{_GAP}+[ก-๙]{{2,}})?"),
        ("address", rf"(เลขที่){_GAP}*[:：]?{_GAP}*{_D}[0-9๐-๙/\-]*"),
        ("address", rf"(หมู่(?:ที่)?){_GAP}*[:：]?{_GAP}*{_D}{{1,3}}"),
        ("address", rf"(ถนน){_GAP}*[:：]?{_GAP}*[^\s\n]{{1,40}}"),
        ("address", rf"(รหัสไปรษณีย์){_GAP}*[:：]?{_GAP}*{_D}{{5}}"),
        ("coordinates", r"\b\d{1,2}\.\d{4,}\s*,\s*\d{2,3}\.\d{4,}\b"),
        ("media_link", r"https?://\S+"),
        ("address", rf"(ตำบล){_GAP}*/?{_GAP}*(?:แขวง)?{_GAP}*[:：]?{_GAP}*[^\s\n]{{1,30}}"),
    )
)
LEAKS = {
    c: re.compile(p)
    for c, p in (
        ("phone", _PHONE),
        ("email", r"[^\s@<>()\[\],;:\"]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
        ("honorific_name", rf"{_ANCHORED}{_GAP}*[ก-๎]{{2,}}"),
        ("house_number", rf"เลขที่{_GAP}*{_D}"),
        ("postcode", rf"รหัสไปรษณีย์{_GAP}*{_D}{{5}}"),
        ("road", rf"ถนน{_GAP}*[ก-๎A-Za-z]{{2,}}"),
    )
}
CLASSES = ("name", "address", "phone", "email", "coordinates", "media_link")
REPORT = StructType([StructField("text", StringType()), *[StructField(f"n_{c}", IntegerType()) for c in CLASSES], StructField("total", IntegerType()), StructField("suspected_parser_failure", BooleanType())])


def redact_text(text: str) -> tuple[str, dict[str, int]]:
    counts = dict.fromkeys(CLASSES, 0)

    def one(kind: str):
        def put(m: re.Match) -> str:
            if kind == "name" and m.group().startswith(TITLES + FOODS):
                return m.group()
            counts[kind] += 1
            label = m.group(1) if m.re.groups else None
            return f"{label} {REDACTED}" if label else REDACTED

        return put

    for kind, pattern in PATTERNS:
        text = pattern.sub(one(kind), text)
    return text, counts


@F.pandas_udf(REPORT)
def redact(text: pd.Series) -> pd.DataFrame:
    """struct(text, n_..., total, suspected_parser_failure); null is null with counts 0."""
    rows = []
    for x in text:
        if x is None or x != x:
            rows.append((None, *[0] * len(CLASSES), 0, True))
        else:
            clean, n = redact_text(x)
            total = sum(n.values())
            rows.append((clean, *n.values(), total, total == 0))
    return pd.DataFrame(rows, columns=["text", *[f"n_{c}" for c in CLASSES], "total", "suspected_parser_failure"])


def leak_classes(text: str) -> list[str]:
    out = []
    for c, p in LEAKS.items():
        if any(not (c == "honorific_name" and m.group().startswith(TITLES + FOODS)) for m in p.finditer(text)):
            out.append(c)
    return sorted(out)


@F.pandas_udf(ArrayType(StringType()))
def find_leaks(text: pd.Series) -> pd.Series:
    return text.map(lambda x: leak_classes(x) if x else [])


def all_classes(text: str) -> list[str]:
    return sorted({c for c, n in redact_text(text)[1].items() if n} | set(leak_classes(text)))


@F.pandas_udf(ArrayType(StringType()))
def personal_data_classes(text: pd.Series) -> pd.Series:
    """Classes that redaction would strip or the scan finds; empty is clean."""
    return text.map(lambda x: all_classes(x) if x else [])


@F.pandas_udf(ArrayType(StringType()))
def classes_left(text: pd.Series) -> pd.Series:
    """personal_data_classes() of the redacted text, which does not leave Python for it."""
    return text.map(lambda x: all_classes(redact_text(x)[0]) if x else [])


@F.pandas_udf(StringType())
def scrub(text: pd.Series) -> pd.Series:
    """Only what the scan finds is replaced; for URLs, which redaction would take whole."""

    def one(x: str) -> str:
        for p in LEAKS.values():
            x = p.sub(REDACTED, x)
        return x

    return text.map(one, na_action="ignore")


def string_columns(df: DataFrame) -> list[str]:
    """SQL expressions, each an array of strings, over every string in the schema, however deep: in structs, arrays, and maps' keys and values."""

    def within(kind, expr: str, depth: int) -> list[str]:
        if isinstance(kind, StringType):
            return [f"array({expr})"]
        if isinstance(kind, StructType):
            return [x for f in kind.fields for x in within(f.dataType, f"{expr}.`{f.name}`", depth)]
        if isinstance(kind, ArrayType):
            return [f"flatten(transform({expr}, x{depth} -> coalesce({x}, cast(array() as array<string>))))" for x in within(kind.elementType, f"x{depth}", depth + 1)]
        if isinstance(kind, MapType):
            parts = ((ArrayType(kind.keyType), f"map_keys({expr})"), (ArrayType(kind.valueType), f"map_values({expr})"))
            return [x for k, e in parts for x in within(k, e, depth)]
        return []

    return [f"coalesce({x}, cast(array() as array<string>))" for f in df.schema.fields for x in within(f.dataType, f"`{f.name}`", 0)]


def scan(df: DataFrame, table: str) -> DataFrame:
    """(table, class, n_rows): how many rows hold each class, in any string column. Hex digests are exempt."""
    texts = string_columns(df)
    empty = df.sparkSession.createDataFrame([], "table string, class string, n_rows bigint")
    if not texts:
        return empty
    joined = F.array_join(F.filter(F.flatten(F.array(*[F.expr(t) for t in texts])), lambda x: ~F.coalesce(x.rlike("^[0-9a-f]{40,64}$"), F.lit(True))), "\n")
    classes = df.select(F.array_distinct(find_leaks(joined)).alias("classes")).select(F.explode("classes").alias("class"))
    return classes.groupBy("class").agg(F.count("*").alias("n_rows")).select(F.lit(table).alias("table"), "class", "n_rows")
