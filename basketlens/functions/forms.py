"""Forms read from positioned runs: the bounds of their table, rows, a second way of reading names, and the whole record.

y grows downwards. What belongs to a table is decided by its own row numbers, since what follows it
can look alike. These rules depend on order within one document, so they are plain functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from basketlens.functions import layout, privacy
from basketlens.functions.layout import CLUSTER, Run

# Headings, ends and options of the form's table, and words of its benefits column.
HEADINGS = ("ชื่อวัตถุดิบ", "ชื่อวัตถดิบ", "วัตถุดิบ/")
ENDS = ("ด้านการเผยแพร่", "ด้านโภชนาการ", "ภาพถ่าย หรือคลิป")
OPTIONS = ("ไม่มีส่วนผสม", "มีส่วนผสมของวัตถุดิบ", "เป็นอาหารที่ช่วยส่งเสริม", "อื่นๆ (ระบุ)")
BENEFITS = re.compile("ช่วย|ป้องกัน|บำรุง|วิตามิน|สาร|โรค|ร่างกาย|เลือด|ลดความ|ลดอาการ|อุดม|ประโยชน์|สรรพคุณ|ต้าน|ระบบ")
NAME, PLACE = re.compile(r"ชื่อเมนูอาหาร[ \t.…·:]*([^\n]+?)(?=จังหวัด|\n|$)"), re.compile(r"จังหวัด[ \t.…·:]*([^\s.…·]+)")
BOXES = ("☐", "☑", "☒", "□", "■", "✓", "✔")

MOST_SKIPPED, MOST_DROP, PAGE_TOP, COLUMNS = 3, 150.0, 200.0, 4
LONGEST_NAME, BENEFIT_SHARE, MOST_LINES = 40, 0.3, 60
_LETTER, _NUMBERED = re.compile("[ก-ฮ]"), re.compile(r"^\s*[0-9๐-๙]{1,2}\s*[.)]?\s*")


def shown(line: list[Run]) -> str:
    return "".join(r.text for r in line)


def after_heading(lines: list[list[Run]]) -> tuple[list[list[Run]], list[Run] | None]:
    """Lines below the table's heading, up to what always ends it; and the heading."""
    at = next((i for i, line in enumerate(lines) if any(h in shown(line) for h in HEADINGS)), None)
    if at is None:
        return [], None
    end = next((i for i in range(at + 1, len(lines)) if any(e in shown(lines[i]) for e in ENDS)), len(lines))
    return lines[at + 1 : end], lines[at]


def is_option(line: list[Run]) -> bool:
    """A tick box with its label, or a label that only such lines have."""
    return line[0].text in BOXES or any(o in shown(line) for o in OPTIONS)


def index_column(lines: list[list[Run]], otherwise: float) -> float:
    """Where numbers stand above each other at the left, if any do."""
    starts = [[line[0]] for line in lines if layout.number_of(line[0].text) is not None]
    best = layout.anchors(starts, expected=1)
    return best[0] if best and sum(abs(s[0].x - best[0]) <= CLUSTER for s in starts) > 1 else otherwise


def follows(above: list[Run], line: list[Run]) -> bool:
    """Near enough to a row to belong to its table: little below it, or near the top of the next page."""
    if above[0].page == line[0].page:
        return line[0].y - above[0].y <= MOST_DROP
    return line[0].page == above[0].page + 1 and line[0].y <= PAGE_TOP


def bounded(lines: list[list[Run]]) -> list[list[Run]]:
    """The table's rows and their continuations: numbers rise from 1, few skipped; other lines are passed over."""
    body, heading = after_heading(lines)
    if heading is None:
        return []
    left, rows, last, number = index_column(body, heading[0].x), [], None, 0
    for line in body:
        if last is not None and is_option(line):
            break
        own = layout.number_of(line[0].text) if abs(line[0].x - left) <= CLUSTER else None
        if own is not None and number < own <= number + 1 + MOST_SKIPPED:
            if last is not None and not follows(last, line):
                break
            rows.append(line)
            last, number = line, own
        elif last is not None and line[0].x > left + CLUSTER and follows(last, line):
            rows.append(line)
    return rows


def table_names(lines: list[list[Run]]) -> list[tuple[str, str]]:
    """(name, origin) of the table's rows: columns by rows that open with a number, and wrapped cells joined."""
    rows = bounded(lines)
    opening = [r for r in rows if layout.number_of(r[0].text) is not None]
    columns = layout.anchors(opening, expected=COLUMNS)
    if len(columns) < 2:
        return []
    cells = layout.table(rows, columns, numbered=True)
    return [(c[1], c[-1] if len(columns) == COLUMNS else "") for c in cells if c[1]]


def listed_names(lines: list[list[Run]]) -> list[tuple[str, str]]:
    """Names from the column of names alone, for tables without usable numbers: short cells with letters, unless too many speak of benefits."""
    body, heading = after_heading(lines)
    if heading is None:
        return []
    stop = next((i for i, line in enumerate(body) if i and is_option(line)), len(body))
    body = body[: min(stop, MOST_LINES)]
    first = [next((r for r in line if _LETTER.search(_NUMBERED.sub("", r.text))), None) for line in body]
    columns = layout.anchors([[r] for r in first if r is not None])
    if not columns:
        return []
    named = next((r.x for r in heading if any(h in r.text for h in HEADINGS)), heading[0].x)
    x = min(columns, key=lambda c: abs(c - named))
    cells = (" ".join(r.text.strip() for r in line if abs(r.x - x) <= CLUSTER) for line in body)
    names = [n for n in (" ".join(_NUMBERED.sub("", c).split()).strip(" .") for c in cells) if _LETTER.search(n) and len(n) <= LONGEST_NAME and not any(h in n for h in HEADINGS)]
    spoken = sum(bool(BENEFITS.search(n)) for n in names)
    return [] if names and spoken / len(names) >= BENEFIT_SHARE else [(n, "") for n in names]


def record(runs: Iterable[Run], options: dict[str, list[tuple[str, str]]]) -> dict:
    """A form's fields: redacted first, then read. options: field -> (label, value) of its tick boxes, in order."""
    runs = list(runs)
    lines = layout.lines(runs)
    text, counts = privacy.redact_text("\n".join(" ".join(r.text for r in line) for line in lines))
    ticked = layout.boxes(runs)
    notes = [] if sum(counts.values()) else ["nothing redacted"]
    if not any(r.text in BOXES for r in runs):
        notes.append("no boxes")
    found = table_names(lines)
    if not found:
        found = listed_names(lines)
        notes.append("names by column" if found else "no names")
    scrub = lambda s: next((privacy.REDACTED for p in privacy.LEAKS.values() if p.search(s)), s)
    name, place = NAME.search(text), PLACE.search(text)
    out = {"dish": name.group(1).strip(" .…_-") if name else None, "province": place.group(1) if place else None, "names": [scrub(n) for n, _ in found], "origins": [scrub(o) for _, o in found], "notes": notes}
    for field, table in options.items():
        out[field] = next((v for v in (layout.first_match(t, table) for t in ticked) if v is not None), None)
    return out


def records(runs: DataFrame, options: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """One row for each document of runs (doc, text, x, y, page), as record()."""
    columns = ["dish", "province", "names", "origins", "notes", *options]

    def one(doc: int, rs: list[Run]) -> list[tuple]:
        r = record(rs, options)
        return [(doc, *(r[c] for c in columns))]

    kinds = "doc bigint, dish string, province string, names array<string>, origins array<string>, notes array<string>" + "".join(f", `{o}` string" for o in options)
    return layout.read_documents(runs, one, kinds)
