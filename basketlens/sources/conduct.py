"""How a crawl behaves: stages and their gate, pacing, back-off, and the breaker. No network here."""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from urllib.robotparser import RobotFileParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.operators.ranking import latest

STAGES = ("audit", "pilot", "full")


@dataclass
class Pace:
    """Waiting times between requests, reproducible by seed; stops after ``most`` errors in a row."""

    seed: int = 0
    least: float = 3.0
    spread: float = 2.0
    most: int = 5
    errors: int = 0
    rng: random.Random = field(init=False)

    def __post_init__(self):
        self.rng = random.Random(self.seed)

    def wait(self, retry_after: str | None = None) -> float:
        if retry_after and retry_after.isdigit():
            return float(retry_after)
        return (self.least + self.rng.random() * self.spread) * 2**self.errors

    def error(self) -> None:
        self.errors += 1
        if self.errors >= self.most:
            raise RuntimeError(f"{self.errors} errors in a row: stopped")

    def success(self) -> None:
        self.errors = 0


def allowed(robots: str, agent: str, url: str) -> bool:
    p = RobotFileParser()
    p.parse(robots.splitlines())
    return p.can_fetch(agent, url)


def may_run(register: DataFrame, source: str, stage: str) -> bool:
    """Auditing always may; the other stages need ``go`` in the source's latest row (source_id, line, decision)."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}")
    row = latest(register.where(F.col("source_id") == source), ["source_id"], ["line"]).first()
    return stage == "audit" or bool(row and row["decision"].strip().lower() == "go")


def current(manifest: DataFrame) -> DataFrame:
    """The latest row of each address of an append-only manifest (url, fetched_at, ...)."""
    return latest(manifest, ["url"], ["fetched_at"])


def addresses(regions: dict[str, int], menus: int, pattern: str, spark) -> DataFrame:
    """(region, province, menu, url) of an enumerated space: pattern has {region}, {province} and {menu}."""
    df = spark.createDataFrame(list(regions.items()), "region string, provinces int")
    df = df.select("region", F.explode(F.sequence(F.lit(1), "provinces")).alias("province")).withColumn("menu", F.explode(F.sequence(F.lit(1), F.lit(menus))))
    url = F.lit(pattern)
    for c in ("region", "province", "menu"):
        url = F.replace(url, F.lit("{" + c + "}"), F.col(c).cast("string"))
    return df.withColumn("url", url)


HEADING = "## Register of sources"


def appended(document: str, cells: list[str], columns: list[str], heading: str = HEADING) -> str:
    """A Markdown document with one more row in the register's section, which is made if it is not there; bars within cells are escaped."""
    row = "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    before, found, after = document.partition(heading)
    if not found:
        table = [heading, "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), row]
        return document.rstrip("\n") + "\n\n" + "\n".join(table) + "\n"
    section, mark, rest = after.partition("\n## ")
    return before + heading + section.rstrip("\n") + "\n" + row + "\n" + (f"{mark}{rest}" if mark else "")


@dataclass(frozen=True)
class Site:
    """A source that is described, and may be audited only until its register row says go."""

    source_id: str
    base_url: str
    language: str = "th"
    stage: str = "audit"

    def discover(self) -> None:
        raise NotImplementedError(f"{self.source_id}: only audited so far")
