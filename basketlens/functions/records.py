"""Rows of exports, pages and scrapers as records: cleaned, redacted, and with counts of what went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions import pages, privacy, text

MAX_TITLE, MAX_LINE = 200, 300


def cleaned(df: DataFrame, texts: list[str], whole: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """df with each text column NFC, redacted and with collapsed white space, and n_redactions summed over all of them.

    Columns of ``whole`` are listings (split as named): redacted before they are split, since parts of a number or name would pass.
    """
    out, counts = df, []
    for c in [*texts, *whole]:
        r = f"__{c}"
        out = out.withColumn(r, privacy.redact(text.nfc(F.trim(F.coalesce(F.col(c), F.lit(""))))))
        counts.append(F.col(f"{r}.total"))
        clean = F.col(f"{r}.text")
        parts = {"semicolons": lambda x: F.split(x, ";"), "bars": lambda x: F.split(x, r"\|")}
        value = text.collapse(clean) if c in texts else F.filter(F.transform(parts[whole[c]](clean) if whole[c] in parts else text.split_list(clean, whole[c]), text.collapse), lambda x: x != "")
        out = out.withColumn(c, value)
    total = counts[0]
    for n in counts[1:]:
        total = total + n
    return out.withColumn("n_redactions", total.cast("long")).drop(*[f"__{c}" for c in [*texts, *whole]])


def clean_url(df: DataFrame, column: str) -> DataFrame:
    """A url keeps its text but for what the leak scan finds in it."""
    return df.withColumn(column, privacy.scrub(text.nfc(F.trim(F.coalesce(F.col(column), F.lit(""))))))


def split_loading(records: DataFrame, ingredients: str, undecided: tuple[str, ...], kind: str, medium: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """records (source_id, ...) as recipes with tier 1 and the confidence of their list kind, as names only (no ingredients), and as (what, n).

    Records with ingredients of an undecided source are counted, not loaded.
    """
    has, open_ = F.size(ingredients) > 0, F.col("source_id").isin(*undecided)
    confidence = F.when(F.col(kind).isin(*medium), "medium").otherwise("high")
    recipes = records.where(has & ~open_).withColumn("tier", F.lit(1)).withColumn("confidence", confidence)
    names = records.where(~has).drop(ingredients)
    n = records.agg(F.count_if(has & ~open_).alias("recipes"), F.count_if(~has).alias("names"), F.count_if(has & open_).alias("undecided"))
    return recipes, names, n.unpivot([], ["recipes", "names", "undecided"], "what", "n")


def page_records(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, published, category, lines, note, n_redactions) of pages: from their metadata and article, redacted; a page that cannot be used says why in its note."""
    found = df.select(key, pages.metadata(html).alias("m"), pages.html_lines(F.col(html)).alias("lines"))
    rows = found.select(key, F.col("m.headline").alias("title"), text.iso_date(F.col("m.published")).alias("published"), "m.category", F.array_join("lines", "\n").alias("lines"), F.col("lines").isNull().alias("no_article"))
    note = F.when(F.col("no_article"), "no article").when(F.col("title") == "", "no title").when(F.col("published").isNull(), "no date")
    return cleaned(rows, ["title"], {"lines": "lines"}).select(key, "title", "published", "category", "lines", note.alias("note"), "n_redactions")


def rejected(records: DataFrame, key: str) -> DataFrame:
    """(key, reason) of scraped records (title, lines, claim_location, published) that break the rules."""
    long = F.filter(F.transform("lines", lambda x, i: F.when(F.length(x) > MAX_LINE, F.format_string("line %d is too long", i + 1))), lambda x: x.isNotNull())
    first = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "title is empty"), F.when(F.length("title") > MAX_TITLE, "title is too long"),
        F.when(F.col("claim_location").isNotNull() & ~F.col("claim_location").isin("title", "body", "tag", "category"), "claim has no place"),
    ))
    return records.select(key, F.explode(F.concat(first, long)).alias("reason"))


def payload(original: Column, clean: Column) -> Column:
    """struct(original, normalised) of a redacted string."""
    return F.struct(clean.alias("original"), text.collapse(text.repair_private_use(clean)["text"]).alias("normalised"))


def scrubbed_again(fields: Column) -> Column:
    """A second pass over parsed fields: each of an array of strings by the leak scan."""
    joined = privacy.scrub(F.array_join(fields, "\x1e"))
    return F.split(joined, "\x1e")


# Why a form's field is missing, in the order in which they are reported.
RECOVERED, UNTICKED, ABSENT, NO_GLYPHS, UNBOUND = "recovered", "none ticked", "absent", "no glyphs", "unbound"


def recovery(value: Column, has_glyphs: Column, box_bound: Column, in_text: Column) -> Column:
    """Why a ticked field is or is not there; only the last is a defect of the reader."""
    return F.when(value.isNotNull(), RECOVERED).when(~has_glyphs, NO_GLYPHS).when(box_bound, UNTICKED).when(in_text, UNBOUND).otherwise(ABSENT)


def field_recovery(records: DataFrame, fields: list[str], rows: str, bucket: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(field, value, n) of all values; (bucket, n, share); and (documents, mean_rows, without_rows, ceiling): most that could be recovered."""
    long = records.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("missing")).alias("value")) for f in fields])))
    values = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    total = F.broadcast(records.agg(F.count("*").alias("total")))
    buckets = records.groupBy(bucket).agg(F.count("*").alias("n")).crossJoin(total).select(F.col(bucket).alias("bucket"), "n", F.try_divide("n", "total").alias("share"))
    whole = records.agg(F.count("*").alias("documents"), F.avg(rows).alias("mean_rows"), F.count_if(F.col(rows) == 0).alias("without_rows"), F.count_if(~F.col(bucket).isin(UNTICKED, ABSENT, NO_GLYPHS)).alias("ceiling"))
    return values, buckets, whole
