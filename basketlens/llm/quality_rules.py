"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are runs of anything but space and the ASCII controls tab to carriage return. All measures
come from the whole text, however long: a row holds its words and windows as arrays. A null text has
no words. Rows that repeat get the same verdict each. An empty table gives no rows. Columns may have any
names; those of the verdict are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.runtime import fresh, renamed

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "au aux ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "als auch auf das dem den der die ein eine er es ist mit nicht sich sie und von war zu im "
    "al como con del el ella las lo los no para pero por se sin su y una"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure by name and the closed range in which it passes; None leaves a side open.

    given: another measure and the value above which the rule holds; elsewhere it passes.
    """

    measure: str
    least: float | None = None
    most: float | None = None
    given: tuple[str, float] | None = None


#: The production table. Ratios are to the number of words, but for lines. Few stop words alone are no
#: fault, since the text may be of a language whose words are not listed; with many symbols they are.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("bang_ratio", None, 0.3),
    Rule("stop_word_ratio", 0.04, None, ("symbol_ratio", 0.03)),
    Rule("dup_line_ratio", None, 0.4),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column ``rules_measures``; its fields are the counts and ratios.

    n_repeat_words finds equal 3-word windows by sorting (hash, position) pairs within the text:
    n log n for one text, in its own row, so no text meets another.
    """
    raw, words, grams, lines = (fresh(x) for x in ("text", "words", "grams", "lines"))
    own = docs.columns
    w = F.col(words)
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    window = lambda i: F.struct(
        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")
    )
    none = F.expr("cast(array() as array<struct<h:bigint,p:int>>)")
    df = docs.withColumn(raw, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(words, F.filter(F.split(raw, GAP), lambda x: x != "")).withColumn(
        lines, F.filter(F.split(raw, "\n"), has_word)
    )
    df = df.withColumn(
        grams,
        F.when(F.size(w) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), window))).otherwise(none),
    )

    def same(a: Column, b: Column) -> Column:
        equal = a["h"] == b["h"]
        for k in range(3):
            equal = equal & (F.get(w, a["p"] + k) == F.get(w, b["p"] + k))
        return F.coalesce(equal, F.lit(False))

    g = F.col(grams)
    twice = F.filter(g, lambda s, j: same(s, F.get(g, j - 1)) | same(s, F.get(g, j + 1)))
    at = F.sort_array(F.transform(twice, lambda s: s["p"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    count = lambda pattern: (F.length(raw) - F.length(F.regexp_replace(raw, pattern, ""))).cast("long")
    counts = fresh("counts")
    # through explode() of the one struct, since Spark would push a filter on the measures below the
    # projections and write out in it, nested, what they compute once
    one = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        count("!").alias("n_bangs"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    df = df.select("*", F.explode(F.array(one)).alias(counts))
    c = F.col(counts)
    per = lambda a, b: F.coalesce(F.try_divide(c[a].cast("double"), c[b].cast("double")), F.lit(0.0))
    ratios = [
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("n_symbols", "n_words").alias("symbol_ratio"),
        per("n_bangs", "n_words").alias("bang_ratio"),
        per("n_stop_words", "n_words").alias("stop_word_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    ]
    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_bangs n_stop_words n_lines".split()
    return df.select(*[F.col(f"`{x}`") for x in own if x != "rules_measures"], F.struct(*[c[x].alias(x) for x in fields], *ratios).alias("rules_measures"))


def compiled(rules=RULES, of: str = "rules_measures") -> Column:
    """True where every rule of the table passes."""
    passes = F.lit(True)
    for r in rules:
        within = F.lit(True)
        if r.least is not None:
            within = within & (F.col(of)[r.measure] >= F.lit(r.least))
        if r.most is not None:
            within = within & (F.col(of)[r.measure] <= F.lit(r.most))
        passes = passes & (within if r.given is None else within | (F.col(of)[r.given[0]] <= F.lit(r.given[1])))
    return passes


def base_failed(of: str = "rules_measures") -> Column:
    m = F.col(of)
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with ``rules_measures``, ``base_failed`` and ``kept``; columns of these names are replaced."""
    df = measures(docs.drop("base_failed", "kept"), text)
    return df.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def keep(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that pass, with exactly their own columns."""
    plain, names, column = renamed(docs, text)
    passed = measures(plain, column).where(~base_failed() & compiled(rules))
    return passed.select(*[F.col(y).alias(x) for x, y in names.items()])
