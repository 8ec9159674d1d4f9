"""The controlled vocabulary: mapping strings to entries, its checks, coverage and worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketlens.functions import privacy
from basketlens.operators.ranking import ranked

JOINER = " ‖ "
CONFLICT, SPLIT, EXCLUDED = "conflict", "split", "excluded"


def first_wins(aliases: DataFrame) -> DataFrame:
    """(key, canonical_id), one each; where entries claim one key the least id has it."""
    return aliases.groupBy("key").agg(F.min("canonical_id").alias("canonical_id"))


def lookup(aliases: DataFrame, splits: DataFrame) -> DataFrame:
    """(key, canonical_id, is_split): an alias gives one entry; else a split gives several."""
    one = first_wins(aliases).withColumn("is_split", F.lit(False))
    many = splits.select("key", "canonical_id").distinct().join(one.select("key"), "key", "left_anti").withColumn("is_split", F.lit(True))
    return one.unionByName(many)


def canonicalise(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(recipe_id, canonical_id, raw): lines (recipe_id, pos, key, raw) mapped, one row per entry of a recipe.

    Raw strings of one entry are joined in order, each once. A line without entry gives no row.
    """
    hits = lines.join(entries.select("key", "canonical_id"), "key").select("recipe_id", "canonical_id", "pos", "raw").distinct()
    found = hits.groupBy("recipe_id", "canonical_id").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("found"))
    return found.select("recipe_id", "canonical_id", F.array_join(F.array_distinct(F.transform("found", lambda x: x["raw"])), JOINER).alias("raw"))


def index(mapped: DataFrame) -> DataFrame:
    """(key, entry): the entry, or a marker where entries conflict. mapped: (key, entry), markers included."""
    return mapped.groupBy("key").agg(F.when(F.count_distinct("entry") > 1, CONFLICT).otherwise(F.min("entry")).alias("entry"))


def scopes(registers: tuple[str, ...], register: str = "register", source: str = "source_id") -> Column:
    """All scopes that a row counts for: all, the studied registers together, its register and its source."""
    r = F.col(register)
    return F.array_compact(F.array(F.lit("all"), F.when(r.isin(*registers), "studied"), F.concat(F.lit("register:"), r), F.concat(F.lit("source:"), F.col(source))))


def dealt(df: DataFrame, key: str, least: int | None = None) -> DataFrame:
    """df dealt by a key to so many tasks that none has more of it the larger its inputs are: one for each PIECE bytes of these, and ``least`` (the session's shuffle partitions).

    Distinct rows with that key are then found where they are. Left to Spark, small shuffles go to a few tasks, and these hold them whole.
    Inputs of unknown size count for nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # Spark takes what it does not know for 2**63
    return df.repartition(max(least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // PIECE, 100_000)) + 1, key)  # one more than a join has, or it would be taken for the join's own


#: Bytes of input files for each task of dealt().
PIECE = 4 << 20


def coverage(mentions: DataFrame, entries: DataFrame, registers: tuple[str, ...]) -> DataFrame:
    """Per scope: distinct (recipe, key) mentions, mapped ones, conflicts and exclusions.

    mentions: (source_id, register, recipe_id, key). Excluded strings are not in the denominator;
    conflicting ones are not mapped.
    """
    pairs = dealt(mentions.select("source_id", "register", "recipe_id", "key"), "recipe_id").distinct().join(entries, "key", "left")
    rows = pairs.withColumn("scope", F.explode(scopes(registers)))
    e = F.col("entry")
    out = rows.groupBy("scope").agg(
        F.count_if(~F.coalesce(e == EXCLUDED, F.lit(False))).alias("mentions"), F.count_if(e.isNotNull() & ~e.isin(CONFLICT, EXCLUDED)).alias("mapped"),
        F.count_if(e == CONFLICT).alias("conflicting"), F.count_if(e == EXCLUDED).alias("excluded"), F.count_distinct("key").alias("strings"),
    )
    return out.withColumn("mapped_share", F.coalesce(F.try_divide("mapped", "mentions"), F.lit(0.0)))


def worklist(mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """Strings by the number of recipes that have them: rank, running share, registers in columns, entry."""
    pairs = dealt(mentions.select("register", "recipe_id", "key"), "recipe_id").distinct()
    total = pairs.select("recipe_id", "key").distinct().groupBy("key").agg(F.count("*").alias("n"))
    wide = pairs.groupBy("key").pivot("register", ["official", "commercial", "domestic"]).agg(F.count("recipe_id")).fillna(0)
    return ranked(total, "key").join(wide, "key").join(entries, "key", "left")


def modes(lines: DataFrame, coding: DataFrame, enum: tuple[str, ...]) -> DataFrame:
    """(recipe_id, canonical_id, modes): union of the codes of an entry's lines, in the list's order."""
    rows = lines.join(coding, "code").groupBy("recipe_id", "canonical_id").agg(F.array_distinct(F.flatten(F.collect_list("modes"))).alias("m"))
    fixed = F.array(*[F.lit(x) for x in enum])
    return rows.select("recipe_id", "canonical_id", F.filter(fixed, lambda x: F.array_contains("m", x)).alias("modes"))


def conflations(aliases: DataFrame, names: DataFrame, pairs: DataFrame) -> DataFrame:
    """Aliases that are the name of one of a pair kept apart, yet map to the other; must be empty.

    Two equi-joins and a union, where an OR would make Spark compare all with all.
    """
    owned = aliases.join(names.select("key", F.col("canonical_id").alias("is_name_of")), "key")
    a = owned.join(pairs, (owned["canonical_id"] == pairs["a"]) & (owned["is_name_of"] == pairs["b"]))
    b = owned.join(pairs, (owned["canonical_id"] == pairs["b"]) & (owned["is_name_of"] == pairs["a"]))
    columns = ["key", F.col("canonical_id").alias("maps_to"), "is_name_of"]
    return a.select(*columns).unionByName(b.select(*columns)).distinct()


def overlaps(aliases: DataFrame, splits: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(key, of, and_of): keys in two of the three lists; must be empty."""
    named = [("alias", aliases), ("split", splits), ("exclusion", exclusions)]
    out = None
    for i, (a, x) in enumerate(named):
        for b, y in named[i + 1 :]:
            both = x.select("key").distinct().join(y.select("key"), "key", "left_semi").select("key", F.lit(a).alias("of"), F.lit(b).alias("and_of"))
            out = both if out is None else out.unionByName(both)
    return out


def decided(sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions per string of a coding sheet (group_key, key, group_decision, decision): a blank takes its group's first; and conflicts."""
    w = Window.partitionBy("group_key").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = sheet.withColumn("d", F.coalesce(blank("decision"), F.first(blank("group_decision"), ignorenulls=True).over(w))).where("d is not null and d <> 'skip'")
    n = rows.groupBy("key").agg(F.count_distinct("d").alias("n"), F.min("d").alias("d"))
    return n.where("n = 1").select("key", F.col("d").alias("decision")), n.where("n > 1").select("key")


def grouped(strings: DataFrame, group: str) -> DataFrame:
    """Groups of strings (key, n, and a group column): members, mentions, rank and running share."""
    g = strings.groupBy(group).agg(F.sum("n").alias("n"), F.count("*").alias("strings"))
    return ranked(g, group)


# The categories of entries, in the order of the decision that set them.
CATEGORIES = (
    "aromatic", "chilli", "herb", "spice", "vegetable", "fruit", "protein_meat",
    "protein_fish", "protein_other", "coconut", "acid", "fat", "starch", "sweetener",
    "seasoning", "other",
)
OTHER_CEILING = 0.05


def problems(entries: DataFrame, aliases: DataFrame, splits: DataFrame, exclusions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(list, rule, n) of everything wrong with a vocabulary, all lists in one report; empty if nothing is.

    entries: canonical_id, name, category; aliases, splits: key, canonical_id; exclusions: key; pairs: a, b.
    """
    known = entries.select("canonical_id")
    one = lambda where, rule, df: df.agg(F.count("*").alias("n")).select(F.lit(where).alias("list"), F.lit(rule).alias("rule"), "n")
    twice = lambda df, *keys: df.groupBy(*keys).count().where("count > 1")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    other = entries.agg((F.count_if(F.col("category") == "other") / F.greatest(F.count("*"), F.lit(1))).alias("s")).where(F.col("s") > OTHER_CEILING)
    unordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    few = splits.groupBy("key").agg(F.count_distinct("canonical_id").alias("n")).where("n < 2")
    named = entries.where(~blank("name")).select(F.col("name").alias("key"), F.col("canonical_id").alias("of"))
    more = []
    for column, rule, wrong in (
        ("drafted_by", "drafter given", lambda c: blank(c)),
        ("reviewed_at", "review dated", lambda c: ~blank(c) & F.try_to_date(c, "yyyy-MM-dd").isNull()),
        ("is_fermented", "flag true or false", lambda c: ~F.coalesce(c.isin("true", "false"), F.lit(False))),
        ("regional_note", "no personal data in notes", lambda c: F.size(privacy.personal_data_classes(F.coalesce(c, F.lit("")))) > 0),
    ):
        if column in entries.columns:
            more.append(one("entries", rule, entries.where(wrong(F.col(column).cast("string")))))
    for where, df in (("pairs", pairs), ("exclusions", exclusions)):
        if "reason" in df.columns:
            more.append(one(where, "reason given", df.where(blank("reason"))))
            more.append(one(where, "no personal data in reasons", df.where(F.size(privacy.personal_data_classes(F.coalesce("reason", F.lit("")))) > 0)))
    found = [
        *more,
        one("aliases", "no other entry's name", aliases.join(named, "key").where(F.col("canonical_id") != F.col("of"))),
        one("splits", "no entry's name", splits.select("key").distinct().join(named, "key", "left_semi")),
        one("splits", "entry once", twice(splits, "key", "canonical_id")),
        one("splits", "key given", splits.where(blank("key"))),
        one("exclusions", "key once", twice(exclusions.select("key"), "key")),
        one("exclusions", "key given", exclusions.where(blank("key"))),
        one("pairs", "entries exist", pairs.select(F.explode(F.array("a", "b")).alias("canonical_id")).join(known, "canonical_id", "left_anti")),
        one("entries", "id is ING_ and four digits", entries.where(~F.col("canonical_id").rlike("^ING_[0-9]{4}$"))),
        one("entries", "id once", twice(entries, "canonical_id")),
        one("entries", "name once", twice(entries.where(~blank("name")), "name")),
        one("entries", "name given", entries.where(blank("name"))),
        one("entries", "category in list", entries.where(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)))),
        one("entries", "others within their ceiling", other),
        one("aliases", "key given", aliases.where(blank("key"))),
        one("aliases", "entry exists", aliases.join(known, "canonical_id", "left_anti")),
        one("aliases", "one entry for a key", index(aliases.select("key", F.col("canonical_id").alias("entry"))).where(F.col("entry") == CONFLICT)),
        one("splits", "entry exists", splits.join(known, "canonical_id", "left_anti")),
        one("splits", "two entries at least", few),
        one("pairs", "two different entries", pairs.where("a = b")),
        one("pairs", "pair once", twice(unordered, "a", "b")),
        one("lists", "keys in one list only", overlaps(aliases, splits, exclusions)),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.where("n > 0")


def mapping_counts(lines: DataFrame, entries: DataFrame, registers: tuple[str, ...]) -> DataFrame:
    """(register, mentions, mapped, split, entries) of lines (register, recipe_id, key); entries: (key, canonical_id, is_split).

    A register that is not known is refused, but only if it has mapped lines.
    """
    hits = entries.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("is_split").alias("is_split"))
    found = lines.join(hits, "key", "left").groupBy("register").agg(
        F.count("*").alias("mentions"), F.count("n").alias("mapped"), F.count_if("is_split").alias("split"), F.coalesce(F.sum("n"), F.lit(0)).alias("entries")
    )
    strange = [r[0] for r in found.where((F.col("mapped") > 0) & ~F.col("register").isin(*registers)).select("register").collect()]  # registers are few
    if strange:
        raise ValueError(f"unknown register: {', '.join(map(str, strange))}")
    return found


def trusted_coverage(mentions: DataFrame, entries: DataFrame, trusted: DataFrame, registers: tuple[str, ...]) -> DataFrame:
    """coverage() with mapped_trusted and its share: mentions mapped to an entry that is trusted (canonical_id)."""
    known = trusted.select(F.col("canonical_id").alias("entry"), F.lit(True).alias("is_trusted"))
    pairs = dealt(mentions.select("source_id", "register", "recipe_id", "key"), "recipe_id").distinct().join(entries, "key").join(known, "entry")
    n = pairs.withColumn("scope", F.explode(scopes(registers))).groupBy("scope").agg(F.count("*").alias("mapped_trusted"))
    out = coverage(mentions, entries, registers).join(n, "scope", "left").fillna(0, ["mapped_trusted"])
    return out.withColumn("trusted_share", F.coalesce(F.try_divide("mapped_trusted", "mentions"), F.lit(0.0)))


def worklist_by(mentions: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(key, n, a column for each value, its rank among the strings of that value): recipes that have the string, in all and by source or register."""
    pairs = dealt(mentions.select(column, "recipe_id", "key"), "recipe_id").distinct()
    per = ranked(pairs.groupBy(column, "key").agg(F.count("*").alias("n")), "key", group=[column])
    wide = per.groupBy("key").pivot(column, values).agg(F.first("n").alias("n"), F.first("rank").alias("rank"))
    total = pairs.select("recipe_id", "key").distinct().groupBy("key").agg(F.count("*").alias("n"))
    return total.join(wide.fillna(0, [f"{v}_n" for v in values]), "key")


def suggestions(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """groups (group, ...) with the entry whose key the group's name is, if that is exactly one; nothing is guessed."""
    one = entries.where(~F.col("entry").isin(CONFLICT, EXCLUDED)).select(F.col("key").alias("group"), F.col("entry").alias("suggested"))
    return groups.join(one, "group", "left")


def planned(decisions: DataFrame, entries: DataFrame, known: DataFrame) -> DataFrame:
    """(key, action, ids, problem) of decisions (key, decision): alias, split, exclude, already, or refused with what is wrong.

    A decision is ids joined by bars, or exclude. entries: (key, entry), all those of a key; known:
    (canonical_id). What the vocabulary says otherwise is never changed.
    """
    ids = F.filter(F.split(F.trim("decision"), r"\s*\|\s*"), lambda x: x != "")
    current = entries.groupBy("key").agg(F.array_sort(F.collect_set("entry")).alias("current"))
    rows = decisions.withColumn("excludes", F.lower(F.trim("decision")) == "exclude").withColumn("ids", F.when(~F.col("excludes"), ids).otherwise(F.array()))
    missing = rows.select("key", F.explode("ids").alias("canonical_id")).join(known, "canonical_id", "left_anti").select("key").distinct().withColumn("missing", F.lit(True))
    x = rows.join(current, "key", "left").join(missing, "key", "left")
    wanted = F.when(F.col("excludes"), F.array(F.lit(EXCLUDED))).otherwise(F.array_sort("ids"))
    problem = (
        F.when(~F.col("excludes") & ((F.size("ids") == 0) | F.exists("ids", lambda i: ~i.rlike("^ING_[0-9]{4}$"))), "not an entry's id")
        .when(F.coalesce("missing", F.lit(False)), "no such entry")
        .when(F.size(F.array_distinct("ids")) < F.size("ids"), "an id is repeated")
        .when(F.col("current").isNotNull() & (F.col("current") != wanted), "the vocabulary says otherwise")
    )
    action = F.when(problem.isNotNull(), "refused").when(F.col("current").isNotNull(), "already").when(F.col("excludes"), "exclude").when(F.size("ids") > 1, "split").otherwise("alias")
    return x.select("key", action.alias("action"), F.array_join("ids", "|").alias("ids"), problem.alias("problem"))


def category_coverage(work: DataFrame, entries: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, n, share) of (recipe, string) pairs: work (key, n) by the category of its entry; conflicts, exclusions and unmapped strings count in the total only."""
    total = work.agg(F.sum("n").alias("total"))
    rows = work.join(entries.where(~F.col("entry").isin(CONFLICT, EXCLUDED)), "key").join(categories.select(F.col("canonical_id").alias("entry"), "category"), "entry")
    return rows.groupBy("category").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).select("category", "n", F.try_divide("n", "total").alias("share"))  # one row


def category_check(entries: DataFrame) -> DataFrame:
    """(category, n, known, over) in the list's order, zeros kept, strange ones last: over is true of other above its ceiling."""
    n = entries.groupBy("category").agg(F.count("*").alias("n"))
    total = entries.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    fixed = entries.sparkSession.createDataFrame(list(enumerate(CATEGORIES)), "place int, category string")
    both = fixed.join(n, "category", "full").crossJoin(F.broadcast(total))
    over = (F.col("category") == "other") & (F.coalesce("n", F.lit(0)) / F.col("total") > OTHER_CEILING)
    return both.select("category", F.coalesce("n", F.lit(0)).alias("n"), F.col("place").isNotNull().alias("known"), over.alias("over"))


def parsed_modes(coding: DataFrame, enum: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(string, codes) of a coding (string, modes): none gives an empty list, blank is not coded; and the strings with a mode that is not in the list."""
    m = F.trim("modes")
    codes = F.when(F.lower(m) == "none", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(F.transform(F.split(m, r"\|"), F.trim), lambda x: x != "")))
    rows = coding.where(m != "").select("string", codes.alias("codes"), (F.lower(m) == "none").alias("none"))
    bad = (F.size(F.array_except("codes", F.array(*[F.lit(x) for x in enum]))) > 0) | ((F.size("codes") == 0) & ~F.col("none"))
    return rows.where(~bad).select("string", "codes"), rows.where(bad).select("string")


def coding_coverage(lines: DataFrame, coding: DataFrame) -> DataFrame:
    """(n_rows, n_coded, n_strings, n_strings_coded) of lines (string), by strings that a coding (string, codes) has."""
    n = lines.where("string <> ''").groupBy("string").agg(F.count("*").alias("n")).join(coding.select("string", F.lit(True).alias("coded")), "string", "left")
    return n.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("coded"), F.col("n"))), F.lit(0)).alias("n_coded"), F.count("*").alias("n_strings"), F.count("coded").alias("n_strings_coded"))
