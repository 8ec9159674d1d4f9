"""Queries on hand-written records, labels, the region study, releases, upserts, and vocabulary decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketlens.functions import forms, records, text
from basketlens.operators import attribution, geo, inference, profiles, quality, ranking, release, reports, study, validation, views, vocabulary
from basketlens.plans.mapping import VOCABULARY_SQL, _aliases, _entries, _keys, _mentions, _splits
from basketlens.plans.statistics import A, B, MEMBERS_SQL, _clean, _members, r6
from basketlens.plans.testbed import BASE_SQL, Testbed
from basketlens.plans.texts import _html
from basketlens.sources import tables

QUERIES, ORACLE_SQL = {}, {}
_WEIGHTS_SQL = profiles.distances_sql("members", profiles.TFIDF)


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _part(spark, sf_dir):
    return Testbed(spark, sf_dir).table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def _fault(n: int, wrong: str, right: str) -> Column:
    """A piece of JSON that is wrong in every tenth record, at its own remainder."""
    return F.when(F.col("p_partkey") % 10 == n, F.expr(wrong)).otherwise(F.expr(right))


def _files(spark, sf_dir, *pieces: Column):
    file = F.format_string("INT_BRM_%03d", F.col("p_partkey") % 1000)
    return _part(spark, sf_dir).select("p_partkey", file.alias("id"), F.col("p_partkey").cast("string").alias("file"), F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}")).alias("data"))


_INTERVIEW_FAULTS = [
    (0, "''", "personal key: phone"), (1, "''", "finer than district: village"), (2, "''", "consent_form: must be true"), (3, "''", "consent_date: not a date"),
    (4, "''", "age_bracket: not in list"), (5, "'dishes 1'", "name_th: required"), (6, "'dishes'", "dish_no: used twice"), (7, "''", "district: too long"),
    (8, "'dishes 2'", "personal data: phone"), (9, "'q10 1'", "official_recipe_id: not an integer"),
]


@registered(" union all ".join(f"select p_partkey::varchar as file, {place} as place, '{rule}' as rule from part where p_partkey % 10 = {n}" for n, place, rule in _INTERVIEW_FAULTS))
def interview_problems(spark, sf_dir):
    """One fault in each record, of ten kinds."""
    files = _files(
        spark, sf_dir,
        F.format_string('"informant_id":"%s","province_code":"TH-31"', F.format_string("INT_BRM_%03d", F.col("p_partkey") % 1000)),
        _fault(7, "concat('\"district\":\"', repeat('x', 501), '\"')", "'\"district\":\"Muang\"'"),
        _fault(0, "'\"phone\":\"x\",\"role\":null'", "'\"role\":\"cook\"'"), _fault(1, "'\"village\":\"x\"'", "'\"acquisition_mode\":\"market\"'"),
        _fault(2, "'\"consent_form\":\"true\"'", "'\"consent_form\":true'"), _fault(3, "'\"consent_date\":\"2026-02-30\"'", "'\"consent_date\":\"2026-02-01\"'"),
        _fault(4, "'\"age_bracket\":\"old\"'", "'\"age_bracket\":\"gt60\"'"), F.lit('"interview_date":"2026-03-01"'),
        F.concat(F.lit('"dishes":[{"dish_no":1,'), _fault(5, "'\"name_th\":\" \"'", "'\"name_th\":\"soup\"'"), F.lit(',"ingredients":["salt"]},{'), _fault(6, "'\"dish_no\":1'", "'\"dish_no\":2'"), F.lit(',"name_th":"rice","stated_absence":"'), _fault(8, "'081-234-5678'", "'none'"), F.lit('"}]')),
        F.concat(F.lit('"q10":[{"official_recipe_id":'), _fault(9, "'\"x\"'", "'7'"), F.lit(',"notes":"still made"}]')),
    )
    return validation.check(files, validation.INTERVIEW)


_MANUAL_FAULTS = [
    (0, "''", "province_th: required"), (1, "''", "transcribed_on: required"), (2, "''", "ingredients: required"), (3, "''", "endangerment: not in list"), (4, "'ingredients 1'", "name_th: required"),
    (5, "'ingredients 2'", "quantity_unit: too long"), (6, "''", "unknown key: colour"), (7, "''", "dish_name_th: not a string"), (8, "''", "not readable"), (9, "'ingredients 1'", "personal data: email"),
]


@registered(" union all ".join(f"select p_partkey::varchar as file, {place} as place, '{rule}' as rule from part where p_partkey % 10 = {n}" for n, place, rule in _MANUAL_FAULTS))
def manual_problems(spark, sf_dir):
    rows = F.concat(F.lit('"ingredients":[{'), _fault(4, "'\"quantity_value\":\"1\"'", "'\"name_th\":\"salt\"'"), _fault(9, "',\"acquisition_raw\":\"a@b.example\"'", "''"), F.lit('},{"name_th":"rice","quantity_unit":"'), _fault(5, "repeat('g', 301)", "'g'"), F.lit('"}]'))
    files = _files(
        spark, sf_dir, _fault(7, "'\"dish_name_th\":5'", "'\"dish_name_th\":\"soup\"'"), _fault(0, "'\"district_th\":\"x\"'", "'\"province_th\":\"Buri Ram\"'"),
        _fault(1, "'\"occasion_th\":\"x\"'", "'\"transcribed_on\":\"2026-02-01\"'"), _fault(3, "'\"endangerment\":\"gone\"'", "'\"endangerment\":\"lost\"'"), _fault(6, "'\"colour\":\"red\"'", "'\"notes\":\"none\"'"),
        F.when(F.col("p_partkey") % 10 == 2, '"dish_category_source":"x"').otherwise(rows),
    )
    return validation.check(files.withColumn("data", F.when(F.col("p_partkey") % 10 == 8, "{not json").otherwise(F.col("data"))), validation.MANUAL)


@registered(
    """select p_partkey::varchar as file, case p_partkey % 4 when 0 then 0 else 1 end::bigint as n_problems, false as loads from part"""
)
def cook_along_outcomes(spark, sf_dir):
    """Three faults in every four records, so that none loads."""
    n = F.col("p_partkey") % 4
    files = _files(
        spark, sf_dir, F.when(n == 1, '"recipe_id":"5"').otherwise('"recipe_id":5'), F.lit('"cook_date":"2026-10-04"'), F.when(n == 2, '"fidelity_order":"gone"').otherwise('"fidelity_order":"lost"'),
        F.when(n == 3, '"result_recognizable":1').otherwise('"result_recognizable":true'),
    )
    return validation.outcomes(files, validation.check(files, validation.COOKED)).withColumn("n_problems", F.col("n_problems").cast("long"))


_FILED_SQL = "select p_partkey as k, case p_partkey % 4 when 1 then 'INT_BRM_' else 'INT_BRM_' || lpad((p_partkey % 1000)::varchar, 3, '0') end as file from part"


@registered(
    f"""with f as ({_FILED_SQL})
select file, case k % 4 when 0 then 'informant_id: not like INT_ABC_001' when 1 then 'informant_id: not the file''s name' when 2 then 'informant_id: not the province''s prefix' else 'consent_date: after interview_date' end as rule from f
union all select file, 'province_code: not a fieldwork province' from f where k % 20 = 0"""
)
def interviews_misfiled(spark, sf_dir):
    n = F.col("p_partkey") % 4
    files = _files(
        spark, sf_dir, F.concat(F.lit('"informant_id":"'), F.when(n == 0, "BRM_1").otherwise(F.format_string("INT_BRM_%03d", F.col("p_partkey") % 1000)), F.lit('"')),
        F.concat(F.lit('"province_code":"'), F.when(F.col("p_partkey") % 20 == 0, "TH-99").when(n == 2, "TH-30").otherwise("TH-31"), F.lit('"')),
        F.concat(F.lit('"consent_date":"'), F.when(n == 3, "2026-04-01").otherwise("2026-02-01"), F.lit('","interview_date":"2026-03-01"')),
    )
    return validation.misfiled(files.select(F.when(n == 1, "INT_BRM_").otherwise(F.col("id")).alias("file"), "data"), {"TH-30": "NMA", "TH-31": "BRM"})


@registered(
    f"""with {BASE_SQL}, links as (select p_partkey::varchar as file, p_partkey as recipe_id, 'NATION_1' as province from part)
select 'not official' as what, count(*) as n from links left join recipes using (recipe_id) where register is null or register <> 'official'
union all select 'other province', count(*) from links l join recipes r using (recipe_id) where register = 'official' and r.province <> 'NATION_1'
union all select 'counted twice', count(distinct p_type) from part where p_type in (select p_type from part where p_partkey % 7 = 0)"""
)
def linked_records(spark, sf_dir):
    t, p = Testbed(spark, sf_dir), _part(spark, sf_dir)
    links = p.select(F.col("p_partkey").cast("string").alias("file"), F.col("p_partkey").alias("recipe_id"), F.lit("NATION_1").alias("province"))
    wrong, other = validation.linked(links, t.recipes())
    twice = validation.counted_twice(p.select(F.col("p_type").alias("document")), p.where("p_partkey % 7 = 0").select(F.col("p_type").alias("document")))
    out = None
    for what, df in (("not official", wrong), ("other province", other), ("counted twice", twice)):
        one = df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_TERMS = {"the ": ("compound", "North"), "la ": ("compound", "South"), "der ": ("bare", "North"), "und ": ("bare", "West")}
_TERM_SQL = "hits as (select distinct doc_id, rule, code from (" + " union all ".join(f"select doc_id, '{r}' as rule, '{c}' as code from documents where contains(text, '{t}')" for t, (r, c) in _TERMS.items()) + "))"
_SETS_SQL = f"{_TERM_SQL}, sets as (select doc_id, rule, list_sort(list(code)) as codes, count(*) as n from hits group by all)"


def _term_sets(spark, sf_dir):
    d = Testbed(spark, sf_dir).table("documents")
    return d, attribution.sets(attribution.term_hits(d, "doc_id", "text", _TERMS), "doc_id")


@registered(f"with {_SETS_SQL} select doc_id, coalesce(max(array_to_string(codes, '|')) filter (rule = 'compound'), '') as compound, coalesce(max(array_to_string(codes, '|')) filter (rule = 'bare'), '') as bare from sets group by doc_id")
def region_term_hits(spark, sf_dir):
    return attribution.listed_hits(_term_sets(spark, sf_dir)[1], "doc_id", ["compound", "bare"])


@registered(f"with {_SETS_SQL}, w as (select doc_id, max(codes[1]) filter (rule = 'compound' and n = 1) as a, max(codes[1]) filter (rule = 'bare' and n = 1) as b from sets group by doc_id) select 'compound' as left_rule, 'bare' as right_rule, count(*) filter (a is not null and b is not null) as \"both\", count(*) filter (a = b) as same from w")
def rule_agreement(spark, sf_dir):
    return attribution.agreement(_term_sets(spark, sf_dir)[1], "doc_id", [("compound", "bare")])


@registered(
    f"""with {_SETS_SQL}, r as (select unnest(['compound', 'bare']) as rule), n as (select source, count(*) as n from documents group by 1)
select n.source, r.rule, n.n, count(s.doc_id) as "any", count(*) filter (s.n = 1) as one, round(count(*) filter (s.n = 1) / n.n::double, 6) as share
from n cross join r left join (select sets.*, source from sets join documents using (doc_id)) s on s.source = n.source and s.rule = r.rule group by n.source, r.rule, n.n"""
)
def labelled_fractions(spark, sf_dir):
    d, found = _term_sets(spark, sf_dir)
    return attribution.labelled_fraction(found, d, "doc_id", "source", ["compound", "bare"]).withColumn("share", F.round("share", 6))


@registered(
    "with n as (select distinct p_name as name, p_brand as code from part where p_size <= 2) select distinct t.p_partkey, 'exact' as rule, code from part t join n on t.p_name = n.name union all select distinct t.p_partkey, 'substring', code from part t join n on contains(t.p_name, n.name)"
)
def title_rule_hits(spark, sf_dir):
    p = _part(spark, sf_dir)
    return attribution.title_hits(p, "p_partkey", "p_name", p.where("p_size <= 2").select(F.col("p_name").alias("name"), F.col("p_brand").alias("code")).distinct())


@registered("select 'by hand' as what, count(*) as n from part where p_partkey % 3 <> 0 and p_partkey % 5 = 0 union all select 'rule', count(*) from part where p_partkey % 3 = 0 union all select 'found', count(*) from customer where c_nationkey < 20 union all select 'missed', count(*) from customer where c_nationkey >= 20")
def merged_labels(spark, sf_dir):
    """Labels of a rule and by hand, and exact lookups of a form's field."""
    p = _part(spark, sf_dir)
    decided = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("label"), F.lit(1).alias("tier"))
    labels = attribution.merge_labels(decided, p.where("p_partkey % 5 = 0").select("p_partkey", F.col("p_type").alias("label")), "p_partkey")
    a = labels.groupBy(F.when(F.col("tier") == 3, "by hand").otherwise("rule").alias("what")).agg(F.count("*").alias("n"))
    t = Testbed(spark, sf_dir)
    known = t.table("nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("code"))
    forms = attribution.from_field(t.table("customer").select(F.col("c_nationkey").cast("string").alias("field")), known, "field")
    return a.unionByName(forms.groupBy(F.when(F.col("confidence") == "high", "found").otherwise("missed").alias("what")).agg(F.count("*").alias("n")))


@registered("select 'kept' as what, count(*) as n from orders where o_orderkey % 3 = 0 and o_orderstatus = 'F' union all select 'new', count(*) from orders where o_orderkey % 2 = 0 and not (o_orderkey % 3 = 0 and o_orderstatus = 'F') union all select 'collided', count(*) from orders where o_orderkey % 2 = 0 and o_orderkey % 3 = 0 and o_orderstatus = 'F' union all select 'owned', count(*) from orders where o_orderkey % 2 = 0 and o_orderstatus = 'F' union all select 'foreign', count(*) from orders where o_orderstatus <> 'F'")
def rebuilt_rows(spark, sf_dir):
    """Rows that people have validated stay, and so do rows of others."""
    o = Testbed(spark, sf_dir).table("orders").select("o_orderkey", "o_orderstatus")
    old = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("validated"), F.lit("old").alias("v"))
    now, collided = release.rebuilt(old, o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(False).alias("validated"), F.lit("new").alias("v")), ["o_orderkey"], "validated")
    noted = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "rule: x").otherwise("hand").alias("note"))
    again = attribution.rebuild(noted, o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("rule: y").alias("note")), "o_orderkey", "note", "rule:")
    counts = [(now.where("validated"), "kept"), (now.where("not validated"), "new"), (collided, "collided"), (again.where("note = 'rule: y'"), "owned"), (again.where("note = 'hand'"), "foreign")]
    out = None
    for df, what in counts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_OLD_SQL = "old as (select user_id, min(event_id) as id, 1::bigint as n, 'old' as v from events where user_id % 2 = 0 group by 1), new as (select user_id, max(event_id) as last, count(*) as n from events where user_id % 3 = 0 group by 1)"


@registered(
    f"""with {_OLD_SQL}
select 'insert' as how, user_id, coalesce(o.n, w.n) as n, coalesce(o.v, 'new') as v from old o full join new w using (user_id)
union all select 'replace', user_id, coalesce(w.n, o.n), case when w.n is not null then 'new' else o.v end from old o full join new w using (user_id)
union all select 'sum', user_id, coalesce(w.n, 0) + coalesce(o.n, 0), null from old o full join new w using (user_id)
union all select 'number', user_id, coalesce(o.id, (select max(id) from old) + row_number() over (partition by o.id is null order by user_id)), case when w.n is not null then 'new' else o.v end from old o full join new w using (user_id)
union all select 'gone', user_id, o.n, o.v from old o where user_id not in (select user_id from new)"""
)
def upsert_variants(spark, sf_dir):
    """The same two tables joined in five ways; a key that comes again counts by its last row."""
    e = Testbed(spark, sf_dir).table("events")
    old = e.where("user_id % 2 = 0").groupBy("user_id").agg(F.min("event_id").alias("id")).select("user_id", "id", F.lit(1).cast("long").alias("n"), F.lit("old").alias("v"))
    rows = e.where("user_id % 3 = 0")
    n = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    new = rows.join(n, "user_id").select("user_id", F.when(F.col("event_id") >= 0, F.col("n")).alias("n"), F.lit("new").alias("v"), "event_id")
    key, order = ["user_id"], ["event_id"]
    shown = lambda df, how, column="n": df.select(F.lit(how).alias("how"), "user_id", F.col(column).cast("long").alias("n"), (F.col("v") if "v" in df.columns else F.lit(None).cast("string")).alias("v"))
    plain = old.drop("id")
    return (
        shown(tables.insert_new(plain, new.drop("event_id"), key), "insert")
        .unionByName(shown(tables.replaced(plain, ranking.latest(new, key, order).drop("event_id"), key), "replace"))
        .unionByName(shown(tables.summed_upsert(plain, ranking.latest(new, key, order), key, ["n"]), "sum"))
        .unionByName(shown(tables.numbered_upsert(old, new.drop("event_id"), key, "id"), "number", "id"))
        .unionByName(shown(tables.not_in_files(plain, new, key), "gone"))
    )


@registered(
    "with s as (select p_name as key, count(*) as n, max('note ' || p_name) as note from part group by 1), e as (select distinct p_name as key, 'kept ' || p_name as note from part where p_size <= 25 union all select 'gone ' || n_name, 'kept' from nation) select coalesce(s.key, e.key) as key, coalesce(s.n, 0) as n, e.note from s full join e on s.key = e.key"
)
def merged_sheet(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    lines = t.table("part").groupBy(F.col("p_name").alias("key")).agg(F.count("*").alias("n"))
    old = t.table("part").where("p_size <= 25").select(F.col("p_name").alias("key")).distinct().withColumn("note", F.concat(F.lit("kept "), "key"))
    old = old.unionByName(t.table("nation").select(F.concat(F.lit("gone "), "n_name").alias("key"), F.lit("kept").alias("note")))
    return tables.merge_sheet(lines, old, "key", ["note"])


_DIGEST = "sha256(array_to_string([" + ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 16 * i}, 16))::ubigint::hugeint), 0)::varchar" for i in range(4)) + "], '|'))"


@registered(f"select o_orderstatus as status, count(*) as n_rows, {_DIGEST} as digest from (select o_orderstatus, sha256(o_orderkey || chr(31) || o_custkey || chr(31) || o_orderstatus) as h from orders) group by 1")
def frozen_digests(spark, sf_dir):
    o = Testbed(spark, sf_dir).table("orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    return release.freeze({"orders": o}, o, ["status"], {"tree clean": True})[1]


@registered(
    """select 'out' as what, count(*) as n from customer where c_mktsegment not in ('MACHINERY', 'BUILDING') or c_mktsegment is null union all select 'withheld', count(*) from customer where c_mktsegment in ('MACHINERY', 'BUILDING')
union all select 'variants out', count(*) from (select distinct p_name, p_brand from part) where p_name in (select p_name from part where p_size > 40) union all select 'variants withheld', count(*) from (select distinct p_name, p_brand from part) where p_name not in (select p_name from part where p_size > 40)
union all select 'failed checks', 1"""
)
def release_report(spark, sf_dir):
    """What goes out and what is withheld; of four checks, the one for glossed names fails."""
    t = Testbed(spark, sf_dir)
    out, held = release.withheld(t.table("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ("MACHINERY", "BUILDING"))
    p = t.table("part")
    variants, others = release.released_variants(p.select(F.col("p_name").alias("key"), F.col("p_brand").alias("canonical_id")).distinct(), p.where("p_size > 40").select(F.col("p_name").alias("key")))
    shown = variants.withColumn("name_en", F.when(F.col("key").contains("widget"), "").otherwise(F.col("key")))
    whole = release.Release({"recipes": out, "lexicon": shown}, {"recipes": out.schema}, {"lexicon": "name_en"}, {"recipes": ("c_mktsegment", ("MACHINERY", "BUILDING"))})
    failed = release.blockers(whole.checks(), []).agg(F.count("*").alias("n")).select(F.lit("failed checks").alias("what"), "n")
    counts = whole.counts().select(F.when(F.col("table") == "recipes", "out").otherwise("variants out").alias("what"), F.col("n_rows").alias("n"))
    return counts.unionByName(held.select(F.lit("withheld").alias("what"), "n")).unionByName(others.select(F.lit("variants withheld").alias("what"), "n")).unionByName(failed)


@registered("select p_partkey, case when p_partkey % 3 = 0 then p_size || ' g' when p_partkey % 3 = 1 then 'quantity not converted' else 'no quantity' end as quantity, row_number() over (partition by p_size order by p_type, p_partkey) as line from part")
def cooking_sheets(spark, sf_dir):
    p = _part(spark, sf_dir)
    n = F.col("p_partkey") % 3
    rows = p.select(
        F.col("p_size").alias("recipe_id"), F.col("p_type").alias("category"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("name"),
        release.quantity_shown(F.when(n == 0, F.col("p_size").cast("double")), n == 1).alias("quantity"), F.array(F.lit("market")).alias("modes"),
    )
    sheet = release.cooking_sheet(rows).withColumn("parts", F.split("shown", r" \| "))
    return sheet.select(F.get("parts", F.lit(1)).cast("bigint").alias("p_partkey"), F.get("parts", F.lit(2)).alias("quantity"), "line")


@registered(
    """select p_partkey, p_name || ' x' as title, case when p_partkey % 2 = 0 then 'tag~' || p_type else '' end as tags, p_brand || '~to [REDACTED]' as lines, case when p_partkey % 3 = 0 then null else cast('2024-02-03' as date) end as published,
  1::bigint + (p_partkey % 5 = 0)::bigint as n_redactions, 'https://x.example/' || p_partkey || case when p_partkey % 4 = 0 then '/[REDACTED]' else '' end as url from part"""
)
def export_rows(spark, sf_dir):
    """Rows of an export as records: cleaned, redacted before they are split, dated, and counted."""
    n = F.col("p_partkey")
    raw = _part(spark, sf_dir).select(
        "p_partkey", F.concat(F.lit(" "), "p_name", F.lit("  x ")).alias("title"), F.when(n % 2 == 0, F.concat(F.lit("tag| |"), "p_type")).alias("tags"),
        F.concat("p_brand", F.lit("; to a.b@mail.example; "), F.when(n % 5 == 0, "").otherwise("")).alias("lines"), F.when(n % 3 == 0, "3 Feb").otherwise("2024-02-03T10:00:00+07:00").alias("published"),
        F.concat(F.lit(" https://x.example/"), n.cast("string"), F.when(n % 4 == 0, "/081-234-5678").otherwise("")).alias("url"), F.when(n % 5 == 0, "13.75631, 100.50177").otherwise("none").alias("place"),
    )
    df = records.clean_url(records.cleaned(raw, ["title", "place"], {"tags": "bars", "lines": "semicolons"}), "url")
    return df.select("p_partkey", "title", F.array_join("tags", "~").alias("tags"), F.array_join("lines", "~").alias("lines"), text.iso_date(F.col("published")).alias("published"), "n_redactions", "url")


@registered("select p_partkey, p_name as title, cast('2024-01-02' as date) as published, p_type as category, case when p_partkey % 3 = 0 then 0 when p_partkey % 5 = 0 then 11 else 6 end::bigint as n_lines, case when p_partkey % 3 = 0 then 'no article' end as note, 0::bigint as n_redactions from part")
def page_records(spark, sf_dir):
    found = records.page_records(_html(spark, sf_dir), "p_partkey", "html")
    return found.select("p_partkey", "title", "published", "category", F.size("lines").cast("long").alias("n_lines"), "note", "n_redactions")


@registered("select p_partkey, 'title is empty' as reason from part where p_partkey % 4 = 0 union all select p_partkey, 'title is too long' from part where p_partkey % 4 = 1 union all select p_partkey, 'claim has no place' from part where p_partkey % 4 = 2 union all select p_partkey, 'line 2 is too long' from part where p_partkey % 4 = 3")
def rejected_records(spark, sf_dir):
    n = F.col("p_partkey") % 4
    p = _part(spark, sf_dir).select(
        "p_partkey", F.when(n == 0, " ").when(n == 1, F.expr("repeat('x', 201)")).otherwise(F.col("p_name")).alias("title"), F.array(F.lit("salt"), F.when(n == 3, F.expr("repeat('x', 301)")).otherwise("rice")).alias("lines"),
        F.when(n == 2, "footer").when(n == 0, "title").alias("claim_location"),
    )
    return records.rejected(p, "p_partkey")


@registered(
    """with r as (select p_partkey, p_brand as source_id, p_partkey % 3 <> 0 as has, p_brand in ('Brand#1', 'Brand#2') as undecided, p_type as kind from part)
select 'recipes' as what, count(*) filter (has and not undecided) as n from r union all select 'names', count(*) filter (not has) from r union all select 'undecided', count(*) filter (has and undecided) from r
union all select 'medium', count(*) filter (has and not undecided and kind = 'ECONOMY') from r union all select 'high', count(*) filter (has and not undecided and kind <> 'ECONOMY') from r"""
)
def split_loading(spark, sf_dir):
    p = _part(spark, sf_dir).select("p_partkey", F.col("p_brand").alias("source_id"), F.col("p_type").alias("kind"), F.when(F.col("p_partkey") % 3 != 0, F.array(F.lit("salt"))).otherwise(F.array().cast("array<string>")).alias("lines"))
    recipes, names, n = records.split_loading(p, "lines", ("Brand#1", "Brand#2"), "kind", ("ECONOMY",))
    n = n.where("what <> 'names'").unionByName(names.agg(F.count("*").alias("n")).select(F.lit("names").alias("what"), "n"))
    return n.unionByName(recipes.groupBy(F.col("confidence").alias("what")).agg(F.count("*").alias("n")))


@registered(
    """with r as (select p_size, case when p_partkey % 6 < 2 then 'recovered' when p_partkey % 6 = 2 then 'no glyphs' when p_partkey % 6 = 3 then 'none ticked' when p_partkey % 6 = 4 then 'unbound' else 'absent' end as bucket from part)
select bucket as name, count(*) as n, round(count(*) / (select count(*) from r)::double, 6) as share from r group by 1
union all select 'ceiling', count(*) filter (bucket in ('recovered', 'unbound')), null from r union all select 'without rows', count(*) filter (p_size % 10 = 0), round(avg(p_size % 10), 6) from r"""
)
def field_recovery(spark, sf_dir):
    n = F.col("p_partkey") % 6
    p = _part(spark, sf_dir).select("p_partkey", F.when(n < 2, "lost").alias("level"), (n != 2).alias("glyphs"), (n == 3).alias("bound"), (n == 4).alias("said"), (F.col("p_size") % 10).alias("rows"))
    r = p.withColumn("bucket", records.recovery(F.col("level"), F.col("glyphs"), F.col("bound"), F.col("said")))
    _, buckets, whole = records.field_recovery(r, ["level"], "rows", "bucket")
    out = buckets.select(F.col("bucket").alias("name"), "n", r6("share"))
    none = F.lit(None).cast("double")
    out = out.unionByName(whole.select(F.lit("ceiling").alias("name"), F.col("ceiling").alias("n"), none.alias("share")))
    return out.unionByName(whole.select(F.lit("without rows").alias("name"), F.col("without_rows").alias("n"), F.round("mean_rows", 6).alias("share")))


_STUDY_SQL = """terms as (select doc_id, case when contains(text, 'the ') then 'North' end as a, case when contains(text, 'la ') then 'South' end as b from documents),
labelled as (
  select d.doc_id, d.text, case when d.doc_id % 11 = 0 then 'East' when a is not null and b is null then a when b is not null and a is null then b end as region,
    case when d.doc_id % 11 = 0 then 'confirmed' when (a is null) <> (b is null) then 'term' end as label_source, d.doc_id % 3 as n_sections
  from documents d join terms using (doc_id)
)"""


def _labelled(spark, sf_dir):
    d = Testbed(spark, sf_dir).table("documents").select("doc_id", "text", (F.col("doc_id") % 3).alias("n_sections"))
    terms = attribution.term_hits(d, "doc_id", "text", {"the ": ("term", "North"), "la ": ("term", "South")})
    confirmed = d.where("doc_id % 11 = 0").select(F.concat(F.lit("view"), F.col("doc_id").cast("string")).alias("page"), F.lit("East").alias("region"))
    return study.labelled(d, confirmed, terms, "doc_id")


@registered(f"with {_STUDY_SQL} select doc_id, region, label_source from labelled")
def labelled_corpus(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", "region", "label_source")


@registered(f"with {_STUDY_SQL}, c as (select 'single' as cohort, * from labelled where region is not null and n_sections <= 0 union all select 'paired', * from labelled where region is not null and n_sections <= 1 union all select 'pooled', * from labelled where region is not null) select cohort, region, count(*) as n, 'n = ' || count(*) || ' of 3 regions' as caption from c where cohort in (select cohort from c group by 1 having count(*) >= 8) group by all")
def study_cohorts(spark, sf_dir):
    c = study.cohorts(_labelled(spark, sf_dir), "n_sections", {"single": 0, "paired": 1, "pooled": 99})
    return c.groupBy("cohort", "region").agg(F.count("*").alias("n")).withColumn("caption", study.caption(F.col("n"), 3, "regions"))


_REGION_SQL = """v as (select vec_id as id, 'R' || (label % 4) as region, list_transform(embedding, lambda x: x::double) as e from embeddings where label % 4 < 3),
u as (select id, region, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from v),
groups as (
  select 'all' as test, id, region from v union all
  select 'pair|' || a || '|' || b, id, region from v, (select x.region as a, y.region as b from (select distinct region from v) x, (select distinct region from v) y where x.region < y.region) where region in (a, b) union all
  select 'without|' || a, id, region from v, (select distinct region as a from v) where region <> a
),
drawn as (select test, rep, id, row_number() over (partition by test, rep order by ('0x' || substr(md5('42|regions|' || test || '|' || rep || '|' || id), 1, 8))::bigint, id) as place from groups, (select unnest(generate_series(1, 20)) as rep)),
slots as (select test, region, row_number() over (partition by test order by region) as place from groups),
lab as (select test, rep, id, region from drawn join slots using (test, place) union all select test, 0, id, region from groups),
s as (
  select x.test, x.rep, avg(1 - list_dot_product(a.u, b.u)) filter (x.region <> y.region) - avg(1 - list_dot_product(a.u, b.u)) filter (x.region = y.region) as separation
  from lab x join lab y on x.test = y.test and x.rep = y.rep and x.id < y.id join u a on a.id = x.id join u b on b.id = y.id group by all
),
o as (select test, separation from s where rep = 0),
p as (select s.test, (1 + count(*) filter (s.separation >= o.separation - 1e-12)) / (1 + count(*))::double as p, quantile_cont(s.separation, 0.025) as lo, quantile_cont(s.separation, 0.975) as hi from s join o using (test) where rep > 0 group by s.test),
h as (select test, least(1, max((m - rk + 1) * p) over (order by rk)) as p_holm from (select test, p, row_number() over (order by p, test) as rk, count(*) over () as m from p where starts_with(test, 'pair')))"""


def _judged(spark, sf_dir):
    e = Testbed(spark, sf_dir).table("embeddings").where("label % 4 < 3").select(F.col("vec_id").alias("id"), F.concat(F.lit("R"), (F.col("label") % 4).cast("string")).alias("region"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    units = e.select("id", F.posexplode(F.transform("e", lambda x: x / norm)).alias("term", "value"))
    groups = study.permuted(study.tests(e.select("id", "region")), inference.draw("regions", F.col("test"), F.col("rep"), F.col("id")), 20)
    keyed = groups.select(F.concat_ws("#", "test", F.col("rep").cast("string")).alias("test"), "id", "region")
    found = study.separations(keyed.join(units, "id"), keyed)
    named = found.select(F.split_part("test", F.lit("#"), F.lit(1)).alias("test"), F.split_part("test", F.lit("#"), F.lit(2)).cast("int").alias("rep"), "n", "separation")
    return study.judged(named)


@registered(f"with {_REGION_SQL} select test, (select count(*) from groups g where g.test = o.test) as n, round(separation, 6) as separation, round(p, 6) as p, round(lo, 6) as lo, round(hi, 6) as hi, round(p_holm, 6) as p_holm, coalesce(p_holm, p) < 0.05 as significant from o join p using (test) left join h using (test)")
def region_tests(spark, sf_dir):
    """All regions, each pair with Holm adjustment, and all but each one."""
    return _judged(spark, sf_dir).select("test", F.col("n").cast("long").alias("n"), *[r6(x) for x in ("separation", "p", "lo", "hi", "p_holm")], "significant")


@registered(f"with {_REGION_SQL} select split_part(test, '|', 2) as a, split_part(test, '|', 3) as b, round(separation, 6) as separation, abs(split_part(test, '|', 2)[2]::int - split_part(test, '|', 3)[2]::int)::double * 10 as km, case when p_holm < 0.05 then 'filled' else 'open' end as mark from o join h using (test)")
def region_pair_points(spark, sf_dir):
    places = spark.createDataFrame([(f"R{i}", 10.0 * i, 0.0) for i in range(3)], "region string, lon double, lat double")
    return study.pair_points(_judged(spark, sf_dir), places, F.abs(F.col("a_lon") - F.col("b_lon"))).withColumn("separation", F.round("separation", 6))


@registered(
    f"""with {BASE_SQL}, {VOCABULARY_SQL.strip()}, k as (select distinct register, recipe_id, raw as key from mentions), e as (select key, canonical_id, false as s from (select key, min(canonical_id) as canonical_id from aliases group by 1) union all select distinct key, canonical_id, true from splits where key not in (select key from aliases)), c as (select key, count(*) as n, bool_or(s) as s from e group by 1)
select register, count(*) as mentions, count(n) as mapped, count(*) filter (s) as split, coalesce(sum(n), 0)::bigint as entries from k left join c using (key) group by register"""
)
def mapping_counts(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    lines = vocabulary.dealt(_mentions(t).select("register", "recipe_id", "key"), "recipe_id").distinct()
    return vocabulary.mapping_counts(lines, vocabulary.lookup(_aliases(t), _splits(t)), (A, B, "domestic")).withColumn("entries", F.col("entries").cast("long"))


@registered(
    f"""with {BASE_SQL}, {VOCABULARY_SQL.strip()}, m as (select distinct source_id, register, recipe_id, raw as key from mentions), x as (select m.*, entry from m left join entries using (key))
select 'source:' || source_id as scope, count(*) filter (entry is null or entry <> 'excluded') as mentions, count(*) filter (entry is not null and entry not in ('conflict', 'excluded')) as mapped, count(*) filter (entry in ('Brand#1', 'Brand#2', 'Brand#3')) as mapped_trusted from x group by source_id"""
)
def trusted_coverage(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    trusted = spark.createDataFrame([(f"Brand#{i}",) for i in (1, 2, 3)], "canonical_id string")
    c = vocabulary.trusted_coverage(_mentions(t), _entries(t), trusted, (A, B))
    return c.where("scope like 'source:%'").select("scope", "mentions", "mapped", "mapped_trusted")


@registered(
    f"""with {BASE_SQL}, m as (select distinct register, recipe_id, raw as key from mentions), per as (select register, key, count(*) as n from m group by all), r as (select *, row_number() over (partition by register order by n desc, key) as rank from per)
select key, (select count(distinct recipe_id) from m where m.key = r.key) as n, coalesce(max(n) filter (register = '{A}'), 0) as official_n, max(rank) filter (register = '{A}') as official_rank from r group by key"""
)
def worklist_by_register(spark, sf_dir):
    w = vocabulary.worklist_by(_mentions(Testbed(spark, sf_dir)), "register", [A, B])
    return w.select("key", "n", "official_n", F.col("official_rank").cast("long").alias("official_rank"))


@registered(
    f"""with {VOCABULARY_SQL.strip()}, g as (select p_name as "group", count(*) as n, count(distinct p_partkey) as strings from part group by 1)
select "group", n, strings, row_number() over (order by n desc, "group") as rank, entry as suggested from g left join (select key, entry from entries where entry not in ('conflict', 'excluded')) on key = "group\""""
)
def suggested_groups(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    strings = t.table("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("group"), F.lit(1).alias("n"))
    g = vocabulary.suggestions(vocabulary.grouped(strings, "group"), _entries(t))
    return g.select("group", "n", "strings", F.col("rank").cast("long").alias("rank"), "suggested")


_PLAN_SQL = """case p_partkey % 8 when 0 then 'ING_0001' when 1 then 'ING_0001|ING_0002' when 2 then 'exclude' when 3 then 'ING_0001|ING_0001' when 4 then 'ING_9999' when 5 then 'salt' when 6 then 'ING_0002' else ' Exclude ' end"""


@registered(
    """select p_partkey as key, case p_partkey % 8 when 0 then 'alias' when 1 then 'split' when 2 then 'exclude' when 6 then 'already' else 'refused' end as action,
  case p_partkey % 8 when 0 then 'ING_0001' when 1 then 'ING_0001|ING_0002' when 3 then 'ING_0001|ING_0001' when 4 then 'ING_9999' when 5 then 'salt' when 6 then 'ING_0002' else '' end as ids,
  case p_partkey % 8 when 3 then 'an id is repeated' when 4 then 'no such entry' when 5 then 'not an entry''s id' when 7 then 'the vocabulary says otherwise' end as problem from part"""
)
def planned_decisions(spark, sf_dir):
    p = _part(spark, sf_dir).select(F.col("p_partkey").alias("key"), F.expr(_PLAN_SQL.replace("varchar", "string")).alias("decision"))
    entries = p.where("key % 8 >= 6").select("key", F.lit("ING_0002").alias("entry"))
    known = spark.createDataFrame([("ING_0001",), ("ING_0002",)], "canonical_id string")
    return vocabulary.planned(p, entries, known)


@registered(
    f"""with {BASE_SQL}, {VOCABULARY_SQL.strip()}, w as (select raw as key, count(distinct recipe_id) as n from mentions group by 1), c as (select distinct p_brand as entry, case when p_brand in ('Brand#1', 'Brand#2') then 'acid' else 'other' end as category from part)
select category, sum(n)::bigint as n, round(sum(n) / (select sum(n) from w)::double, 6) as share from w join entries using (key) join c using (entry) group by 1"""
)
def category_coverage(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    work = vocabulary.dealt(_mentions(t).select("recipe_id", "key"), "recipe_id").distinct().groupBy("key").agg(F.count("recipe_id").alias("n"))
    of = t.table("part").select(F.col("p_brand").alias("canonical_id"), F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "acid").otherwise("other").alias("category")).distinct()
    return vocabulary.category_coverage(work, _entries(t), of).select("category", F.col("n").cast("long").alias("n"), r6("share"))


_CATEGORIES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(vocabulary.CATEGORIES))


@registered(
    f"""with e as (select case p_size % 5 when 0 then 'acid' when 1 then 'fat' when 2 then 'other' when 3 then 'herb' else 'strange' end as category from part), f(place, category) as (values {_CATEGORIES}), n as (select category, count(*) as n from e group by 1)
select category, coalesce(n, 0) as n, place is not null as known, category = 'other' and coalesce(n, 0) / (select count(*) from e)::double > 0.05 as over from f full join n using (category)"""
)
def category_check(spark, sf_dir):
    c = F.element_at(F.array(*[F.lit(x) for x in ("acid", "fat", "other", "herb", "strange")]), (F.col("p_size") % 5 + 1).cast("int"))
    return vocabulary.category_check(_part(spark, sf_dir).select(c.alias("category")))


@registered(
    """with c as (select distinct p_name as string, case length(p_name) % 4 when 0 then 'grown|market' when 1 then 'none' when 2 then '' else 'stolen' end as modes from part), l as (select p_name as string, count(*) as n from part group by 1)
select sum(n)::bigint as n_rows, sum(n) filter (modes in ('grown|market', 'none'))::bigint as n_coded, count(*) as n_strings, count(*) filter (modes in ('grown|market', 'none')) as n_strings_coded, (select count(*) from c where modes = 'stolen') as n_refused,
  (select count(*) from part where p_partkey % 2 = 0 and length(p_name) % 4 = 0) as n_rows_with_modes from l join c using (string)"""
)
def acquisition_coding(spark, sf_dir):
    enum = ("grown", "foraged", "market", "packaged")
    p = _part(spark, sf_dir)
    sheet = p.select(F.col("p_name").alias("string")).distinct().withColumn("modes", F.element_at(F.array(F.lit("grown|market"), F.lit("none"), F.lit(""), F.lit("stolen")), F.length("string") % 4 + 1))
    codes, bad = vocabulary.parsed_modes(sheet, enum)
    cover = vocabulary.coding_coverage(p.select(F.col("p_name").alias("string")), codes)
    rows, back = release.coded(p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>")).alias("strings")), codes.where(F.size("codes") > 0), "modes", "p_partkey", "codes")
    refused = bad.agg(F.count("*").alias("n_refused")).crossJoin(back.select(F.col("n_coded").alias("n_rows_with_modes")))
    return cover.select(F.col("n_rows").cast("long").alias("n_rows"), F.col("n_coded").cast("long").alias("n_coded"), "n_strings", "n_strings_coded").crossJoin(refused)


@registered(
    """select p_partkey, date_diff('day', date '2024-01-01' + p_size, date '2024-12-31')::bigint as age, round(10 + (p_size - (select min(p_size) from part)) / ((select max(p_size) from part) - (select min(p_size) from part))::double * 90, 6) as x, round(20 * sqrt(p_size / (select max(p_size) from part)::double), 6) as radius,
  case p_partkey % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as confidence, date '2024-01-01' + p_size <= date '2024-01-26' as in_order, md5('s' || p_partkey) as first, least(p_name, p_brand) || '~' || greatest(p_name, p_brand) as pair from part"""
)
def small_expressions(spark, sf_dir):
    p = _part(spark, sf_dir)
    ends = p.agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
    kind = F.element_at(F.array(F.lit("confirmed"), F.lit("listed"), F.lit("seen")), (F.col("p_partkey") % 3 + 1).cast("int"))
    df = p.crossJoin(F.broadcast(ends)).withColumn("kind", kind)  # one row
    return df.select(
        "p_partkey", ranking.age_days(day, F.lit("2024-12-31").cast("date")).cast("long").alias("age"), F.round(ranking.scaled(F.col("p_size"), F.col("lo"), F.col("hi"), 10.0, 100.0), 6).alias("x"),
        F.round(ranking.radius(F.col("p_size"), F.col("hi"), 20.0), 6).alias("radius"), views.list_confidence("kind").alias("confidence"), (day <= F.lit("2024-01-26").cast("date")).alias("in_order"),
        F.md5(F.concat(F.lit("s"), F.col("p_partkey").cast("string"))).alias("first"), F.concat_ws("~", F.least("p_name", "p_brand"), F.greatest("p_name", "p_brand")).alias("pair"),
    )


@registered("select p_partkey, coalesce(own, first(own) over (partition by p_brand order by own is null, p_partkey)) as filled from (select p_partkey, p_brand, case when p_partkey % 3 = 0 then p_name end as own from part)")
def first_filled(spark, sf_dir):
    p = _part(spark, sf_dir).select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(" ").alias("filled"))
    return ranking.first_filled(p, ["p_brand"], ["p_partkey"], "filled").select("p_partkey", "filled")


@registered("select p_brand, count(*) filter (p_size > 10) as n_dated, '2024-01-' || lpad(max(p_size % 28 + 1)::varchar, 2, '0') as latest from part group by p_brand")
def dated_log(spark, sf_dir):
    """A log with one section for each part; sections of small parts have no date field but in their text."""
    p = _part(spark, sf_dir)
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"))
    first = p.groupBy("p_brand").agg(F.max(day).alias("d")).select("p_brand", F.lit(-1).cast("bigint").alias("line"), F.concat(F.lit("**Date of the log:** "), "d").alias("value"))
    heads = p.select("p_brand", (F.col("p_partkey") * 2).alias("line"), F.concat(F.lit("## "), "p_name").alias("value"))
    dates = p.select("p_brand", (F.col("p_partkey") * 2 + 1).alias("line"), F.concat(F.when(F.col("p_size") > 10, "**Date decided:** ").otherwise("on "), day).alias("value"))
    return ranking.dated_sections(first.unionByName(heads).unionByName(dates), "p_brand", "line", "value")


@registered("select p_brand, min(p_partkey) as p_partkey from part where p_partkey % 2 = 0 group by p_brand order by p_brand limit 5")
def clean_examples(spark, sf_dir):
    return ranking.examples(_part(spark, sf_dir).select("p_brand", "p_partkey"), "p_brand", ["p_partkey"], F.col("p_partkey") % 2 == 0, 5)


@registered(f"{MEMBERS_SQL} select register, count(*) as n from members where register in ('{A}', '{B}') group by 1")
def only_two_registers(spark, sf_dir):
    recipes, _ = _clean(spark, sf_dir)
    return views.only_registers(recipes.where("region is not null"), (A, B)).groupBy("register").agg(F.count("*").alias("n"))


@registered("select 'orders' as \"table\", count(*) as n from orders union all select 'no such table', null")
def guarded_counts(spark, sf_dir):
    """A table that cannot be read leaves only its own line without a number."""
    t = Testbed(spark, sf_dir)
    found = {"orders": reports.guarded(lambda: t.table("orders").agg(F.count("*").alias("n"))), "no such table": reports.guarded(lambda: t.table("no_such_table").agg(F.count("*").alias("n")))}
    rows = [(name, None if df is None else df.first()["n"]) for name, df in found.items()]
    return spark.createDataFrame(rows, '`table` string, n bigint')


@registered("select l_orderkey, loss, row_number() over (order by loss desc, day, l_orderkey) as place from (select l_orderkey, sum(case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end)::bigint as loss, min(l_shipdate) as day from lineitem group by 1) qualify place <= 50")
def most_damaged(spark, sf_dir):
    """The fifty most damaged, ties by date: a report's head."""
    rows = Testbed(spark, sf_dir).table("lineitem").select("l_orderkey", "l_shipdate", F.when(F.col("l_returnflag") == "R", "lost").when(F.col("l_returnflag") == "A", "degraded").alias("state"))
    loss = quality.fidelity(rows, "l_orderkey", "state").join(rows.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("day")), "l_orderkey")
    top = loss.orderBy(F.desc("loss"), "day", "l_orderkey").limit(50)
    return top.select("l_orderkey", "loss", F.row_number().over(Window.orderBy(F.desc("loss"), "day", "l_orderkey")).cast("long").alias("place"))


@registered(
    """select p_partkey as doc, p_name as dish, p_brand as province, case p_partkey % 2 when 0 then 'เกลือ~ข้าว หอม~น้ำ' else 'เกลือ~ข้าว~หอม~น้ำ' end as names, case p_partkey % 2 when 0 then 'ตลาด~ตลาด~ตลาด' else '~~~' end as origins,
  case p_partkey % 2 when 0 then '' else 'names by column' end as notes, 'near_lost' as level from part"""
)
def form_records(spark, sf_dir):
    """Forms as runs on a page; every other one has no row numbers."""
    def run(said, x, y):
        return F.struct((F.lit(said) if isinstance(said, str) else said).alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))

    table = [
        (("ที่", 10), ("ชื่อวัตถุดิบ/เครื่องปรุง", 60), ("สรรพคุณ", 200), ("ที่มา", 300)), (("1.", 10), ("เกลือ", 60), ("ช่วย", 200), ("ตลาด", 300)), (("๒", 10), ("ข้าว", 60), ("ดี", 200), ("ตลาด", 300)),
        (("หอม", 60),), (("4", 10), ("น้ำ", 60), ("ดี", 200), ("ตลาด", 300)), (("☑", 10), ("มีส่วนผสมของวัตถุดิบ", 30)), (("ด้านการเผยแพร่", 10),), (("5", 10), ("ลวง", 60)), (("☑", 10), ("ใกล้สูญหายแล้ว", 30)), (("☐", 10), ("สูญหายแล้ว", 30)),
    ]
    head = [run(F.concat(F.lit("ชื่อเมนูอาหาร ...."), "p_name", F.lit("....")), 10, 20), run(F.concat(F.lit("จังหวัด ..."), "p_brand"), 10, 40), run("เลขที่ 12/3", 10, 60)]
    runs = [run(t, x, 100 + 20 * y) for y, line in enumerate(table) for t, x in line]
    no_numbers = [run(t, x, 100 + 20 * y) for y, line in enumerate(table) for t, x in line if not (0 < y < 5 and x == 10)]
    p = _part(spark, sf_dir).select(F.col("p_partkey").alias("doc"), F.explode(F.when(F.col("p_partkey") % 2 == 0, F.array(*head, *runs)).otherwise(F.array(*head, *no_numbers))).alias("r")).select("doc", "r.*", F.lit(1).alias("page"))
    r = forms.records(p, {"level": [("สูญหายแล้ว", "lost"), ("ใกล้สูญหาย", "near_lost")]})
    return r.select("doc", "dish", "province", *[F.array_join(c, "~").alias(c) for c in ("names", "origins", "notes")], "level")


@registered(
    """select p_type as extractor, count(*) as documents, count(*) filter (p_size = 7) as failed, coalesce(sum(p_size + 3) filter (p_size <> 7), 0)::bigint as thai_chars, count(*) filter (p_size <> 7) as orphans, count(*) filter (p_size <> 7) as split_vowels,
  round(2000.0 * count(*) filter (p_size <> 7) / sum(p_size + 3) filter (p_size <> 7)::double, 2) as defects_per_1k from part group by 1"""
)
def extractor_comparison(spark, sf_dir):
    made = F.concat(F.expr("repeat('ก', p_size)"), F.lit(" ่ก า x"))
    p = _part(spark, sf_dir).select(F.col("p_partkey").alias("doc"), F.col("p_type").alias("extractor"), F.when(F.col("p_size") != 7, made).alias("text"))
    return reports.extractors(p).withColumn("thai_chars", F.col("thai_chars").cast("long"))


@registered("select p_brand as region, max(p_partkey) - 0.5 + 2.0::double as lon, 2.0::double as lat, 0::bigint as n_outside from part group by 1")
def region_points(spark, sf_dir):
    """Each part a square of side 4 far from the others; the region's widest is its last, which is a little wider."""
    p = _part(spark, sf_dir)
    last = p.groupBy("p_brand").agg(F.max("p_partkey").alias("last"))
    lo = F.col("p_partkey") - 1.0 + F.lit(0.5)
    hi = F.when(F.col("p_partkey") == F.col("last"), lo + 4.0).otherwise(lo + 0.25)
    ring = F.concat_ws(",", *[F.concat(F.lit("["), x.cast("string"), F.lit(f",{y}]")) for x, y in ((lo, 0), (hi, 0), (hi, 4), (lo, 4))])
    shapes = p.join(last, "p_brand").select(F.col("p_brand").alias("region"), F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")).alias("geojson"), "p_partkey", "last")
    points = geo.region_points(shapes, "region")
    out = geo.contains_point("geojson", "lon", "lat")
    n = shapes.where("p_partkey = last").join(points, "region").groupBy("region").agg(F.count_if(~out).alias("n_outside"))
    return points.join(n, "region")


@registered(
    f"""{MEMBERS_SQL}, {_WEIGHTS_SQL}, u as (select distinct unit from dist_w), i as (select canonical_id from dist_w group by 1 order by count(*) desc, 1 limit 10), r as (select unnest(['{A}', 'household']) as register)
select r.register, u.unit, i.canonical_id, case when (select count(*) from dist_w w where w.register = r.register and w.unit = u.unit) > 0 then round(coalesce(w.weight, 0), 6) end as weight
from r cross join u cross join i left join dist_w w on w.register = r.register and w.unit = u.unit and w.canonical_id = i.canonical_id"""
)
def heatmap_with_gaps(spark, sf_dir):
    """Two registers on the same axes, one of which has no recipes anywhere."""
    weights = profiles.weighted(profiles.prevalence(*_members(spark, sf_dir)), profiles.TFIDF)
    top = profiles.document_frequency(weights).orderBy(F.desc("df"), "canonical_id").limit(10).select("canonical_id")
    return ranking.full_grid(weights, top, [A, "household"]).withColumn("weight", F.round("weight", 6))


@registered(f"{MEMBERS_SQL}, {_WEIGHTS_SQL} select distinct register from dist_w where weight > 0")
def drawn_registers(spark, sf_dir):
    return study.drawn(profiles.weighted(profiles.prevalence(*_members(spark, sf_dir)), profiles.TFIDF))


@registered(
    """with l as (select n_name as unit, n_nationkey, case o_orderkey % 4 when 0 then ['market'] when 1 then ['grown', 'market'] when 2 then ['foraged'] else [] end as modes from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
t as (select unit, count(*) as total from l where len(modes) > 0 group by 1), n as (select unit, n_nationkey, mode, count(*) as n from (select unit, n_nationkey, unnest(modes) as mode from l) group by all)
select unit, mode, round(n / total::double, 6) as share, n_nationkey * 10.0::double as km from n join t using (unit)"""
)
def mode_shares(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    o = t.table("orders").join(t.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = F.col("o_orderkey") % 4
    modes = F.when(n == 0, F.array(F.lit("market"))).when(n == 1, F.array(F.lit("grown"), F.lit("market"))).when(n == 2, F.array(F.lit("foraged"))).otherwise(F.array().cast("array<string>"))
    places = t.table("nation").select(F.col("n_name").alias("unit"), F.col("n_nationkey").alias("lon"))
    return reports.mode_shares(o.select(F.col("n_name").alias("unit"), modes.alias("modes")), "modes", "unit", places, F.col("lon") * 10.0).withColumn("share", F.round("share", 6))
