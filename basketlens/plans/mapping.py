"""Queries on vocabulary, attribution, similarity, networks, pages and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlens.functions import pages, privacy, text
from basketlens.operators import attribution, network, profiles, quality, ranking, regional, similarity, views, vocabulary
from basketlens.plans.statistics import A, B, MEMBERS_SQL, _clean, _members, r6
from basketlens.plans.testbed import BASE_SQL, Testbed
from basketlens.sources import tables

QUERIES, ORACLE_SQL = {}, {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# The testbed's vocabulary: a part's name is a string, its brand an entry; one colour is split, one excluded.
def _keys(t: Testbed):
    p = t.table("part")
    return p.select(F.col("p_name").alias("key"), "p_brand", "p_size", "p_partkey")


def _aliases(t):
    return _keys(t).where("not startswith(key, 'small') and not startswith(key, 'red') and not startswith(key, 'blue')").select("key", F.col("p_brand").alias("canonical_id")).distinct()


def _splits(t):
    return _keys(t).where("startswith(key, 'small') and p_size <= 3").select("key", F.col("p_brand").alias("canonical_id")).distinct()


def _excluded(t):
    return _keys(t).where("startswith(key, 'red')").select("key").distinct()


VOCABULARY_SQL = """
aliases as (select distinct p_name as key, p_brand as canonical_id from part where not starts_with(p_name, 'small') and not starts_with(p_name, 'red') and not starts_with(p_name, 'blue')),
splits as (select distinct p_name as key, p_brand as canonical_id from part where starts_with(p_name, 'small') and p_size <= 3),
excluded as (select distinct p_name as key from part where starts_with(p_name, 'red')),
entries0 as (
  select key, min(canonical_id) as entry from aliases where key not like '%ring' group by key union select key, canonical_id from aliases where key like '%ring'
  union select distinct key, 'split' from splits union select key, 'excluded' from excluded
),
entries as (select key, case when count(distinct entry) > 1 then 'conflict' else min(entry) end as entry from entries0 group by key)"""


def _entries(t):
    a = _aliases(t)
    one = vocabulary.first_wins(a.where("key not like '%ring'")).select("key", F.col("canonical_id").alias("entry"))
    several = a.where("key like '%ring'").select("key", F.col("canonical_id").alias("entry"))
    marked = _splits(t).select("key", F.lit(vocabulary.SPLIT).alias("entry")).unionByName(_excluded(t).select("key", F.lit(vocabulary.EXCLUDED).alias("entry")))
    return vocabulary.index(one.unionByName(several).unionByName(marked).distinct())


@registered(f"with {VOCABULARY_SQL.strip()} select key, entry from entries")
def conflict_index(spark, sf_dir):
    return _entries(Testbed(spark, sf_dir))


def _mentions(t):
    return t.mentions().withColumnRenamed("raw", "key")


@registered(
    f"""with {BASE_SQL}, {VOCABULARY_SQL.strip()}, pairs as (select distinct source_id, register, recipe_id, raw as key from mentions),
scoped as (select unnest(list_filter(['all', case when register in ('{A}', '{B}') then 'studied' end, 'register:' || register, 'source:' || source_id], lambda x: x is not null)) as scope, key, entry from pairs left join entries using (key))
select scope, count(*) filter (coalesce(entry <> 'excluded', true)) as mentions, count(*) filter (entry not in ('conflict', 'excluded')) as mapped,
  count(*) filter (entry = 'conflict') as conflicting, count(*) filter (entry = 'excluded') as excluded, count(distinct key) as strings,
  round(count(*) filter (entry not in ('conflict', 'excluded')) / nullif(count(*) filter (coalesce(entry <> 'excluded', true)), 0)::double, 6) as mapped_share
from scoped group by scope"""
)
def coverage_by_scope(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    c = vocabulary.coverage(_mentions(t), _entries(t), (A, B))
    return c.withColumn("mapped_share", F.round("mapped_share", 6))


@registered(
    f"""with {BASE_SQL}, {VOCABULARY_SQL.strip()}, pairs as (select distinct register, recipe_id, raw as key from mentions),
n as (select key, count(*) as n, count(*) filter (register = 'official') as official, count(*) filter (register = 'commercial') as commercial, count(*) filter (register = 'domestic') as domestic from pairs group by key)
select key, n, official, commercial, domestic, entry, row_number() over (order by n desc, key) as rank,
  round(sum(n) over (order by n desc, key) / (select sum(n) from n)::double, 6) as cum_share from n left join entries using (key)"""
)
def worklist_ranked(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    w = vocabulary.worklist(_mentions(t), _entries(t))
    return w.select("key", "n", "official", "commercial", "domestic", "entry", F.col("rank").cast("long").alias("rank"), r6("cum_share"))


@registered(
    f"""with {BASE_SQL}, n as (select source_id, raw as key, count(distinct recipe_id) as n from mentions group by all),
r as (select source_id, n, row_number() over (partition by source_id order by n desc, key) as rank, sum(n) over (partition by source_id order by n desc, key) / sum(n) over (partition by source_id)::double as cum from n)
select source_id, share, min(rank) filter (cum >= share) as rank_reaching from r, (select unnest([0.5, 0.8, 0.9])::double as share) group by all"""
)
def rank_reaching_share(spark, sf_dir):
    n = vocabulary.dealt(_mentions(Testbed(spark, sf_dir)).select("source_id", "recipe_id", "key"), "recipe_id").distinct().groupBy("source_id", "key").agg(F.count("*").alias("n"))
    ranks = ranking.ranked(n, "key", group=["source_id"])
    out = None
    for share in (0.5, 0.8, 0.9):
        one = ranking.rank_reaching(ranks, share, ["source_id"])
        out = one if out is None else out.unionByName(one)
    return out.select("source_id", "share", F.col("rank_reaching").cast("long").alias("rank_reaching"))


@registered(
    f"""with {BASE_SQL}, {VOCABULARY_SQL.strip()},
lookup as (select key, min(canonical_id) as canonical_id from aliases group by key union select key, canonical_id from splits where key not in (select key from aliases)),
hits as (select l_orderkey as recipe_id, canonical_id, min(l_linenumber) as pos, p_name as raw from lineitem join part on l_partkey = p_partkey join lookup on key = p_name group by all)
select recipe_id, canonical_id, string_agg(raw, ' ‖ ' order by pos, raw) as raw from hits group by all"""
)
def canonicalise_lines(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    part = t.table("part").select("p_partkey", F.col("p_name").alias("key"))
    lines = t.table("lineitem").select(F.col("l_orderkey").alias("recipe_id"), F.col("l_linenumber").alias("pos"), "l_partkey")
    rows = lines.join(part, lines["l_partkey"] == part["p_partkey"]).select("recipe_id", "pos", "key", F.col("key").alias("raw"))
    return vocabulary.canonicalise(rows, vocabulary.lookup(_aliases(t), _splits(t)))


@registered(
    """with modes as (select l_orderkey as recipe_id, list(distinct m) as m from (select l_orderkey, unnest(case l_returnflag when 'R' then ['bought', 'returned'] when 'A' then ['grown'] else ['bought'] end) as m from lineitem) group by 1)
select recipe_id, array_to_string(list_filter(['grown', 'bought', 'returned'], lambda x: list_contains(m, x)), ' ') as modes from modes"""
)
def acquisition_union(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    lines = t.table("lineitem").select(F.col("l_orderkey").alias("recipe_id"), F.lit("all").alias("canonical_id"), F.col("l_returnflag").alias("code"))
    coding = spark.createDataFrame([("R", ["bought", "returned"]), ("A", ["grown"]), ("N", ["bought"])], "code string, modes array<string>")
    m = vocabulary.modes(lines, F.broadcast(coding), ("grown", "bought", "returned"))
    return m.select("recipe_id", F.array_join("modes", " ").alias("modes"))


@registered(f"with {VOCABULARY_SQL.strip()} select distinct key from excluded where key in (select p_name from part where p_size > 40)")
def semi_excluded(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    return _excluded(t).join(_keys(t).where("p_size > 40"), "key", "left_semi")


@registered(
    f"""with {VOCABULARY_SQL.strip()} select key, 'alias' as "of", 'split' as and_of from (select distinct key from aliases) where key in (select key from splits)
union all select key, 'alias', 'exclusion' from (select distinct key from aliases) where key in (select key from excluded)
union all select key, 'split', 'exclusion' from (select distinct key from splits) where key in (select key from excluded)"""
)
def vocabulary_overlaps(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    return vocabulary.overlaps(_aliases(t), _splits(t), _excluded(t))


@registered("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_unnest(spark, sf_dir):
    return tables.payload(Testbed(spark, sf_dir).table("events"), "event_id", "props")


@registered("select event_type, day, n, n - lag(n) over (partition by event_type order by day) as delta from (select event_type, cast(ts as date) as day, count(*) as n from events group by all)")
def snapshot_delta(spark, sf_dir):
    n = Testbed(spark, sf_dir).table("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return ranking.snapshot_delta(n, "event_type", "day", "n")


@registered("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_per_key(spark, sf_dir):
    e = Testbed(spark, sf_dir).table("events").select("user_id", "ts", "event_id", "event_type", "value")
    return ranking.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@registered("select bin, count(event_id) as n from (select unnest([0, 1, 2, 3, 4]) as bin) left join (select event_id, case when value < 10 then 0 when value < 20 then 1 when value < 50 then 2 when value <= 100 then 3 when value <= 1e9 then 4 end as b from events) on b = bin group by bin")
def value_histogram(spark, sf_dir):
    h = ranking.histogram(Testbed(spark, sf_dir).table("events"), "value", [0, 10, 20, 50, 100.0000001, 1e9])
    return h.select("bin", "n")


@registered("select event_type, max(value) filter (i = n // 2 + 1) as median from (select event_type, value, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events where value is not null) group by 1")
def upper_median(spark, sf_dir):
    return ranking.upper_median(Testbed(spark, sf_dir).table("events"), ["event_type"], "value")


@registered("select 'text' as field, count(*) filter (trim(text) <> '') as n_filled, round(count(*) filter (trim(text) <> '') / count(*)::double, 6) as share from documents union all select 'lang', count(lang) filter (trim(lang) <> ''), round(count(lang) filter (trim(lang) <> '') / count(*)::double, 6) from documents union all select 'source', count(source) filter (trim(source) <> ''), round(count(source) filter (trim(source) <> '') / count(*)::double, 6) from documents")
def fill_rates(spark, sf_dir):
    f = ranking.fill_rates(Testbed(spark, sf_dir).table("documents"), ["text", "lang", "source"])
    return f.select("field", "n_filled", r6("share"))


# attribution: nations named in texts built from names the tables have
NAMES = "select n_nationkey as code, case when n_nationkey % 2 = 0 then split_part(p_name, ' ', 1) || ' ' else split_part(p_name, ' ', 2) end as name, n_nationkey % 5 = 0 as ambiguous from nation join part on p_partkey = n_nationkey"
RULES_SQL = f"""names as ({NAMES}), texts as (select p_partkey as k, p_name || ' ' || p_type as t from part),
hits as (select k, code, 'permissive' as rule from texts, names where contains(t, name) union select k, code, 'strict' from texts, names where contains(t, name) and not ambiguous
  union select k, code, 'marker' from texts, names where contains(t, name) and starts_with(t, name))"""


def _hits(t):
    p, n = t.table("part"), t.table("nation")
    words = p.select("p_partkey", F.split("p_name", " ").alias("w"))
    name = F.when(F.pmod("n_nationkey", F.lit(2)) == 0, F.concat(F.col("w")[0], F.lit(" "))).otherwise(F.col("w")[1])
    names = n.join(words, n["n_nationkey"] == words["p_partkey"]).select(F.col("n_nationkey").alias("code"), name.alias("name"), (F.pmod("n_nationkey", F.lit(5)) == 0).alias("ambiguous"))
    texts = p.select(F.col("p_partkey").alias("k"), F.concat_ws(" ", "p_name", "p_type").alias("t"))
    rules = {"permissive": F.lit(True), "strict": ~F.col("ambiguous"), "marker": F.startswith(F.col("t"), F.col("name"))}
    return texts, attribution.name_hits(texts, "k", "t", names, rules)


@registered(f"with {RULES_SQL}, n as (select rule, k, count(*) as n from hits group by all) select rule, count(*) as any, count(*) filter (n = 1) as one, count(*) filter (n > 1) as conflicting, (select count(*) from texts) as texts, round(count(*) filter (n = 1) / (select count(*) from texts)::double, 6) as share from n group by rule")
def label_rule_yield(spark, sf_dir):
    texts, hits = _hits(Testbed(spark, sf_dir))
    y = attribution.rule_yield(attribution.sets(hits, "k"), texts, ["permissive", "strict", "marker"])
    return y.select("rule", "any", "one", "conflicting", "texts", r6("share"))


@registered(
    f"""with {RULES_SQL}, p as (select k, min(code) as c, count(*) as n from hits where rule = 'strict' group by k), r as (select k, min(code) as c, count(*) as n from hits where rule = 'marker' group by k)
select k, case when p.n = 1 then p.c when p.n is null and r.n = 1 then r.c end as label, case when p.n = 1 then 1 when p.n is null and r.n = 1 then 2 end as tier,
  case when p.n = 1 and r.n > 1 then 'regions conflict' when p.n > 1 then 'several provinces' when p.n is null and r.n > 1 then 'several regions' end as note
from texts left join p using (k) left join r using (k)"""
)
def label_decision(spark, sf_dir):
    texts, hits = _hits(Testbed(spark, sf_dir))
    s = attribution.sets(hits, "k")
    return attribution.decide(texts, "k", s.where("rule = 'strict'"), s.where("rule = 'marker'"))


@registered("select doc_id, item_id from documents d join (select item_id, text as head from benchmark) on contains(d.text, head)")
def substring_match(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    items = t.table("benchmark").select("item_id", F.col("text").alias("head"))
    return similarity.contained(t.table("documents"), "doc_id", "text", items, "head").join(items, "head").select("doc_id", "item_id")


@registered(f"with {BASE_SQL}, b as (select f.recipe_id, canonical_id from facts f join clean using (recipe_id)), n as (select recipe_id, count(*) as n from b group by 1), x as (select a.recipe_id as a, c.recipe_id as b, count(*) as k from b a join b c using (canonical_id) where a.recipe_id < c.recipe_id group by all) select a, b, round(k / (p.n + q.n - k)::double, 6) as similarity from x join n p on p.recipe_id = a join n q on q.recipe_id = b where k / (p.n + q.n - k)::double > 0.5")
def jaccard_candidates(spark, sf_dir):
    recipes, facts = _clean(spark, sf_dir)
    items = facts.join(recipes.select("recipe_id"), "recipe_id").select(F.col("recipe_id").alias("key"), F.col("canonical_id").alias("item"))
    return similarity.similar_sets(items, 0.5).select("a", "b", r6("similarity"))


@registered()
def duplicate_candidates(spark, sf_dir):
    recipes, facts = _clean(spark, sf_dir)
    items = facts.join(recipes.select("recipe_id"), "recipe_id").select(F.col("recipe_id").alias("key"), F.col("canonical_id").alias("item"))
    titles = recipes.select(F.col("recipe_id").alias("key"), F.concat_ws(" ", "source_id", "province").alias("title"))
    return similarity.duplicate_candidates(items, titles, 0.5, 0.8)


@registered(
    f"""with {BASE_SQL}, l as (select recipe_id as l, canonical_id from facts join clean using (recipe_id) where register = '{A}' and recipe_id % 50 = 0), r as (select recipe_id as r, canonical_id from facts join clean using (recipe_id) where register = '{B}'),
nl as (select l, count(*) as n from l group by 1), nr as (select r, count(*) as n from r group by 1), x as (select l, r, count(*) as k from l join r using (canonical_id) group by all),
best as (select l, r, k / (nl.n + nr.n - k)::double as s from x join nl using (l) join nr using (r) qualify row_number() over (partition by l order by s desc, r) = 1)
select bin, count(l) as n from (select unnest([0, 1, 2, 3]) as bin) left join (select l, case when s < 0.25 then 0 when s < 0.5 then 1 when s < 0.75 then 2 else 3 end as b from best) on b = bin group by bin"""
)
def histogram_best_match(spark, sf_dir):
    """A search: official recipes whose id is divisible by 50, against all commercial ones."""
    recipes, facts = _clean(spark, sf_dir)
    items = recipes.select("recipe_id", "register").join(facts, "recipe_id").select("register", F.col("recipe_id").alias("key"), F.col("canonical_id").alias("item"))
    best = similarity.best_matches(items.where(f"register = '{A}' and key % 50 = 0"), items.where(f"register = '{B}'"))
    return ranking.histogram(best, "similarity", [0, 0.25, 0.5, 0.75, 1]).select("bin", "n")


@registered()
def title_ratio(spark, sf_dir):
    names = Testbed(spark, sf_dir).table("part").select(F.col("p_name").alias("key")).distinct()
    return similarity.near_strings(names, names, 0.8)


@registered("select sha256(text) as digest, min(doc_id) as first_key, count(*) as copies from documents group by 1")
def exact_dedup(spark, sf_dir):
    return similarity.exact_copies(Testbed(spark, sf_dir).table("documents"), "text", "doc_id")


_RE2 = {"email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "media_link": r"https?://\S+"}


@registered(f"select doc_id, len(regexp_extract_all(text, '{_RE2['email']}')) as n_email, len(regexp_extract_all(text, '{_RE2['media_link']}')) as n_media_link from documents")
def redact_counts(spark, sf_dir):
    r = Testbed(spark, sf_dir).table("documents").select("doc_id", privacy.redact("text").alias("r"))
    return r.select("doc_id", F.col("r.n_email").cast("long").alias("n_email"), F.col("r.n_media_link").cast("long").alias("n_media_link"))


@registered()
def redact_texts(spark, sf_dir):
    c = Testbed(spark, sf_dir).table("conversations")
    return c.select("conv_id", "turn", privacy.redact("text").alias("r")).select("conv_id", "turn", "r.*")


@registered()
def leak_scan(spark, sf_dir):
    """The generator takes the classes from Python once; a filter would be moved before them, and have its own."""
    classes = F.array_join(privacy.classes_left("text"), " ")
    return Testbed(spark, sf_dir).table("documents").select("doc_id", F.explode(F.filter(F.array(classes), lambda x: x != "")).alias("classes"))


@registered()
def scan_all_text_columns(spark, sf_dir):
    t, out = Testbed(spark, sf_dir), None
    for name in ("documents", "pages", "conversations"):
        one = privacy.scan(t.table(name), name)
        out = one if out is None else out.unionByName(one)
    return out


@registered(r"select doc_id, md5(trim(regexp_replace(nfc_normalize(text), '[\s\x0b\x85\x1c-\x1f\p{Z}]+', ' ', 'g'))) as key_md5 from documents")
def normalise_key(spark, sf_dir):
    return Testbed(spark, sf_dir).table("documents").select("doc_id", F.md5(text.key(F.col("text"))).alias("key_md5"))


@registered()
def html_lines(spark, sf_dir):
    p = Testbed(spark, sf_dir).table("pages")
    return p.select("page_id", F.posexplode(pages.html_lines(F.col("html"))).alias("pos", "line"))


@registered()
def html_sections(spark, sf_dir):
    """A line of at most 40 characters opens a section, one of over 400 ends it."""
    return pages.sections(html_lines(spark, sf_dir), "page_id", F.length("line") <= 40, F.lit(False), 400)


@registered()
def single_section_outcome(spark, sf_dir):
    p = Testbed(spark, sf_dir).table("pages")
    found = html_sections(spark, sf_dir)
    return pages.single_section(found, p, "page_id", "url").groupBy("outcome").agg(F.count("*").alias("n"))


@registered(
    r"""select page_id, len(regexp_extract_all(html, '(?i)<script')) as n_scripts, len(regexp_extract_all(html, '(?i)<li[ >]')) as n_items,
  regexp_matches(html, '(?i)__NEXT_DATA__|window\.__|data-reactroot') as hydrated, regexp_matches(html, 'application/ld\+json') as has_metadata from pages"""
)
def page_audit(spark, sf_dir):
    a = Testbed(spark, sf_dir).table("pages").select("page_id", pages.audit(F.col("html")).alias("a"))
    return a.select("page_id", "a.n_scripts", "a.n_items", "a.hydrated", "a.has_metadata")


@registered("select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host, lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1)) as slug from pages")
def url_parts(spark, sf_dir):
    return Testbed(spark, sf_dir).table("pages").select("page_id", text.host_of(F.col("url")).alias("host"), text.slug(F.col("url")).alias("slug"))


def _vectors(t):
    return t.table("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


CENTROID_SQL = """c as (select label, i, avg(v::double) as v from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings) group by all),
norms as (select label, sqrt(sum(v * v)) as n from c group by 1),
far as (select a.label as a, b.label as b, 1 - sum(a.v * b.v) / (any_value(x.n) * any_value(y.n)) as distance from c a join c b using (i) join norms x on x.label = a.label join norms y on y.label = b.label where a.label < b.label group by all)"""


@registered(f"with {CENTROID_SQL} select a, b, round(distance, 6) as distance from far")
def centroid_distances(spark, sf_dir):
    return regional.cosine_pairs(regional.centroids(_vectors(Testbed(spark, sf_dir))), "label").select("a", "b", r6("distance"))


COHORT_SQL = """v as (select vec_id as id, label, embedding as e from embeddings),
far as (select a.id as a, b.id as b, 1 - list_dot_product(a.e::double[], b.e::double[]) / (sqrt(list_dot_product(a.e::double[], a.e::double[])) * sqrt(list_dot_product(b.e::double[], b.e::double[]))) as distance from v a join v b on a.id < b.id)"""


@registered(
    f"""with {COHORT_SQL}, slots as (select label, row_number() over (order by id) as place from v),
drawn as (select rep, id, row_number() over (partition by rep order by ('0x' || substr(md5('42|separation|' || rep || '|' || id), 1, 8))::bigint, id) as place from v, (select unnest(generate_series(1, 20)) as rep)),
lab as (select rep, id, label from drawn join slots using (place) union all select 0, id, label from v),
gaps as (select x.rep as rep, avg(distance) filter (x.label <> y.label) - avg(distance) filter (x.label = y.label) as gap from far join lab x on x.id = a join lab y on y.id = b and y.rep = x.rep group by x.rep)
select round((select gap from gaps where rep = 0), 6) as observed, round((1 + count(*) filter (rep > 0 and gap >= (select gap from gaps where rep = 0))) / (1 + count(*) filter (rep > 0))::double, 6) as p from gaps"""
)
def separation_test(spark, sf_dir):
    v = _vectors(Testbed(spark, sf_dir))
    return regional.one_sided(regional.separation(v, 20), "gap").select(r6("observed"), r6("p"))


@registered(
    f"""with {CENTROID_SQL}, other as (select a, b, abs(a - b)::double as distance from far), ids as (select distinct label as id from c), slots as (select id as label, row_number() over (order by id) as place from ids),
drawn as (select rep, id, row_number() over (partition by rep order by ('0x' || substr(md5('42|mantel|' || rep || '|' || id), 1, 8))::bigint, id) as place from ids, (select unnest(generate_series(1, 20)) as rep)),
lab as (select rep, id, label from drawn join slots using (place) union all select 0, id, id from ids),
moved as (select x.rep, least(x.label, y.label) as a, greatest(x.label, y.label) as b, distance as x from far join lab x on x.id = a join lab y on y.id = b and y.rep = x.rep),
r as (select rep, corr(x, o.distance) as r from moved join other o using (a, b) group by rep)
select round((select r from r where rep = 0), 6) as observed, round((1 + count(*) filter (rep > 0 and r >= (select r from r where rep = 0))) / (1 + count(*) filter (rep > 0))::double, 6) as p from r"""
)
def mantel_test(spark, sf_dir):
    far = regional.cosine_pairs(regional.centroids(_vectors(Testbed(spark, sf_dir))), "label")
    other = far.select("a", "b", F.abs(F.col("a") - F.col("b")).cast("double").alias("distance"))
    return regional.one_sided(regional.mantel(far, other, 20), "r").select(r6("observed"), r6("p"))


@registered(
    r"""with tok as (select doc_id as doc, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents), tf as (select doc, token, count(*) as tf from tok group by all),
df as (select token, count(*) as df from tf group by 1 having count(*) >= 2), n as (select count(distinct doc) as n from tok), w as (select doc, token, tf * (ln((1 + n) / (1 + df)::double) + 1) as w from tf join df using (token), n)
select doc, count(*) as tokens, round(max(w / s), 6) as top from (select doc, token, w, sqrt(sum(w * w) over (partition by doc)) as s from w) group by doc"""
)
def tfidf_l2(spark, sf_dir):
    d = Testbed(spark, sf_dir).table("documents")
    return regional.tfidf_tops(d.select(F.col("doc_id").alias("doc"), "text"), "[a-z]+").withColumn("top", F.round("top", 6))


PMI_SQL = f"""with {BASE_SQL}, f as (select recipe_id, canonical_id from facts join clean using (recipe_id) where register = '{A}'), one as (select canonical_id, count(*) as k from f group by 1),
edges as (select a.canonical_id as a, b.canonical_id as b, count(*) as n from f a join f b on a.recipe_id = b.recipe_id and a.canonical_id < b.canonical_id group by all having count(*) >= 2),
pmi as (select a, b, n, ln(n * (select count(distinct recipe_id) from f) / (x.k::double * y.k)) as pmi from edges join one x on x.canonical_id = a join one y on y.canonical_id = b)"""


def _official(spark, sf_dir):
    recipes, facts = _clean(spark, sf_dir)
    return facts.join(recipes.where(F.col("register") == A).select("recipe_id"), "recipe_id")


@registered(f"{PMI_SQL} select a, b, n, round(pmi, 6) as pmi from pmi")
def pmi_network(spark, sf_dir):
    return network.pmi(_official(spark, sf_dir)).select("a", "b", "n", r6("pmi"))


@registered(
    f"""{PMI_SQL}, e as (select * from pmi where pmi > 0), ends as (select a as node, pmi from e union all select b, pmi from e), s as (select node, sum(pmi) as s, count(*) as k from ends group by 1)
select a, b, round(pmi, 6) as pmi, round(least(case when x.k > 1 then pow(1 - pmi / x.s, x.k - 1) else 1 end, case when y.k > 1 then pow(1 - pmi / y.s, y.k - 1) else 1 end), 6) as p
from e join s x on x.node = a join s y on y.node = b where least(case when x.k > 1 then pow(1 - pmi / x.s, x.k - 1) else 1 end, case when y.k > 1 then pow(1 - pmi / y.s, y.k - 1) else 1 end) < 0.2"""
)
def disparity_backbone(spark, sf_dir):
    return network.backbone(network.pmi(_official(spark, sf_dir)), alpha=0.2).select("a", "b", r6("pmi"), r6("p"))


@registered(f"with {BASE_SQL}, h as (select region as unit, canonical_id, max((register = '{A}')::int) as l, max((register = '{B}')::int) as r from clean join facts using (recipe_id) where register in ('{A}', '{B}') group by all) select unit, count(*) filter (l = 1 and r = 1) as both, count(*) filter (l = 1 and r = 0) as left_only, count(*) filter (l = 0 and r = 1) as right_only from h group by unit")
def overlap_counts(spark, sf_dir):
    recipes, facts = _clean(spark, sf_dir)
    return network.overlap(views.fact_rows(recipes, facts, "region"), A, B)


@registered(f"{MEMBERS_SQL}, {profiles.distances_sql('members', profiles.TFIDF)}, d as (select unit, canonical_id, sum(case when register = '{A}' then weight else -weight end) as d from dist_w where register in ('{A}', '{B}') group by all) select unit, round(sum(case when d > 0 then d * d else 0 end) / sum(d * d), 6) as share_present from d group by unit")
def presence_absence_split(spark, sf_dir):
    weights = profiles.weighted(profiles.prevalence(*_members(spark, sf_dir)), profiles.TFIDF)
    return network.presence_absence(weights, A, B).select("unit", r6("share_present"))


@registered("with h as (select distinct doc_id, item_id from documents d join (select item_id, text as head from benchmark) on contains(d.text, head)) select source, count(*) as texts, count(*) filter (doc_id in (select doc_id from h)) as present, round(count(*) filter (doc_id in (select doc_id from h)) / count(*)::double, 6) as rate from documents group by source")
def web_presence_rates(spark, sf_dir):
    d = Testbed(spark, sf_dir).table("documents")
    hit = substring_match(spark, sf_dir).select("doc_id").distinct().withColumn("hit", F.lit(1))
    n = d.select("doc_id", "source").join(hit, "doc_id", "left").groupBy("source").agg(F.count("*").alias("texts"), F.count("hit").alias("present"))
    return n.withColumn("rate", F.round(F.col("present") / F.col("texts"), 6))


@registered(
    """select 'part' as "table", 'p_size in 1..50' as rule, count(*) filter (not coalesce(p_size between 1 and 50, true)) as violations from part
union all select 'orders', 'o_custkey references customer', count(*) from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer)
union all select 'orders', 'o_orderkey unique', coalesce(sum(n) filter (n > 1), 0)::bigint from (select count(*) as n from orders where o_orderkey is not null group by o_orderkey)
union all select 'documents', 'doc_id not null', count(*) from documents where doc_id is null
union all select 'events', 'event_type in list', count(*) from events where event_type not in ('click', 'view', 'purchase', 'signup')"""
)
def dq_violations(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    rules = [
        quality.check("part", "p_size in 1..50", F.col("p_size").between(1, 50)), quality.references("orders", "o_custkey", "customer", "c_custkey"), quality.unique("orders", "o_orderkey"),
        quality.not_null("documents", "doc_id"), quality.check("events", "event_type in list", F.col("event_type").isin("click", "view", "purchase", "signup")),
    ]
    return quality.violations({x: t.table(x) for x in ("part", "orders", "customer", "documents", "events")}, rules)


@registered("select l_orderkey, sum(case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end)::bigint as loss, count(*) filter (l_returnflag = 'R') as lost, count(*) filter (l_returnflag = 'A') as degraded from lineitem group by 1")
def fidelity_loss(spark, sf_dir):
    rows = Testbed(spark, sf_dir).table("lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "lost").when(F.col("l_returnflag") == "A", "degraded").otherwise("kept").alias("state"))
    return quality.fidelity(rows, "l_orderkey", "state")


@registered(
    """with old as (select o_orderkey, o_orderstatus, o_totalprice, 1 as seq from orders where o_totalprice < 300000), new as (select o_orderkey, 'N' as o_orderstatus, o_totalprice + 1 as o_totalprice, 2 as seq from orders where o_totalprice > 200000)
select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, coalesce(o.o_orderstatus, n.o_orderstatus) as o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) as o_totalprice from old o full join new n using (o_orderkey)"""
)
def upsert_merge(spark, sf_dir):
    """Only the price is updated where the key is there already."""
    o = Testbed(spark, sf_dir).table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_totalprice > 200000").select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return tables.upsert(o.where("o_totalprice < 300000"), new, ["o_orderkey"], ["o_totalprice"])
