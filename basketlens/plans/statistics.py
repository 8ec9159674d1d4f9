"""Queries on views, profiles, distances and their inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.operators import inference, profiles, ranking, views
from basketlens.plans.testbed import BASE_SQL, Testbed

A, B, REPS = "official", "commercial", 20
QUERIES, ORACLE_SQL = {}, {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(name: str):
    return F.round(name, 6).alias(name)


def _clean(spark: SparkSession, sf_dir: str, by_recipe: bool = False):
    t = Testbed(spark, sf_dir)
    facts = t.facts(by_recipe)
    return views.clean(t.recipes(), facts), facts


def _members(spark: SparkSession, sf_dir: str, unit: str = "region", by_recipe: bool = False):
    recipes, facts = _clean(spark, sf_dir, by_recipe)
    return profiles.members_of(recipes, unit), facts


MEMBERS_SQL = f"""with {BASE_SQL},
members as (select register, region as unit, recipe_id, 1::bigint as mult from clean where region is not null)"""
VIEW = "recipe_id, register, source_id, province, region, confidence, tier, n_ingredients"


@registered(f"with {BASE_SQL} select {VIEW} from clean")
def clean_view(spark, sf_dir):
    return _clean(spark, sf_dir)[0].select(*VIEW.split(", "))


@registered(f"with {BASE_SQL} select {VIEW} from recipes join sized using (recipe_id) where confidence = 'low' and n_ingredients between 3 and 25")
def low_confidence_view(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    return views.clean(t.recipes(), t.facts(), ("low",)).select(*VIEW.split(", "))


def _distance(weighting):
    def run(spark, sf_dir):
        return profiles.register_distances(*_members(spark, sf_dir), weighting, A, B).select("unit", "n_left", "n_right", r6("distance"))

    return run


for _w in (profiles.TFIDF, profiles.PREVALENCE):
    QUERIES[f"register_distance_{_w}"] = _distance(_w)
    ORACLE_SQL[f"register_distance_{_w}"] = f"{MEMBERS_SQL}, {profiles.distances_sql('members', _w)} select unit, n_left, n_right, round(distance, 6) as distance from dist"


@registered(
    f"""with {BASE_SQL},
sources as (select distinct source_id from clean where register = '{B}'),
members as (
  select 'pooled' as scope, register, region as unit, recipe_id, 1::bigint as mult from clean
  union all
  select s.source_id, case when register = '{B}' then register || ':' || c.source_id else register end, region, recipe_id, 1 from clean c, sources s
),
{profiles.distances_sql("members", profiles.TFIDF, "scope")},
named as (
  select scope, register, unit, canonical_id, n_recipes, case when scope <> 'pooled' and register = '{B}:' || scope then '{B}' else register end as side, weight from dist_w
),
sums as (
  select scope, unit, sum(a * b) as dot, sum(a * a) as aa, sum(b * b) as bb from (
    select scope, unit, canonical_id, sum(weight) filter (side = '{A}') as a, sum(weight) filter (side = '{B}') as b from named where side in ('{A}', '{B}') group by all) group by all
),
counts as (
  select scope, unit, coalesce(max(n_recipes) filter (side = '{A}'), 0) as n_left, coalesce(max(n_recipes) filter (side = '{B}'), 0) as n_right from named group by all
)
select scope, unit, n_left, n_right, round(case when n_left > 0 and n_right > 0 and aa > 0 and bb > 0 then 1 - coalesce(dot, 0) / (sqrt(aa) * sqrt(bb)) end, 6) as distance
from counts left join sums using (scope, unit)"""
)
def register_distance_per_source(spark, sf_dir):
    recipes, facts = _clean(spark, sf_dir)
    sources = recipes.where(F.col("register") == B).select(F.col("source_id").alias("scope")).distinct()
    split = views.by_source(recipes, B).crossJoin(F.broadcast(sources))  # as many rows as sources: a handful
    name = F.when(F.col("register") == F.concat_ws(":", F.lit(B), "scope"), B).otherwise(F.col("register"))
    columns = ["scope", "register", F.col("region").alias("unit"), "recipe_id", F.lit(1).cast("bigint").alias("mult")]
    members = recipes.withColumn("scope", F.lit("pooled")).select(*columns).unionByName(split.select(*columns))
    weights = profiles.weighted(profiles.prevalence(members, facts, ["scope"]), profiles.TFIDF, ["scope"]).withColumn("register", name)
    return profiles.distances(weights, A, B, ["scope"]).select("scope", "unit", "n_left", "n_right", r6("distance"))


_TRIANGLE = [("official", "commercial"), ("official", "domestic"), ("commercial", "domestic")]


@registered(
    MEMBERS_SQL
    + "".join(f", {profiles.distances_sql('members', profiles.TFIDF, '', a, b, f'd{i}')}" for i, (a, b) in enumerate(_TRIANGLE))
    + " union all ".join(f" select '{a}-{b}' as pair, unit, n_left, n_right, round(distance, 6) as distance from d{i}" for i, (a, b) in enumerate(_TRIANGLE))
)
def register_triangle(spark, sf_dir):
    weights = profiles.weighted(profiles.prevalence(*_members(spark, sf_dir)), profiles.TFIDF)
    out = None
    for a, b in _TRIANGLE:
        one = profiles.distances(weights, a, b).select(F.lit(f"{a}-{b}").alias("pair"), "unit", "n_left", "n_right", r6("distance"))
        out = one if out is None else out.unionByName(one)
    return out


@registered(f"{MEMBERS_SQL}, {profiles.distances_sql('members', profiles.TFIDF)} select register, unit, canonical_id, n_recipes, round(prevalence, 6) as prevalence, round(weight, 6) as weight from dist_w")
def profile_vectors(spark, sf_dir):
    weights = profiles.weighted(profiles.prevalence(*_members(spark, sf_dir)), profiles.TFIDF)
    return weights.select("register", "unit", "canonical_id", "n_recipes", r6("prevalence"), r6("weight"))


@registered(f"{MEMBERS_SQL}, {profiles.distances_sql('members', profiles.TFIDF)} select canonical_id, df from dist_d")
def document_frequency(spark, sf_dir):
    return profiles.document_frequency(profiles.prevalence(*_members(spark, sf_dir))).select("canonical_id", "df")


def _entries(t: Testbed) -> DataFrame:
    """Vocabulary of the testbed: an entry is trusted where it has an even-sized part."""
    part = t.table("part").select(F.concat_ws("/", "p_brand", "p_type").alias("canonical_id"), "p_size")
    by = part.groupBy("canonical_id").agg(F.min(F.pmod("p_size", F.lit(2))).alias("odd"), F.min("p_size").alias("size"))
    return by.select("canonical_id", F.when((F.col("odd") == 0) & (F.col("size") > 1), "hand").otherwise("drafted").alias("drafted_by"), F.lit(None).cast("date").alias("reviewed_at"))


TRUSTED_SQL = """trusted as (
  select canonical_id from (select p_brand || '/' || p_type as canonical_id, min(p_size % 2) as odd, min(p_size) as size from part group by 1) where odd = 0 and size > 1
),
kept as (select facts.* from facts semi join trusted using (canonical_id)),
restricted as (
  select r.*, n from clean r join (select recipe_id, count(*) as n from kept group by 1 having count(*) between 3 and 25) using (recipe_id)
)"""


@registered(f"with {BASE_SQL}, {TRUSTED_SQL} select recipe_id, register, region, n as n_ingredients from restricted")
def trusted_restriction(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    recipes, facts = _clean(spark, sf_dir)
    return views.restricted(recipes, facts, views.trusted(_entries(t)))[0].select("recipe_id", "register", "region", "n_ingredients")


@registered(f"with {BASE_SQL}, {TRUSTED_SQL} select register, count(*) as qualifying_all, (select count(*) from restricted r where r.register = c.register) as qualifying_trusted from clean c group by register")
def qualifying_counts(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    recipes, facts = _clean(spark, sf_dir)
    n = views.restricted(recipes, facts, views.trusted(_entries(t)))[0].groupBy("register").agg(F.count("*").alias("qualifying_trusted"))
    return recipes.groupBy("register").agg(F.count("*").alias("qualifying_all")).join(n, "register", "left").fillna(0, ["qualifying_trusted"])


@registered(
    f"""with {BASE_SQL}, members as (select register, region as unit, recipe_id, 1::bigint as mult from clean where recipe_id not in (select o_orderkey from orders where o_totalprice > 450000)),
{profiles.distances_sql("members", profiles.TFIDF)} select unit, n_left, n_right, round(distance, 6) as distance from dist"""
)
def excluded_recipes_sensitivity(spark, sf_dir):
    recipes, facts = _clean(spark, sf_dir)
    listed = Testbed(spark, sf_dir).table("orders").where("o_totalprice > 450000").select(F.col("o_orderkey").alias("recipe_id"))  # stands for a reviewed list
    return profiles.register_distances(profiles.members_of(views.excluding(recipes, listed), "region"), facts, profiles.TFIDF, A, B).select("unit", "n_left", "n_right", r6("distance"))


@registered(
    f"""with {BASE_SQL}, enough as (select province from clean where register = '{B}' group by province having count(*) >= 80),
members as (select register, province as unit, recipe_id, 1::bigint as mult from clean where register <> '{B}' or province in (select province from enough)),
{profiles.distances_sql("members", profiles.TFIDF)} select unit, n_left, n_right, round(distance, 6) as distance from dist"""
)
def one_register_threshold(spark, sf_dir):
    recipes, facts = _clean(spark, sf_dir)
    kept = views.threshold_on(recipes, B, "province", 80)
    return profiles.register_distances(profiles.members_of(kept, "province"), facts, profiles.TFIDF, A, B).select("unit", "n_left", "n_right", r6("distance"))


BOOT_SQL = f"""ranked as (select register, unit, recipe_id, row_number() over (partition by register, unit order by recipe_id) - 1 as place from members),
sizes as (select register, unit, count(*) as size from ranked group by all),
picks as (
  select rep, register, unit, {inference.draw_sql("boot", "rep", "register", "unit", "i")} % size as place
  from (select *, unnest(generate_series(0, size - 1)) as i from (select *, unnest(generate_series(1, {REPS})) as rep from sizes))
),
boot as (select rep, register, unit, recipe_id, count(*)::bigint as mult from picks join ranked using (register, unit, place) group by all),
{profiles.distances_sql("boot", profiles.TFIDF, "rep", name="bd")},
{profiles.distances_sql("members", profiles.TFIDF)}"""


def _boot(spark, sf_dir):
    members, facts = _members(spark, sf_dir)
    observed = profiles.register_distances(members, facts, profiles.TFIDF, A, B)
    return observed, inference.replicated(lambda last, first: inference.bootstrap(members, last, first), facts, REPS, profiles.TFIDF, A, B)


@registered(f"{MEMBERS_SQL}, {BOOT_SQL} select rep, unit, round(distance, 6) as distance from bd")
def bootstrap_draws(spark, sf_dir):
    return _boot(spark, sf_dir)[1].select("rep", "unit", r6("distance"))


@registered(
    f"""{MEMBERS_SQL}, {BOOT_SQL}, st as (
  select unit, count(distance) as n_draws, avg(distance) as mean, stddev_samp(distance) as se, quantile_cont(distance, 0.025::double) as lo, quantile_cont(distance, 0.975::double) as hi
  from bd where distance is not null group by unit)
select st.unit, n_draws, round(distance, 6) as distance, round(mean, 6) as mean, round(se, 6) as se, round(lo, 6) as lo, round(hi, 6) as hi, round(mean - distance, 6) as bias,
  (select (count(*) filter (b.distance < dist.distance) + 0.5 * count(*) filter (b.distance = dist.distance)) / count(*)::double from bd b where b.unit = st.unit and b.distance is not null) as share,
  distance < lo or distance > hi as outside
from st join dist using (unit)"""
)
def bootstrap_intervals(spark, sf_dir):
    e = inference.evidence(*_boot(spark, sf_dir))
    return e.select("unit", "n_draws", *[r6(x) for x in ("distance", "mean", "se", "lo", "hi", "bias")], F.col("share").cast("double").alias("share"), "outside")


@registered()
def bias_corrected_interval(spark, sf_dir):
    return inference.bias_corrected_intervals(*_boot(spark, sf_dir)).select("unit", r6("bc_lo"), r6("bc_hi"))


def _permuted(kind: str):
    def run(spark, sf_dir):
        members, facts = _members(spark, sf_dir)
        moved = {"register": lambda last, first: inference.permute_registers(members, A, B, last, first), "unit": lambda last, first: inference.permute_units(members, last, first)}
        null = inference.replicated(moved[kind], facts, REPS, profiles.TFIDF, A, B)
        observed = profiles.register_distances(members, facts, profiles.TFIDF, A, B)
        return inference.p_values(observed, null).select("unit", r6("p"))

    return run


PERMUTED_SQL = {
    "register": f"""drawn as (
  select rep, unit, recipe_id, row_number() over (partition by rep, unit order by h, recipe_id) as place,
         (select count(*) from members m where m.unit = x.unit and m.register = '{A}') as n_left
  from (select rep, unit, recipe_id, {inference.draw_sql("register", "rep", "recipe_id")} as h
        from (select *, unnest(generate_series(1, {REPS})) as rep from members where register in ('{A}', '{B}'))) x
),
moved as (
  select rep, case when place <= n_left then '{A}' else '{B}' end as register, unit, recipe_id, 1::bigint as mult from drawn
  union all
  select rep, register, unit, recipe_id, mult from (select *, unnest(generate_series(1, {REPS})) as rep from members where register not in ('{A}', '{B}'))
)""",
    "unit": f"""spans as (select register, unit, sum(size) over (partition by register order by unit) as hi, size from (select register, unit, count(*) as size from members group by all)),
drawn as (
  select rep, register, recipe_id, row_number() over (partition by rep, register order by h, recipe_id) as place
  from (select rep, register, recipe_id, {inference.draw_sql("unit", "rep", "recipe_id")} as h from (select *, unnest(generate_series(1, {REPS})) as rep from members))
),
moved as (
  select rep, d.register, unit, recipe_id, 1::bigint as mult from drawn d join spans s on d.register = s.register and place > hi - size and place <= hi
)""",
}
P_SQL = """p_values as (
  select unit, (1 + count(*) filter (n.distance >= o.distance - 1e-12)) / (1 + count(*))::double as p
  from nd n join dist o using (unit) where n.distance is not null and o.distance is not null group by unit
)"""
for _k, _s in PERMUTED_SQL.items():
    QUERIES[f"permute_{_k}"] = _permuted(_k)
    ORACLE_SQL[f"permute_{_k}"] = f"{MEMBERS_SQL}, {_s}, {profiles.distances_sql('moved', profiles.TFIDF, 'rep', name='nd')}, {profiles.distances_sql('members', profiles.TFIDF)}, {P_SQL} select unit, round(p, 6) as p from p_values"


@registered(
    f"""{MEMBERS_SQL}, {PERMUTED_SQL["register"]}, {profiles.distances_sql("moved", profiles.TFIDF, "rep", name="nd")}, {profiles.distances_sql("members", profiles.TFIDF)}, {P_SQL}
select unit, round(p, 6) as p, round(least(1, max((m - rk + 1) * p) over (order by rk)), 6) as p_holm
from (select unit, p, row_number() over (order by p, unit) as rk, count(*) over () as m from p_values)"""
)
def holm_adjusted(spark, sf_dir):
    members, facts = _members(spark, sf_dir)
    null = inference.replicated(lambda last, first: inference.permute_registers(members, A, B, last, first), facts, REPS, profiles.TFIDF, A, B)
    p = inference.p_values(profiles.register_distances(members, facts, profiles.TFIDF, A, B), null)
    return inference.holm(p.withColumn("family", F.lit("register")), ["family"], "unit").select("unit", r6("p"), r6("p_holm"))


@registered()
def rq_result_table(spark, sf_dir):
    """Both weightings: distance, interval, and both nulls' p-values with Holm adjustment."""
    members, facts = _members(spark, sf_dir)
    kinds = {"boot": inference.bootstrap(members, REPS), "register": inference.permute_registers(members, A, B, REPS), "unit": inference.permute_units(members, REPS)}
    every = members.withColumn("kind", F.lit("observed")).withColumn("rep", F.lit(0))
    for kind, moved in kinds.items():
        every = every.unionByName(moved.withColumn("kind", F.lit(kind)))
    base = profiles.prevalence(every, facts, ["kind", "rep"]).persist()
    out = None
    for w in (profiles.TFIDF, profiles.PREVALENCE):
        far = profiles.distances(profiles.weighted(base, w, ["kind", "rep"]), A, B, ["kind", "rep"]).persist()  # a row per unit and replicate
        observed = far.where("kind = 'observed'").drop("kind", "rep")
        e = inference.evidence(observed, far.where("kind = 'boot'"))
        row = e.select("unit", "n_left", "n_right", "distance", "lo", "hi", F.col("outside").alias("obs_outside_ci"))
        for kind in ("register", "unit"):
            p = inference.p_values(observed, far.where(F.col("kind") == kind)).withColumn("f", F.lit(kind))
            row = row.join(inference.holm(p, ["f"], "unit").select("unit", F.col("p").alias(f"p_{kind}"), F.col("p_holm").alias(f"p_holm_{kind}")), "unit", "left")
        row = row.withColumn("weighting", F.lit(w)).withColumn("below_min_n", F.col("n_right") < 5)
        out = row if out is None else out.unionByName(row)
    return out


JACK_SQL = f"""w as (select register, unit, canonical_id, n_recipes as n, round(prevalence * n_recipes) as h, df, groups as g, prevalence as p, weight as w from dist_w join dist_d using (canonical_id), dist_g where register in ('{A}', '{B}')),
pair as (select a.*, coalesce(b.p, 0) as po, coalesce(b.w, 0) as wo from w a left join w b on a.unit = b.unit and a.canonical_id = b.canonical_id and a.register <> b.register),
sums0 as (select register, unit, max(n) as n, sum(w * w) as ss, sum(w * wo) as dot from pair group by all),
sums as (select a.*, b.ss as oo, b.n as no from sums0 a join sums0 b on a.unit = b.unit and a.register <> b.register where a.n >= 2),
moved as (
  select recipe_id as left_out, m.register, m.unit, w, wo, s.n / (s.n - 1)::double as f,
    case when h = 1 then 0 else (h - 1) / (s.n - 1) * (ln((1 + g) / (1 + df)::double) + 1) end as now, case when h = 1 then po * (ln((1 + g) / df::double) + 1) else wo end as onow
  from members m join facts using (recipe_id) join pair p on p.register = m.register and p.unit = m.unit and p.canonical_id = facts.canonical_id join sums s on s.register = m.register and s.unit = m.unit
),
steps as (select left_out, register, unit, any_value(f) as f, sum(now * onow - f * w * wo) as dd, sum(now * now - f * f * w * w) as ds, sum(onow * onow - wo * wo) as dof from moved group by left_out, register, unit)
select left_out, unit, case when register = '{A}' then n - 1 else no end as n_left, case when register = '{A}' then no else n - 1 end as n_right,
  round(1 - (f * dot + dd) / (sqrt(f * f * ss + ds) * sqrt(oo + dof)), 6) as distance from steps join sums using (register, unit)"""


@registered(f"{MEMBERS_SQL}, {profiles.distances_sql('members', profiles.TFIDF)}, {JACK_SQL}")
def jackknife_distances(spark, sf_dir):
    return inference.jackknife(*_members(spark, sf_dir, by_recipe=True), A, B).select("left_out", "unit", "n_left", "n_right", r6("distance"))


@registered()
def bca_interval(spark, sf_dir):
    members, facts = _members(spark, sf_dir)
    a = inference.acceleration(inference.jackknife(members, facts, A, B))
    return inference.bias_corrected_intervals(*_boot(spark, sf_dir), acceleration=a)


@registered()
def bootstrap_kernel(spark, sf_dir):
    recipes, facts = _clean(spark, sf_dir)
    return inference.bootstrap_kernel(views.fact_rows(recipes, facts, "region"), profiles.TFIDF, 40, A, B)


@registered(
    f"""with {BASE_SQL}, n as (select register, province, count(*) as n from clean group by all), t as (select unnest(generate_series(5, 30)) as threshold)
select threshold, register, count(*) filter (n >= threshold) as n_units from t, n group by all"""
)
def eligibility_sweep(spark, sf_dir):
    return ranking.sweep(_clean(spark, sf_dir)[0].groupBy("register", "province").agg(F.count("*").alias("n")), ["register"], 5, 30)


@registered(
    f"""with {BASE_SQL}, n as (select register, province, count(*) as n from clean group by all), t as (select unnest([10, 15, 25]) as threshold)
select threshold, register, count(*) filter (n >= threshold) as n_units, 'n = ' || count(*) filter (n >= threshold) || ' of 25 provinces' as caption from t, n group by all"""
)
def eligibility_headline(spark, sf_dir):
    n = _clean(spark, sf_dir)[0].groupBy("register", "province").agg(F.count("*").alias("n"))
    s = ranking.sweep(n, ["register"], 5, 30).where(F.col("threshold").isin(10, 15, 25))
    return s.withColumn("caption", F.format_string("n = %d of 25 provinces", "n_units"))


@registered(
    f"""with {BASE_SQL}, per as (select province, source_id, count(*) as n from recipes group by all)
select province, sum(n)::bigint as recipe_count, (select count(*) from recipes r where r.province = p.province and tier < 4) as labelled_count,
  round((select count(*) from recipes r where r.province = p.province and tier < 4) / sum(n)::double, 6) as labelled_fraction,
  (select source_id from per q where q.province = p.province order by n desc, source_id limit 1) as top_source_id,
  round(max(n) / sum(n)::double, 6) as top_source_share, count(*) as distinct_sources
from per p group by province"""
)
def coverage_by_unit(spark, sf_dir):
    c = ranking.coverage(Testbed(spark, sf_dir).recipes(), "province", "source_id", F.col("tier") < 4)
    return c.select("province", "recipe_count", "labelled_count", r6("labelled_fraction"), "top_source_id", r6("top_source_share"), "distinct_sources")


@registered("select n_name as province from nation where n_nationkey not in (select c_nationkey from orders join customer on o_custkey = c_custkey where o_totalprice > 499000)")
def missing_units(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    o, c = t.table("orders").where("o_totalprice > 499000"), t.table("customer")
    seen = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("n_nationkey"))
    return t.table("nation").join(seen, "n_nationkey", "left_anti").select(F.col("n_name").alias("province"))


@registered("select a.r_name as a, b.r_name as b from region a join region b on a.r_name < b.r_name")
def theta_unit_pairs(spark, sf_dir):
    r = Testbed(spark, sf_dir).table("region")
    return ranking.unordered_pairs(r, "r_name")


@registered(
    f"""{MEMBERS_SQL}, {profiles.distances_sql("members", profiles.TFIDF)}, g as (select distinct register, unit from dist_w),
v as (select canonical_id, (sum(weight * weight) - sum(weight) * sum(weight) / (select count(*) from g)) / (select count(*) from g) as variance from dist_w group by 1)
select canonical_id, round(variance, 6) as variance, row_number() over (order by round(variance, 12) desc, canonical_id) as rank from v qualify rank <= 60"""
)
def top_variance_ingredients(spark, sf_dir):
    weights = profiles.weighted(profiles.prevalence(*_members(spark, sf_dir)), profiles.TFIDF)
    return ranking.top_variance(weights, 60).select("canonical_id", r6("variance"), F.col("rank").cast("long").alias("rank"))


@registered(
    f"""{MEMBERS_SQL}, {profiles.distances_sql("members", profiles.TFIDF)}, g as (select distinct register, unit from dist_w), i as (select canonical_id from dist_w group by 1 order by count(*) desc, 1 limit 30)
select g.register, g.unit, i.canonical_id, round(coalesce(w.weight, 0), 6) as weight from g cross join i left join dist_w w on w.register = g.register and w.unit = g.unit and w.canonical_id = i.canonical_id"""
)
def heatmap_grid(spark, sf_dir):
    weights = profiles.weighted(profiles.prevalence(*_members(spark, sf_dir)), profiles.TFIDF)
    top = profiles.document_frequency(weights).orderBy(F.desc("df"), "canonical_id").limit(30).select("canonical_id")
    return ranking.grid(weights, top).select("register", "unit", "canonical_id", r6("weight"))
