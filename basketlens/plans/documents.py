"""Queries on geography, figures, reports, streams and layout."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from basketlens.functions import text
from basketlens.operators import figures, geo, profiles, ranking, reports, similarity, views
from basketlens.plans.statistics import _clean, _members, r6
from basketlens.plans import mapping
from basketlens.plans.testbed import BASE_SQL, Testbed
from basketlens.session import shared_folder
from basketlens.streaming import ingest

QUERIES, ORACLE_SQL = {}, {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# The testbed gives each nation a point from its number.
_PLACES_SQL = "places as (select n_name as unit, 97 + n_nationkey * 0.4::double as lon, 6 + n_nationkey * 0.5::double as lat from nation)"


def _places(t):
    return t.table("nation").select(F.col("n_name").alias("unit"), (97 + F.col("n_nationkey") * 0.4).alias("lon"), (6 + F.col("n_nationkey") * 0.5).alias("lat"))


@registered(
    f"""with {_PLACES_SQL} select a.unit as a, b.unit as b, round(2 * {geo.EARTH_KM} * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) as km
from places a join places b on a.unit < b.unit"""
)
def place_distances(spark, sf_dir):
    p = _places(Testbed(spark, sf_dir))
    a, b = p.select(F.col("unit").alias("a"), F.col("lon").alias("x1"), F.col("lat").alias("y1")), p.select(F.col("unit").alias("b"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(geo.distance_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 3).alias("km"))


@registered(
    f"""with {BASE_SQL}, {_PLACES_SQL}, hit as (select province as unit, recipe_id, max(contains(canonical_id, 'Brand#1')::int) as ones, max(contains(canonical_id, 'ECONOMY')::int) as control from clean join facts using (recipe_id) group by all),
per as (select unit, avg(ones) as ones, avg(control) as control from hit group by unit)
select 'ones' as panel, unit, round(ones, 6) as share from per union all select 'control', unit, round(control, 6) from per"""
)
def prevalence_panels(spark, sf_dir):
    recipes, facts = _clean(spark, sf_dir)
    rows = recipes.select("recipe_id", F.col("province").alias("unit")).join(facts, "recipe_id").select("unit", "recipe_id", F.col("canonical_id").alias("name"))
    return figures.panels(rows, _places(Testbed(spark, sf_dir)), (100.5, 13.75), {"ones": "Brand#1", "control": "ECONOMY"}).select("panel", "unit", r6("share"))


@registered()
def heatmap_order(spark, sf_dir):
    weights = profiles.weighted(profiles.prevalence(*_members(spark, sf_dir)), profiles.TFIDF)
    one = weights.where("register = 'official'")
    names = figures.seriated(one, "unit", "canonical_id", "weight")
    return spark.createDataFrame(list(enumerate(names)), "place int, unit string")


@registered("select 'orders' as \"table\", count(*) as n_rows, 6 as n_columns from orders union all select 'part', count(*), 6 from part union all select 'documents', count(*), 5 from documents")
def status_report(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    return reports.status({x: t.table(x) for x in ("orders", "part", "documents")})


@registered("select source, count(*) as n, 'text' as field, count(*) filter (trim(text) <> '') as n_filled from documents group by source union all select source, count(*), 'lang', count(*) filter (trim(lang) <> '') from documents group by source")
def source_inventory(spark, sf_dir):
    return reports.inventory(Testbed(spark, sf_dir).table("documents"), "source", ["text", "lang"])


@registered("select cast(min(o_orderdate) as date) as first, cast(max(o_orderdate) as date) as last, count(o_orderdate) as parseable, count(*) as n from orders")
def order_dates(spark, sf_dir):
    return reports.date_range(Testbed(spark, sf_dir).table("orders"), "o_orderdate")


@registered("select n_name as unit, n, case when n >= 600 then 'yes' when n > 0 then 'partial' else 'no' end as ready from (select n_name, count(o_orderkey) as n from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by n_name)")
def readiness_by_unit(spark, sf_dir):
    t = Testbed(spark, sf_dir)
    o = t.table("customer").join(t.table("orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"))
    n = t.table("nation").join(o, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("unit"), F.coalesce("n", F.lit(0)).alias("n"))
    return n.withColumn("ready", reports.readiness(F.col("n"), F.lit(600), F.lit(False)))


@registered("select doc_id, source from documents qualify (row_number() over (partition by source order by doc_id) - 1) % 7 = 0 and row_number() over (partition by source order by doc_id) <= 35")
def stratified_sample(spark, sf_dir):
    return ranking.every_kth(Testbed(spark, sf_dir).table("documents").select("doc_id", "source"), ["source"], ["doc_id"], 7, 5)


@registered("select p_name, p_partkey from (select p_name, min(p_partkey) as p_partkey, count(distinct p_brand) as b from part group by p_name) where b = 1")
def unconflicted_names(spark, sf_dir):
    p = Testbed(spark, sf_dir).table("part").select("p_name", "p_brand", "p_partkey")
    return ranking.unconflicted(p, "p_name", "p_brand", ["p_partkey"]).select("p_name", "p_partkey")


@registered("select p_brand, n, row_number() over (order by n desc, p_brand) as rank, round(sum(n) over (order by n desc, p_brand) / sum(n) over ()::double, 6) as cum_share from (select p_brand, count(*) as n from part group by 1)")
def group_shares(spark, sf_dir):
    n = Testbed(spark, sf_dir).table("part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return ranking.ranked(n, "p_brand").select("p_brand", "n", F.col("rank").cast("long").alias("rank"), r6("cum_share"))


@registered("select region as unit, string_agg(distinct province, ' ' order by province) as codes from (select r_name as region, n_name as province from nation join region on n_regionkey = r_regionkey) group by 1")
def codes_by_region(spark, sf_dir):
    return Testbed(spark, sf_dir).places().groupBy(F.col("region").alias("unit")).agg(F.array_join(F.array_sort(F.collect_set("province")), " ").alias("codes"))


@registered("select event_id, cast(strftime(ts, '%Y-%m-%d') as date) as day from events")
def iso_dates(spark, sf_dir):
    return Testbed(spark, sf_dir).table("events").select("event_id", text.iso_date(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"))


_OWN_SQL = "own as (select recipe_id, region as of_province, case when recipe_id % 50 = 7 then 'ASIA' else region end as own_region from recipes)"


@registered(f"with {BASE_SQL}, {_OWN_SQL} select of_province as region, count(*) as n, count(*) filter (own_region <> of_province) as clashes from own group by 1")
def resolved_regions(spark, sf_dir):
    """The province's region, and where a recipe's own is another: every fiftieth recipe says ASIA."""
    t = Testbed(spark, sf_dir)
    own = t.recipes().withColumn("own_region", F.when(F.col("recipe_id") % 50 == 7, "ASIA").otherwise(F.col("region"))).drop("region")
    resolved, clash = views.resolve_region(own, t.places())
    n = clash.groupBy(F.col("of_province").alias("region")).agg(F.count("*").alias("clashes"))
    return resolved.groupBy("region").agg(F.count("*").alias("n")).join(n, "region", "left").fillna(0, ["clashes"])


@registered("select sha256(text) as content_hash, source from documents group by all")
def stream_ingest(spark, sf_dir):
    """The documents as a stream of files, each (source, content) once."""
    t = Testbed(spark, sf_dir)
    schema = t.table("documents").schema
    stream = ingest.read(spark, f"{sf_dir}/documents*.parquet", schema)
    stream = stream.withColumn("content_hash", F.sha2("text", 256)).select("content_hash", "source")
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ingest.start_keyed(stream, f"{out}/out", f"{out}/state", ["content_hash", "source"]).awaitTermination()
    return spark.read.parquet(f"{out}/out")


@registered("select event_type, date_trunc('hour', ts) as start, count(*) as n from events group by all")
def windowed_events(spark, sf_dir):
    """Counts by hour and type over the events as a stream."""
    stream = ingest.read(spark, f"{sf_dir}/events*.parquet", Testbed(spark, sf_dir).table("events").schema)
    name = f"windowed_{uuid.uuid4().hex}"
    counts = ingest.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{shared_folder(spark)}/{name}").start().awaitTermination()
    return spark.table(name).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@registered()
def near_names(spark, sf_dir):
    """Strings that the vocabulary has no entry for, near those it maps."""
    names = Testbed(spark, sf_dir).table("part").select(F.col("p_name").alias("key")).distinct()
    mapped = mapping._entries(Testbed(spark, sf_dir)).select("key")
    return similarity.near_strings(names.join(mapped, "key", "left_anti"), names.join(mapped, "key", "left_semi"), 0.7)
