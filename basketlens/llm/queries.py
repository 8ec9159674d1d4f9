"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import decontaminate, fm_dedup, language_id, maxent_lm, packing, prefix_free, quality_ranker, quality_rules, simhash, url_reputation

STOP_LIST = ", ".join(f"'{x}'" for x in sorted(set(quality_rules.STOP_WORDS)))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(of: int, remainder: int, key: str = "doc_id"):
    """True where crc32 of the key as text has this remainder; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % of == remainder, F.lit(False))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), 2048, 0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    ranker = quality_ranker.learn(docs, labels.where(~_held_out(4, 2)))
    return quality_ranker.score(docs, ranker).select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = maxent_lm.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), ~_held_out(7, 2))
    return scored.select("doc_id", _held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.learn(docs.select("doc_id", "text", "lang"), ~_held_out(5, 0))
    return language_id.predict(docs, model).select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    return judged.select("doc_id", *[F.col(f"rules_measures.{x}").alias(x) for x in m], "base_failed", "kept")


OP5_SQL = rf"""
with words as (
  select doc_id, rowid as r, coalesce(text, '') as t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from (select *, row_number() over () as rowid from documents)
),
grams as (
  select r, unnest(generate_series(1, len(w) - 2)) as p, w from words where len(w) >= 3
),
keyed as (select r, p, w[p] as a, w[p + 1] as b, w[p + 2] as c from grams),
twice as (select r, p, count(*) over (partition by r, a, b, c) as n from keyed),
covered as (
  select r, cast(sum(least(3, p - last)) as bigint) as n
  from (select r, p, coalesce(lag(p) over (partition by r order by p), p - 3) as last from twice where n >= 2)
  group by r
),
lined as (
  select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup
  from (select r, unnest(string_split(t, chr(10))) as line from words)
  where regexp_matches(line, '[^\x20\x09-\x0D]')
  group by r
),
counts as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(t) - length(regexp_replace(t, '{quality_rules.SYMBOLS}', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(n_dup, 0) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words,
         length(t) - length(replace(t, '!', '')) as n_bangs, coalesce(n_lines, 0) as n_lines,
         len(list_filter(w, lambda x: lower(x) in ({STOP_LIST}))) as n_stop
  from words left join covered using (r) left join lined using (r)
),
judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         coalesce(word_chars::double / nullif(n_words, 0), 0) as mean_chars,
         coalesce(n_symbols::double / nullif(n_words, 0), 0) as symbols,
         coalesce(n_bangs::double / nullif(n_words, 0), 0) as bangs,
         coalesce(n_stop::double / nullif(n_words, 0), 0) as stops,
         coalesce(n_dup_lines::double / nullif(n_lines, 0), 0) as dups
  from counts
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and mean_chars >= 2.0 and mean_chars <= 14.0 and symbols <= 0.1 and bangs <= 0.3
       and (stops >= 0.04 or symbols <= 0.03) and dups <= 0.4 as kept
from judged
"""

URL_RULES = url_reputation.rules_of([
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
])


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the document whose number its path carries."""
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    _, path = url_reputation.host_and_path("url")
    of = pages.select("page_id", F.regexp_extract(path, "^/[^/]*/([0-9]+)", 1).try_cast("bigint").alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = of.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
    return url_reputation.judge(pages, outcomes, URL_RULES)


_TWO = ", ".join(f"'{x}'" for x in url_reputation.TWO_LABEL_SUFFIXES)


def _moments(table: str, parent: str, name: str) -> str:
    m = parent
    return f"""{name} as (
  select (1 - rho) / rho as m from (
    select greatest(0.001, least(1.0 / 3, coalesce(case when most - chance <> 0 then (seen - chance) / (most - chance) end, 0.001)))::double as rho
    from (select sum(n * (k::double / n - {m}) * (k::double / n - {m})) as seen, sum({m} * (1 - {m})) as chance, sum(n * {m} * (1 - {m})) as most from {table} where n > 0)))"""


OP9_SQL = f"""
with parsed0 as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
),
parsed1 as (select page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) as h0 from parsed0),
parsed as (
  select page_id, translate(h0, '{url_reputation.UPPER}', '{url_reputation.LOWER}') as host,
         regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*', 0) as path
  from parsed1
),
outcomes as (
  select page_id, count(bad) as n, sum(bad) as k from (
    select page_id, case when quality = 0 or toxic = 1 then 1 when quality is not null or toxic is not null then 0 end as bad
    from parsed join labels on try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]+)', 1), '') as bigint) = doc_id)
  where bad is not null group by page_id
),
hosts0 as (select host, coalesce(sum(n), 0) as n, coalesce(sum(k), 0) as k from parsed left join outcomes using (page_id) group by host),
hosts1 as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare from hosts0),
hosts2 as (
  select *, array_to_string(list_slice(string_split(bare, '.'), -1, -1), '.') as l1, array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') as l2,
         array_to_string(list_slice(string_split(bare, '.'), -3, -1), '.') as l3, regexp_matches(bare, '^[0-9]+([.][0-9]+){{3}}$') as ip
  from hosts1
),
hosts as (
  select host, n, k, case when ip then bare when l2 in ({_TWO}) then l3 else l2 end as domain,
         case when ip then 'ip' when l2 in ({_TWO}) then l2 else l1 end as suffix
  from hosts2
),
domains as (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by all),
suffixes as (select suffix, sum(n) as n, sum(k) as k from domains group by all),
overall as (select coalesce(sum(k)::double / nullif(sum(n)::double, 0), 0.5) as mean0 from suffixes),
sx as (select * from suffixes, overall),
{_moments("sx", "mean0", "ms")},
s as (select suffix, (k + m * mean0) / (n + m) as mean_s from sx, ms),
dx as (select * from domains join s using (suffix)),
{_moments("dx", "mean_s", "md")},
d as (select domain, suffix, (k + m * mean_s) / (n + m) as mean_d from dx, md),
hx as (select * from hosts join d using (domain, suffix)),
{_moments("hx", "mean_d", "mh")},
h as (select host, k + m * mean_d as a, n - k + m * (1 - mean_d) as b from hx, mh),
bad as (select host from h where host <> '' and a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5),
ruled as (
  select page_id, host, path, case
{chr(10).join(f"    when (host = '{r.host}' or suffix(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.name}'" for r in sorted(URL_RULES, key=lambda r: -len(r.name)))}
  end as rule from parsed
)
select page_id, host, path, rule, case
  when rule in ({", ".join(f"'{r.name}'" for r in URL_RULES if r.verdict == "allow")}) then 'allow'
  when rule is not null then 'block'
  when host in (select host from bad) then 'block' else 'allow' end as verdict
from ruled
"""

def op6_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = fm_dedup.strip(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return left.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(simhash.fingerprints(_table(spark, sf_dir, "documents"), 4), 4)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = prefix_free.strip(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return left.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_lm_score": op4_lm_score,
    "op5_quality_rules": op5_quality_rules,
    "op6_fm_substring_dedup": op6_fm_substring_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLE_SQL = {
    "op5_quality_rules": OP5_SQL,
    "op9_url_filter": OP9_SQL,
}
