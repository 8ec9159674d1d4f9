"""Queries on strings, privacy, pages and layout whose inputs are made from columns, so that SQL knows the answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketlens.functions import layout, pages, privacy, text, thai
from basketlens.operators import similarity
from basketlens.plans.testbed import Testbed
from basketlens.sources import conduct, tables

QUERIES, ORACLE_SQL = {}, {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _part(spark, sf_dir):
    return Testbed(spark, sf_dir).table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def _by(*cases: Column) -> Column:
    """The case whose number is the part's, modulo their count."""
    out = None
    for i, c in enumerate(cases):
        hit = F.col("p_partkey") % len(cases) == i
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return out


def _f(pattern: str, *columns: str) -> Column:
    return F.format_string(pattern, *columns)


@registered(
    """select p_partkey, p_name || case p_partkey % 5 when 4 then ' (หั่น)' else '' end as name, p_name as suggestion,
  case p_partkey % 5 when 1 then p_size || '/4' when 3 then null else p_size::varchar end as value, case p_partkey % 5 when 0 then 'กรัม' when 1 then 'ช้อนชา' when 4 then 'ถ้วย' end as unit from part"""
)
def strip_quantity(spark, sf_dir):
    """Amounts in five ways of writing them."""
    raw = _by(_f("• %s %d กรัม", "p_name", "p_size"), _f("%s %d/4 ช้อนชา", "p_name", "p_size"), _f("%s ประมาณ %d-99 ลูก", "p_name", "p_size"), _f("%s ตามชอบ", "p_name"), _f("%s (หั่น) %d ถ้วย +", "p_name", "p_size"))
    p = _part(spark, sf_dir).select("p_partkey", raw.alias("raw"))
    q = text.first_quantity(F.col("raw"))
    return p.select("p_partkey", text.strip_quantity(F.col("raw")).alias("name"), text.suggestion_key(F.col("raw")).alias("suggestion"), q["value"].alias("value"), q["unit"].alias("unit"))


@registered("select p_partkey, case p_partkey % 4 when 0 then p_type || '|' || p_brand when 1 then '' when 2 then p_brand || '|' || p_type else 'ข่า|ตะไคร้' end as parts from part")
def multi_parts(spark, sf_dir):
    group = _by(_f("%s หรือ %s", "p_type", "p_brand"), F.col("p_name"), _f("%s, %s+%s", "p_brand", "p_type", "p_brand"), F.lit("ข่า ตะไคร้สับ"))
    return _part(spark, sf_dir).select("p_partkey", F.array_join(text.multi_parts(group), "|").alias("parts"))


@registered(
    r"""select p_partkey, 'repair' as what, p_name || chr(3656) || case p_partkey % 2 when 0 then '' else chr(63472) end as value, 1::bigint as n, (p_partkey % 2)::bigint as left_over from part
union all select p_partkey, 'join', 'ก' || chr(3656) || p_name || ' ก' || chr(3656), 2, 0 from part"""
)
def mark_repairs(spark, sf_dir):
    p = _part(spark, sf_dir)
    fixed = text.repair_private_use(F.concat("p_name", F.lit("\uf70a"), _by(F.lit(""), F.lit("\uf7f0"))))
    joined = text.join_orphan_marks(F.concat(F.lit("ก ่"), F.col("p_name"), F.lit(" ก  ่")))
    a = p.select("p_partkey", F.lit("repair").alias("what"), fixed["text"].alias("value"), fixed["mapped"].cast("long").alias("n"), fixed["residue"].cast("long").alias("left_over"))
    return a.unionByName(p.select("p_partkey", F.lit("join").alias("what"), joined["text"].alias("value"), joined["n"].cast("long").alias("n"), F.lit(0).cast("long").alias("left_over")))


@registered(
    r"""select p_partkey, p_name || ' ' || p_brand || chr(10) || chr(10) || p_type as lines, p_partkey::varchar as digits, case p_partkey % 3 when 2 then null else p_name end as leaders, p_name || ' ' || chr(233) as line,
  p_name as unmarked, 7 + 3 * p_size <= 80 as heading, case p_partkey % 2 when 0 then '' else p_name || ' x' end as coding, replace(p_name, ' ', '') || 'ab' as name_key, case p_partkey % 2 when 0 then p_brand else p_name end as gloss from part"""
)
def small_cleaners(spark, sf_dir):
    """Digits, leaders, markers, headings, and keys: one column for each."""
    name = F.col("p_name")
    return _part(spark, sf_dir).select(
        "p_partkey",
        text.collapse_lines(F.concat("p_name", F.lit(" \t  "), "p_brand", F.lit("\n\n\n\n"), "p_type")).alias("lines"),
        text.arabic_digits(F.translate(F.col("p_partkey").cast("string"), "0123456789", "๐๑๒๓๔๕๖๗๘๙")).alias("digits"),
        text.strip_leaders(_by(F.concat(F.lit(".... "), name, F.lit("__-")), F.concat(F.lit("…"), name), F.lit(" ...."))).alias("leaders"),
        text.clean_line(F.concat(F.lit("\u200b"), name, F.lit("   e\u0301 "))).alias("line"),
        text.strip_marker(F.concat(_by(F.lit("• "), F.lit("1. "), F.lit("(2) "), F.lit("๓)"), F.lit("")), name)).alias("unmarked"),
        text.is_heading(F.concat(F.lit("ส่วนผสม"), F.expr("repeat('xyz', p_size)"))).alias("heading"),
        text.coding_key(_by(F.lit(None).cast("string"), F.concat(F.lit(" \t"), name, F.lit("\n\n x ")))).alias("coding"),
        text.name_key(F.concat(name, F.lit(" -A-B"))).alias("name_key"),
        text.gloss(_by(F.lit("  "), name), F.col("p_brand")).alias("gloss"),
    )


@registered(
    """select p_partkey, p_brand || '; ' || p_type || '~' || p_name as by_lines, p_brand || '~' || p_type || '~' || p_name as by_delimiters, p_brand || '~' || p_type || '~' || replace(p_name, ' ', '~') as by_words,
  'It says LICENSE here.' || case p_partkey % 2 when 0 then '' else '~' || left('no terms ' || repeat('ab', 150), 200) end as quotes, round(1000 / (p_size + 1)::double, 2) as orphans, round(1000 / (p_size + 2)::double, 2) as split_vowels from part"""
)
def splits_quotes_and_defects(spark, sf_dir):
    listing = F.concat("p_brand", F.lit("; "), "p_type", F.lit("\n"), "p_name")
    said = F.concat("p_name", F.lit(" is so. It says LICENSE here.\nBye! "), _by(F.lit(""), F.concat(F.lit("no terms "), F.lit("ab" * 150))))
    orphans = text.defect_rates(F.concat(F.expr("repeat('ก', p_size)"), F.lit(" ่")))["orphans"]
    vowels = text.defect_rates(F.concat(F.expr("repeat('ก', p_size)"), F.lit("ก า ")))["split_vowels"]
    return _part(spark, sf_dir).select(
        "p_partkey", *[F.array_join(text.split_list(listing, how), "~").alias(f"by_{how}") for how in ("lines", "delimiters", "words")],
        F.array_join(text.quotes(said, ["license", "terms"]), "~").alias("quotes"), orphans.alias("orphans"), vowels.alias("split_vowels"),
    )


@registered(
    """select p_partkey, p_name || case p_partkey % 3 when 0 then ' ทำ' when 1 then ' ขา' else ' ผ า' end as repaired, (p_partkey % 3 = 0)::bigint as am, (p_partkey % 3 = 1)::bigint as joined, (p_partkey % 3 = 2)::bigint as ambiguous,
  'หมู~' || replace(p_name, ' ', '~') as tokens, 4::bigint as n_words from part"""
)
def segmented_text(spark, sf_dir):
    """Repairs and tokens over a segmenter of four words."""
    words = ("ทำ", "ขา", "หมู", "กรัม")
    p = _part(spark, sf_dir).select("p_partkey", "p_name", thai.repaired(F.concat("p_name", _by(F.lit(" ท า"), F.lit(" ข า"), F.lit(" ผ า"))), words).alias("r"))
    tokens = thai.line_tokens(F.concat(F.lit("หมู(สับ) 3 กรัม* "), F.col("p_name")), words)
    counted = thai.words_in(F.concat(F.lit("หมูขา "), F.col("p_name")), words)
    return p.select("p_partkey", F.col("r.text").alias("repaired"), *[F.col(f"r.{x}").cast("long").alias(x) for x in ("am", "joined", "ambiguous")], F.array_join(tokens, "~").alias("tokens"), counted.cast("long").alias("n_words"))


_PERSONAL = (
    ("phone", "โทร 081-234-%04d", "โทร [REDACTED]"),
    ("email", "to a.b%d@mail.example.com", "to [REDACTED]"),
    ("name", "นายสมชาย no %d", "[REDACTED] no "),
    ("address", "เลขที่ %d/2", "เลขที่ [REDACTED]"),
    ("coordinates", "at 13.75%d1, 100.501%d", "at [REDACTED]"),
    ("media_link", "https://x.example/%d", "[REDACTED]"),
    ("clean", "นายอำเภอ %d", "นายอำเภอ "),
)
_PERSONAL_SQL = "case p_partkey % 7 " + " ".join(f"when {i} then '{y}'" + (" || p_partkey" if c in ("name", "clean") else "") for i, (c, _, y) in enumerate(_PERSONAL)) + " end"
_CLASS_SQL = "case p_partkey % 7 " + " ".join(f"when {i} then '{c}'" for i, (c, _, _) in enumerate(_PERSONAL)) + " end"


def _personal(spark, sf_dir):
    said = _by(*[F.format_string(x, *[(F.col("p_partkey") % 10000).cast("int") if c == "phone" else F.col("p_partkey")] * x.count("%")) for c, x, _ in _PERSONAL])
    return _part(spark, sf_dir).select("p_partkey", F.concat("p_name", F.lit(" "), said).alias("said"))


@registered(f"select p_partkey, p_name || ' ' || {_PERSONAL_SQL} as clean, " + ", ".join(f"({_CLASS_SQL} = '{c}')::bigint as n_{c}" for c in privacy.CLASSES) + f", ({_CLASS_SQL} <> 'clean')::bigint as total, {_CLASS_SQL} = 'clean' as suspected_parser_failure from part")
def redact_classes(spark, sf_dir):
    """One personal datum of each class, and a title that is none."""
    r = _personal(spark, sf_dir).select("p_partkey", privacy.redact("said").alias("r"))
    return r.select("p_partkey", F.col("r.text").alias("clean"), *[F.col(f"r.n_{c}").cast("long").alias(f"n_{c}") for c in privacy.CLASSES], F.col("r.total").cast("long").alias("total"), "r.suspected_parser_failure")


@registered(
    """select p_partkey, case p_partkey % 7 when 0 then 'phone' when 1 then 'email' when 2 then 'honorific_name' when 3 then 'house_number' else '' end as leaks,
  case p_partkey % 7 when 0 then 'phone' when 1 then 'email' when 2 then 'honorific_name name' when 3 then 'address house_number' when 4 then 'coordinates' when 5 then 'media_link' else '' end as classes,
  case p_partkey % 7 when 1 then p_name || ' to [REDACTED]' when 5 then p_name || ' https://x.example/' || p_partkey end as scrubbed from part"""
)
def leak_classes_found(spark, sf_dir):
    p = _personal(spark, sf_dir)
    shown = F.when((F.col("p_partkey") % 7).isin(1, 5), privacy.scrub("said"))
    return p.select("p_partkey", F.array_join(privacy.find_leaks("said"), " ").alias("leaks"), F.array_join(privacy.personal_data_classes("said"), " ").alias("classes"), shown.alias("scrubbed"))


@registered(
    "select 'part' as \"table\", class, count(*) as n_rows from (select unnest(case p_partkey % 7 when 0 then ['phone'] when 1 then ['email'] when 2 then ['honorific_name'] when 3 then ['house_number'] else [] end) as class from part) group by class"
)
def nested_scan(spark, sf_dir):
    """Personal data within maps, arrays of arrays, and arrays of structs that hold maps."""
    p = _personal(spark, sf_dir)
    hidden = F.array(F.struct(F.lit(1).alias("n"), F.create_map(F.lit("k"), F.array(F.array("said"))).alias("m")))
    return privacy.scan(p.select(hidden.alias("deep"), F.sha2("said", 256).alias("digest")), "part")


@registered("select p_partkey, round(2.0 * length(p_name) / (2 * length(p_name) + p_size), 6) as ratio, 1.0::double as same from part")
def title_ratio_known(spark, sf_dir):
    """A string against itself with so many other letters behind it."""
    p = _part(spark, sf_dir)
    return p.select("p_partkey", F.round(similarity.title_ratio("p_name", F.concat("p_name", F.expr("repeat('0', p_size)"))), 6).alias("ratio"), similarity.title_ratio("p_name", "p_name").alias("same"))


def _html(spark, sf_dir):
    """Articles with a listing, a method, scripts and metadata; every third has no article, every fifth two listings."""
    listing = F.concat(F.lit("<h2>ส่วนผสม</h2><ul><li>• "), "p_name", F.lit(" &amp; co</li><li>1. "), "p_brand", F.lit("</li></ul><p>วิธีทำ<br>"), "p_type", F.lit("</p>"))
    twice = F.when(F.col("p_partkey") % 5 == 0, F.concat(listing, listing)).otherwise(listing)
    body = F.concat(F.lit("<script>var x = '<p>no</p>';</script><p>"), "p_type", F.lit("</p>"), twice)
    about = _f('<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["Recipe"],"headline":"%s","datePublished":"2024-01-02","author":"no"},{"@type":"BreadcrumbList","itemListElement":[{"position":3,"name":"page","item":"https://x.example/view123.html"},{"position":1,"name":"root"},{"position":2,"item":{"name":"%s"}}]}]}</script>', "p_name", "p_type")
    tag = F.when(F.col("p_partkey") % 3 == 0, "div").otherwise("article")
    return _part(spark, sf_dir).select("p_partkey", "p_name", F.concat(F.lit("<html><nav>menu</nav><"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">"), about, F.lit("</html>")).alias("html"))


_LISTED_SQL = """listed as (select p_partkey, p_name, [p_type] || case when p_partkey % 5 = 0 then own || own else own end as l
  from (select *, ['ส่วนผสม', '• ' || p_name || ' & co', '1. ' || p_brand, 'วิธีทำ', p_type] as own from part) where p_partkey % 3 <> 0)"""


@registered(f"with {_LISTED_SQL} select p_partkey, (i - 1)::bigint as pos, l[i] as line from listed, unnest(generate_series(1, 11)) as t(i) where i <= len(l)")
def article_lines(spark, sf_dir):
    return _html(spark, sf_dir).select("p_partkey", F.posexplode(pages.html_lines(F.col("html"))).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


@registered(f"with {_LISTED_SQL} select p_partkey, s::bigint as section, 'ส่วนผสม' as heading, p_name || ' & co~' || (select p_brand from part p where p.p_partkey = l.p_partkey) as items from listed l, unnest([1, 2]) as t(s) where s = 1 or p_partkey % 5 = 0")
def article_sections(spark, sf_dir):
    line = F.col("line")
    found = pages.sections(article_lines(spark, sf_dir), "p_partkey", text.is_heading(line), text.is_heading(line, text.METHOD_HEADINGS))
    return found.select("p_partkey", F.col("section").cast("long").alias("section"), "heading", F.array_join("items", "~").alias("items"))


@registered("select p_partkey, case when p_partkey % 3 = 0 then 'no_section' when p_partkey % 5 = 0 then 'many_sections' else 'loaded' end as outcome from part")
def article_outcomes(spark, sf_dir):
    return pages.single_section(article_sections(spark, sf_dir), _part(spark, sf_dir), "p_partkey", "p_name")


@registered("select p_partkey, p_name as headline, '2024-01-02' as published, p_type as category from part")
def article_metadata(spark, sf_dir):
    return _html(spark, sf_dir).select("p_partkey", pages.metadata("html").alias("m")).select("p_partkey", "m.*")


@registered(
    """with d as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)
select doc_id as recipe_id, (case when doc_id % 2 = 0 then i else 1000 + i end)::bigint as position, case when doc_id % 2 = 1 then 'h' end as heading, l[i] as raw from d, unnest(generate_series(1, len(l))) as t(i)"""
)
def payload_lines(spark, sf_dir):
    """Both payload shapes, made from documents: flat lists of even ids, sections of odd ones."""
    d = Testbed(spark, sf_dir).table("documents").select(F.col("doc_id").alias("recipe_id"), F.split("text", "\n").alias("l"))
    flat = F.to_json(F.struct(F.transform("l", lambda x: F.struct(x.alias("name_th"))).alias("ingredients")))
    deep = F.to_json(F.struct(F.array(F.struct(F.lit("h").alias("heading"), F.col("l").alias("items"))).alias("sections")))
    rows = tables.ingredient_lines(d.select("recipe_id", F.when(F.col("recipe_id") % 2 == 0, flat).otherwise(deep).alias("parsed_json")))
    return rows.withColumn("position", F.col("position").cast("long"))


@registered("with d as (select doc_id as doc, string_split(text, chr(10)) as l from documents where text is not null) select doc, (i - 1)::bigint as line, l[i] as text, 0::bigint as n_ticked from d, unnest(generate_series(1, len(l))) as t(i)")
def layout_lines(spark, sf_dir):
    """Words of documents as runs on a page, and back to lines."""
    d = Testbed(spark, sf_dir).table("documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("l", "line"))
    runs = d.select("doc", "l", F.posexplode(F.split("line", " ")).alias("w", "text"))
    got = layout.documents(runs.select("doc", "text", (F.col("w") * 30.0).alias("x"), (F.col("l") * 12.0 + F.col("w") % 2).alias("y"), F.lit(1).alias("page")))
    return got.select("doc", F.col("line").cast("long").alias("line"), "text", F.col("n_ticked").cast("long").alias("n_ticked"))


@registered("select user_id, event_type, count(*) as copies, last(event_id order by ts, event_id) as last_event from events group by all")
def manifest_latest(spark, sf_dir):
    """How often each (user, type) was logged, beside its latest row, as a crawl's manifest is read."""
    e = Testbed(spark, sf_dir).table("events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("url"), F.struct("ts", "event_id").alias("fetched_at"), "user_id", "event_type", F.col("event_id").alias("last_event"))
    return conduct.current(e).join(e.groupBy("url").agg(F.count("*").alias("copies")), "url").select("user_id", "event_type", "copies", "last_event")
