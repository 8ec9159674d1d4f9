import datetime
import random

import pytest
from pyspark.sql import functions as F

from basketlens.functions import layout, pages, privacy, text, thai
from basketlens.operators import attribution, geo, quality, reports, similarity, validation, vocabulary
from basketlens.sources import conduct, tables
from basketlens.streaming import ingest


def one(spark, expr, *values):
    return spark.createDataFrame([(v,) for v in values], "x string").select(expr(F.col("x")).alias("y")).collect()


def test_keys(spark):
    got = [r["y"] for r in one(spark, text.key, "  a   b ", "é", None)]
    assert got == ["a b", "é", None]


def test_strip_quantity(spark):
    raw = ["พริกขี้หนูสด จำนวน 20 เม็ด", "ใบมะกรูด", "หัวกะทิ 1 1/2 ถ้วย", "• น้ำปลา 2-3 ช้อนโต๊ะ", "เกลือ เล็กน้อย", "น้ำ ๑,๐๐๐ มล.", "ไข่ 2 ถึง 3 ฟอง +", None]
    assert [r["y"] for r in one(spark, text.strip_quantity, *raw)] == ["พริกขี้หนูสด", "ใบมะกรูด", "หัวกะทิ", "น้ำปลา", "เกลือ", "น้ำ", "ไข่", None]


def test_suggestions(spark):
    raw = ["หอมแดงซอย 3 หัว (หั่นบาง)", "กระเทียม สับ 2 กลีบ", "ใบมะกรูด สำหรับ โรยหน้า", "น้ำ", "3 ถ้วย", "หมูสับ ละเอียด ขนาดเล็ก", "ผักชี หั่นท่อนยาว ใหญ่", None]
    assert [r["y"] for r in one(spark, text.suggestion_key, *raw)] == ["หอมแดง", "กระเทียม", "ใบมะกรูด", "น้ำ", "3 ถ้วย", "หมู", "ผักชี", None]
    groups = ["ข่า ตะไคร้ หอมแดง", "ภาพจาก : ครัว", "ข่า", "หมู หรือ ไก่", "rice + egg", "red rice", "ไข่, ไข่", None]
    assert [r["y"] for r in one(spark, text.multi_parts, *groups)] == [["ข่า", "ตะไคร้", "หอมแดง"], [], [], ["หมู", "ไก่"], ["rice", "egg"], [], [], None]


def test_small_scalars(spark):
    assert one(spark, text.strip_leaders, "....x....")[0]["y"] == "x" and one(spark, text.strip_leaders, "....")[0]["y"] is None
    assert one(spark, text.arabic_digits, "๑๒ก")[0]["y"] == "12ก"
    assert one(spark, text.slug, "http://a.b/c/Das-Ist/?q#f")[0]["y"] == "das-ist"
    assert one(spark, text.host_of, "HTTP://A.B:80/x", None, "kein")[0]["y"] == "a.b"
    assert one(spark, text.iso_date, "2024-02-30x", "2024-02-28T10")[1]["y"] == datetime.date(2024, 2, 28)
    r = one(spark, text.repair_private_use, "ดาน")[0]["y"]
    assert (r["text"], r["mapped"], r["residue"]) == ("ด้าน", 1, 1)
    q = one(spark, text.first_quantity, "น้ำปลา 2 ช้อนชา", "เกลือ")
    assert (q[0]["y"]["value"], q[0]["y"]["unit"], q[0]["y"]["name"]) == ("2", "ช้อนชา", "น้ำปลา") and q[1]["y"]["value"] is None
    assert one(spark, lambda c: text.split_list(c, "delimiters"), "a, b;;c")[0]["y"] == ["a", "b", "c"]
    assert one(spark, text.is_heading, "ส่วนผสม", "ส่วนผสม" + "x" * 90)[1]["y"] is False


def test_redaction(spark):
    raw = "โทร 081-234-5678 a@b.co นายสมชาย ใจดี นายอำเภอ เห็ดนางฟ้า https://x.y/z"
    r = one(spark, privacy.redact, raw, None, "clean")
    assert "081" not in r[0]["y"]["text"] and "นายอำเภอ" in r[0]["y"]["text"] and "นางฟ้า" in r[0]["y"]["text"]
    assert (r[0]["y"]["n_phone"], r[0]["y"]["n_email"], r[0]["y"]["n_name"], r[0]["y"]["n_media_link"]) == (1, 1, 1, 1)
    assert r[2]["y"]["suspected_parser_failure"] and r[1]["y"]["text"] is None
    assert privacy.leak_classes(privacy.redact_text(raw)[0]) == []
    assert one(spark, privacy.personal_data_classes, "ทดสอบ@example.com")[0]["y"] == ["email"]


def test_scan_finds_nested_strings(spark):
    df = spark.createDataFrame([(1, ["a@b.co"], [("x", "0812345678")])], "id int, l array<string>, s array<struct<a:string,b:string>>")
    assert {r["class"]: r["n_rows"] for r in privacy.scan(df, "t").collect()} == {"email": 1, "phone": 1}


def test_publish_is_all_or_nothing(spark, tmp_path):
    good, bad = spark.createDataFrame([("x",)], "t string"), spark.createDataFrame([("a@b.co",)], "t string")
    with pytest.raises(ValueError) as e:
        tables.publish({"good": good, "bad": bad}, str(tmp_path))
    assert "a@b.co" not in str(e.value) and not list(tmp_path.iterdir())
    tables.publish({"good": good}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/good.parquet").count() == 1 and len(list(tmp_path.iterdir())) == 1


def test_pages():
    html = "<nav>x</nav><article><script>y</script>ส่วนผสม<br>a&amp;b<br/><p>c</p></article>z"
    assert pages.plain_lines(html) == ["ส่วนผสม", "a&b", "c"] and pages.plain_lines("<p>x</p>") is None
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"Recipe","headline":"h","datePublished":"2024"},{"@type":"BreadcrumbList","itemListElement":[{"position":3,"name":"p","item":"/view1.html"},{"position":1,"name":"r"},{"position":2,"name":"c"}]}]}</script>'
    assert pages.plain_metadata(ld) == ("h", "2024", "c") and pages.plain_metadata("<script type='application/ld+json'>{</script>") == (None, None, None)


def test_sections(spark):
    lines = ["intro", "ส่วนผสม", "• a", "1. b", "วิธีทำ", "c", "เครื่องปรุง", "x" * 200, "d", "วัตถุดิบ", "e"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "k int, pos int, line string")
    got = pages.sections(df, "k", text.is_heading(F.col("line")), text.is_heading(F.col("line"), text.METHOD_HEADINGS)).orderBy("section").collect()
    assert [(r["heading"], r["items"]) for r in got] == [("ส่วนผสม", ["a", "b"]), ("วัตถุดิบ", ["e"])]


def test_layout():
    R = layout.Run
    runs = [R("b", 60, 10.5), R("a", 10, 10), R("1", 10, 30), R("x", 61, 31), R("more", 62, 42), R("☑", 5, 60), R("yes", 20, 61), R("no", 90, 61)]
    rows = layout.lines(runs)
    assert [[r.text for r in x] for x in rows][:2] == [["a", "b"], ["1", "x"]]
    assert layout.table(rows[1:3], [10, 60]) == [["1", "x more"]] and len(layout.anchors(rows)) == 2
    assert layout.boxes(runs) == ["yes"] and layout.first_match("ab", [("b", "1"), ("a", "2")]) == "2"


def test_geography():
    square = [[[[0, 0], [4, 0], [4, 4], [0, 4]], [[1, 1], [3, 1], [3, 3], [1, 3]]]]
    assert geo.inside(square, 0.5, 0.5) and not geo.inside(square, 2, 2) and not geo.inside(square, 9, 2)
    assert geo.inside(square, *geo.point_on_surface(square))


def test_attribution(spark):
    keys = spark.createDataFrame([(i,) for i in range(5)], "k int")
    p = spark.createDataFrame([(0, ["a"]), (1, ["a", "b"])], "k int, codes array<string>")
    r = spark.createDataFrame([(0, ["x", "y"]), (2, ["x"]), (3, ["x", "y"])], "k int, codes array<string>")
    got = {x["k"]: (x["label"], x["tier"], x["note"]) for x in attribution.decide(keys, "k", p, r).collect()}
    assert got == {0: ("a", 1, "regions conflict"), 1: (None, None, "several provinces"), 2: ("x", 2, None), 3: (None, None, "several regions"), 4: (None, None, None)}


def test_rebuild_keeps_foreign_rows(spark):
    old = spark.createDataFrame([(1, "rule: x", "a"), (2, "hand", "b")], "k int, note string, v string")
    new = spark.createDataFrame([(2, "rule: y", "c"), (3, "rule: y", "d")], "k int, note string, v string")
    assert {(r["k"], r["v"]) for r in attribution.rebuild(old, new, "k", "note", "rule:").collect()} == {(2, "b"), (3, "d")}


def test_similarity(spark):
    items = spark.createDataFrame([(1, c) for c in "abcdefg"] + [(2, c) for c in "abcdefgh"] + [(3, c) for c in "abcdefghi"] + [(4, "z")], "key int, item string")
    got = {(r["a"], r["b"]): round(r["similarity"], 4) for r in similarity.similar_sets(items, 0.875).collect()}
    assert got == {(2, 3): 0.8889}  # 7/8 is not above 7/8
    assert (1, 2) in {(r["a"], r["b"]) for r in similarity.similar_sets(items, 0.875, strict=False).collect()}
    e = spark.range(1).select(similarity.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j")).first()["j"]
    assert e == 1.0
    best = similarity.best_matches(items.where("key = 1"), items.where("key > 1")).first()
    assert (best["left"], best["right"]) == (1, 2)


def test_vocabulary(spark):
    lines = spark.createDataFrame([(1, 1, "k1", "K1"), (1, 2, "k2", "K2"), (1, 3, "k1", "K1"), (1, 4, "none", "N"), (2, 1, "s", "S")], "recipe_id int, pos int, key string, raw string")
    entries = vocabulary.lookup(spark.createDataFrame([("k1", "A"), ("k2", "A"), ("k2", "B")], "key string, canonical_id string"), spark.createDataFrame([("s", "C"), ("s", "D"), ("k1", "Z")], "key string, canonical_id string"))
    got = {(r["recipe_id"], r["canonical_id"]): r["raw"] for r in vocabulary.canonicalise(lines, entries).collect()}
    assert got == {(1, "A"): "K1 ‖ K2", (2, "C"): "S", (2, "D"): "S"}
    pairs = spark.createDataFrame([("A", "B")], "a string, b string")
    names = spark.createDataFrame([("k1", "B"), ("k2", "A")], "key string, canonical_id string")
    mapped = spark.createDataFrame([("k1", "A"), ("k2", "A")], "key string, canonical_id string")
    assert [tuple(r) for r in vocabulary.conflations(mapped, names, pairs).collect()] == [("k1", "A", "B")]
    sheet = spark.createDataFrame([("g", "a", None, "alias:X"), ("g", "b", "alias:Y", None), ("h", "c", "skip", None)], "group_key string, key string, decision string, group_decision string")
    good, _ = vocabulary.decided(sheet)
    assert {(r["key"], r["decision"]) for r in good.collect()} == {("a", "alias:X"), ("b", "alias:Y")}


def test_quality_reports_all_at_once(spark):
    t = {"a": spark.createDataFrame([(1, "x"), (1, None), (None, "y")], "k int, v string")}
    rules = [quality.unique("a", "k"), quality.not_null("a", "v"), quality.one_of("a", "v", ("x", "y"))]
    assert [r["violations"] for r in quality.violations(t, rules).collect()] == [2, 1, 0]
    with pytest.raises(ValueError, match="unique.*not null"):
        quality.refuse(t, rules)


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿k,v\n a ,\"x\ny\"\n", encoding="utf-8")
    assert [tuple(r) for r in tables.exact_csv(spark, f"{tmp_path}/a.csv", ["k", "v"], ["v"]).collect()] == [("x y",)]
    with pytest.raises(ValueError):
        tables.exact_csv(spark, f"{tmp_path}/a.csv", ["v", "k"])
    (tmp_path / "t").mkdir()
    for name, body in (("b", 'x = 1'), ("_skip", "x = 2"), ("bad", "x = ")):
        (tmp_path / "t" / f"{name}.toml").write_text(body)
    got = tables.toml_records(spark, f"{tmp_path}/t", "x int", lambda d: {"x": d["x"]}).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["x"], r["error"]) for r in got) == [("b.toml", 1, None), ("bad.toml", None, "TOMLDecodeError")]
    (tmp_path / "r.md").write_text("# t\n| a | go |\n|---|---|\n| a | no-go |\n")
    reg = tables.markdown_table(spark, f"{tmp_path}/r.md", ["source_id", "decision"])
    assert [r["decision"] for r in reg.orderBy("line").collect()] == ["go", "no-go"]
    assert conduct.may_run(reg, "a", "audit") and not conduct.may_run(reg, "a", "full")
    old, new = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string"), spark.createDataFrame([(1, None, "c"), (2, "d", "e")], "k int, x string, y string")
    assert sorted(tuple(r) for r in tables.upsert(old, new, ["k"], ["x"]).collect()) == [(1, "a", "b"), (2, "d", "e")]
    a, b = tables.manifest({"t": old.unionByName(new)}).first(), tables.manifest({"t": new.unionByName(old)}).first()
    assert a == b and a["n_rows"] == 3


def test_conduct():
    p, q = conduct.Pace(seed=3), conduct.Pace(seed=3)
    assert [p.wait() for _ in range(3)] == [q.wait() for _ in range(3)] and p.wait("7") == 7
    for _ in range(4):
        p.error()
    with pytest.raises(RuntimeError):
        p.error()
    assert not conduct.allowed("User-agent: *\nDisallow: /x", "bot", "http://a/x/1") and conduct.allowed("", "bot", "http://a/x")


def test_number_tracing(spark):
    lines = spark.createDataFrame([(1, "about 12.35 of 480 in 2024, 7 more, and 99.9")], "line int, value string")
    known = spark.createDataFrame([("12.345",), ("480",)], "value string")
    assert [r["number"] for r in reports.untraced(lines, known).collect()] == ["99.9"]
    assert str(reports.half_up("2.675", 2)) == "2.68"


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("s", "a"), ("s", "a"), ("t", "a@b.co")], "source string, text string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    stream = ingest.redacted(ingest.once(ingest.read(spark, f"{tmp_path}/in", df.schema), "source", "text", "at"), "text")
    for _ in range(2):  # a second run finds nothing new
        ingest.start(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["source"], r["text"]) for r in got.collect()) == [("s", "a"), ("t", "[REDACTED]")]


def test_segmentation():
    words = frozenset(["ตำบล", "จำเป็น", "จา", "เป็น", "น้ำ", "น้า", "ข่า", "หอมแดง"])
    segment = thai.fewest_words(words)
    assert segment("ข่าหอมแดง") == ["ข่า", "หอมแดง"] and segment("") == []
    assert thai.repair_am("ต าบล จ าเป็น น้ า", segment, words) == ("ตำบล จำเป็น น้ า", 2, 0, 1)
    assert thai.tokens("ข่าหอมแดง 3 หัว (สด) oil *", segment) == ["ข่า", "หอมแดง", "oil"]
    assert thai.word_count("ข่าหอมแดง two words", segment) == 4


def test_segmentation_in_columns(spark):
    words = ["ตำบล", "ข่า"]
    r = one(spark, lambda c: F.struct(thai.repaired(c, words).alias("r"), thai.line_tokens(c, words).alias("t")), "ต าบล", None)
    assert r[0]["y"]["r"]["text"] == "ตำบล" and r[1]["y"]["t"] is None


def test_vocabulary_problems_in_one_report(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    entries = [(f"ING_{i:04d}", f"n{i}", "acid") for i in range(40)]
    ok = (frame([("x", "ING_0001")], "key string, canonical_id string"), frame([("s", "ING_0001"), ("s", "ING_0002")], "key string, canonical_id string"), frame([("e",)], "key string"), frame([("ING_0001", "ING_0002")], "a string, b string"))
    assert vocabulary.problems(frame(entries, "canonical_id string, name string, category string"), *ok).count() == 0
    bad = frame([*entries, ("ING_1", "n1", "none"), ("ING_0001", None, "other")], "canonical_id string, name string, category string")
    lists = (frame([("x", "ING_0001"), ("x", "ING_0002"), ("y", "ING_9999"), ("e", "ING_0003")], "key string, canonical_id string"), ok[1].limit(1), ok[2], frame([("A", "B"), ("B", "A"), ("C", "C")], "a string, b string"))
    got = {(r["list"], r["rule"]) for r in vocabulary.problems(bad, *lists).collect()}
    assert len(got) == 12 and ("entries", "others within their ceiling") not in got


def test_similar_sets_against_brute_force(spark):
    r = random.Random(4)
    sets = {i: frozenset(r.sample(range(12), r.randint(1, 7))) for i in range(60)}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "key int, item int")
    for least in (0.3, 0.5, 0.8):
        expected = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        got = {(x["a"], x["b"]) for x in similarity.similar_sets(df, least, strict=False).collect()}
        assert got == expected


def test_near_strings_lose_nothing(spark):
    from difflib import SequenceMatcher

    r = random.Random(2)
    base = ["".join(r.choice("abcde") for _ in range(n)) for n in (1, 2, 5, 9, 24, 44, 130, 181, 271, 300)]
    strings = sorted({b[: max(1, int(len(b) * f))] + "z" * k for b in base for f in (1, 0.8, 0.6) for k in (0, 1, len(b) // 2, len(b))})
    df = spark.createDataFrame([(x,) for x in strings], "key string")
    for least in (0.5, 0.7, 0.8, 0.95, 1.0):
        expected = {(a, b) for a in strings for b in strings if a != b and SequenceMatcher(None, a, b).ratio() >= least}
        assert {(x["key"], x["other"]) for x in similarity.near_strings(df, df, least).collect()} == expected, least


def test_publish_comes_back_when_a_move_fails(spark, tmp_path, monkeypatch):
    from basketlens.operators import release

    one, two = spark.createDataFrame([("old",)], "t string"), spark.createDataFrame([("new",)], "t string")
    tables.publish({"a": one, "b": one}, str(tmp_path))
    move, calls = release.Files.move, []

    def failing(self, old, new):
        calls.append(new)
        if len(calls) == 4:
            raise OSError("no")
        move(self, old, new)

    monkeypatch.setattr(release.Files, "move", failing)
    with pytest.raises(OSError):
        tables.publish({"a": two, "b": two}, str(tmp_path))
    monkeypatch.setattr(release.Files, "move", move)
    for name in "ab":
        assert spark.read.parquet(f"{tmp_path}/{name}.parquet").first()[0] == "old"
    assert len(list(tmp_path.iterdir())) == 2
    tables.publish({"a": two, "b": two}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/a.parquet").first()[0] == "new"


def test_append_is_taken_back_if_not_valid(spark, tmp_path):
    from basketlens.operators import release

    once = lambda df: df.count() == df.select("k").distinct().count()
    release.append(str(tmp_path), "t", spark.createDataFrame([(1,), (2,)], "k int"), once)
    with pytest.raises(ValueError):
        release.append(str(tmp_path), "t", spark.createDataFrame([(2,)], "k int"), once)
    release.append(str(tmp_path), "t", spark.createDataFrame([(3,)], "k int"), once)
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [1, 2, 3] and len(list(tmp_path.iterdir())) == 1


def test_manifest_counts_copies(spark):
    digest = lambda *v: tables.manifest({"t": spark.createDataFrame([(x,) for x in v], "x string")}).first()["digest"]
    assert digest("a", "b") == digest("b", "a") != digest("a", "b", "c", "c") and digest("a", None) != digest("a", "")


def test_freeze_and_regions_refuse(spark):
    from basketlens.operators import regional, release, views

    df = spark.createDataFrame([("call 081-234-5678",)], "t string")
    with pytest.raises(ValueError) as e:
        release.freeze({"t": df}, df, ["t"], {"tree clean": False})
    assert "tree clean" in str(e.value) and "phone" in str(e.value) and "081" not in str(e.value)
    recipes = spark.createDataFrame([(1, "p", "x")], "recipe_id int, province string, own_region string")
    with pytest.raises(ValueError):
        views.resolved(recipes, spark.createDataFrame([("p", "y")], "province string, region string"))
    one = spark.createDataFrame([(1, 2, 0.5)], "a int, b int, distance double")
    with pytest.raises(ValueError):
        regional.mantel(one, spark.createDataFrame([(1, 3, 0.5)], "a int, b int, distance double"), 3)
    assert release.health({"t": df}) == {"t": 1}


def test_stream_takes_each_key_once(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    for k, batch in enumerate((rows("a", "a", "b"), rows("b", "c"))):
        batch.write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.read(spark, f"{tmp_path}/in", batch.schema)
        ingest.start_keyed(stream, f"{tmp_path}/out", f"{tmp_path}/state", ["k"]).awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == (2, 3)[k]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿x,y\n1, a  b \n", encoding="utf-8")
    got = tables.exact_csv(spark, str(tmp_path / "a.csv"), ["x", "y"], ["y"]).collect()
    assert [tuple(r) for r in got] == [("a b",)]
    with pytest.raises(ValueError):
        tables.exact_csv(spark, str(tmp_path / "a.csv"), ["y", "x"])
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(f"{tmp_path}/p")
    from pyspark.sql.types import StructType

    assert tables.required_parquet(spark, f"{tmp_path}/p", StructType.fromDDL("v string")).columns == ["v"]
    with pytest.raises(ValueError):
        tables.required_parquet(spark, f"{tmp_path}/p", StructType.fromDDL("v int"))
    (tmp_path / "r.md").write_text("| source_id | decision |\n|---|---|\n| a | go |\n| b \\| c | stop |\n| a | Stop |\n")
    register = tables.markdown_table(spark, str(tmp_path / "r.md"), ["source_id", "decision"])
    assert register.count() == 4 and not conduct.may_run(register, "a", "full") and conduct.may_run(register, "a", "audit")
    wanted = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    log = spark.createDataFrame([("u", "fetched"), ("v", "empty")], "url string, outcome string")
    assert [r[0] for r in tables.unsettled(wanted, log).collect()] == ["w"] and tables.unsettled(wanted, log, retry_empty=True).count() == 2
    tables.snapshot(spark.createDataFrame([("s", 1.23456, float("nan"))], "k string, a double, b double"), str(tmp_path / "snap"), "2024-01-02", {"n": 1})
    assert spark.read.csv(f"{tmp_path}/snap/2024-01-02.csv", header=True).first()["a"] == "1.2346"
    space = conduct.addresses({"north": 2}, 3, "http://x/{region}/{province}/{menu}.pdf", spark)
    assert space.count() == 6 and "http://x/north/2/3.pdf" in {r["url"] for r in space.collect()}
    answers = spark.createDataFrame([(404, None), (200, b"%PDF-1"), (200, b"<html>"), (500, None)], "status int, body binary")
    assert [r[0] for r in answers.select(tables.enumerated_outcome(F.col("status"), F.col("body"))).collect()] == ["missing", "found", "soft_missing", "failed"]


def test_shapes(spark):
    import json

    square = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2]]]})
    features = spark.createDataFrame([("Buri Ram", square)], "name string, geojson string")
    got = geo.load_shapes(spark.createDataFrame([("buri-ram",)], "name string"), features, {})
    assert got.select(geo.surface_point("geojson").alias("p")).first()["p"]["lon"] == 1.0
    with pytest.raises(ValueError):
        geo.load_shapes(spark.createDataFrame([("elsewhere",)], "name string"), features, {})
    assert geo.outside(spark.createDataFrame([(square, 1.0, 1.0), (square, 3.0, 1.0)], "geojson string, lon double, lat double")).first()[0] == 1


def test_constraints_of_arrays_and_order(spark):
    df = spark.createDataFrame([(["a"], 1, 2), (["a", "x"], 3, 2), ([], 2, 2)], "l array<string>, a int, b int")
    got = {r["rule"]: r["violations"] for r in quality.violations({"t": df}, [quality.subset_of("t", "l", ("a", "b")), quality.in_order("t", "a", "b")]).collect()}
    assert got == {"l within list": 1, "a <= b": 1}


def test_contained_either_way(spark):
    texts = spark.createDataFrame([(1, "the green rivers run"), (2, "a b"), (3, ""), (4, None), (5, "green riverbed")], "k int, t string")
    names = spark.createDataFrame([("green riv",), ("green rivers",), ("b",), ("zz",), ("",), (None,)], "n string")
    expected = {(1, "green riv"), (1, "green rivers"), (2, "b"), (5, "green riv"), (5, "b")}
    for most in (None, 0):
        assert {tuple(r) for r in similarity.contained(texts, "k", "t", names, "n", most=most).collect()} == expected
    assert {tuple(r) for r in similarity.contained(texts, "k", "t", spark.createDataFrame([("a b",)], "n string"), "n", exact=True).collect()} == {(2, "a b")}


def test_equal_sets_are_one_class(spark):
    items = spark.createDataFrame([(k, c) for k in range(30) for c in ("abcd" if k < 20 else "abce" if k < 29 else "xyz")], "key int, item string")
    pairs, members = similarity.similar_classes(items, 0.5)
    assert pairs.count() == 1 and members.count() == 30 and members.select("cls").distinct().count() == 3
    got = {(r["a"], r["b"]): r["similarity"] for r in similarity.similar_sets(items, 0.5).collect()}
    assert len(got) == 29 * 28 // 2 and got[0, 1] == 1.0 and got[0, 20] == 0.6


def test_probe_of_sitemaps():
    index = "<sitemapindex><loc>http://x/category.xml</loc><loc>http://x/posts.xml</loc><loc>http://x/tag.xml</loc></sitemapindex>"
    answers = {"http://x/sitemap.xml": (200, index), "http://x/category.xml": (200, "<urlset><loc> http://x/c/1 </loc></urlset>"), "http://x/tag.xml": (404, ""), "http://x/flat.xml": (200, "<urlset><loc>http://x/tag/1</loc><loc>http://x/p</loc></urlset>")}
    terms, notes, used = pages.probe(["http://x/none.xml", "http://x/sitemap.xml"], lambda u: answers.get(u))
    assert terms == ["http://x/c/1"] and notes == ["not allowed: http://x/none.xml", "404: http://x/tag.xml"] and used == 3
    assert pages.probe(["http://x/flat.xml"], answers.get)[0] == ["http://x/tag/1"]
    assert pages.probe(["http://x/sitemap.xml"], answers.get, most=1)[1] == ["no more requests before http://x/category.xml", "no more requests before http://x/tag.xml"]
    assert pages.probe([], answers.get) == ([], ["no sitemap"], 0)


def test_register_rows_are_appended():
    one = conduct.appended("# Log\n", ["a|b", "go"], ["source_id", "decision"])
    two = conduct.appended(one + "\n## More\n\ntext\n", ["c", "stop"], ["source_id", "decision"])
    assert one.count(conduct.HEADING) == two.count(conduct.HEADING) == 1 and "| a\\|b | go |\n| c | stop |\n\n## More" in two
    with pytest.raises(NotImplementedError):
        conduct.Site("s", "http://x").discover()


def test_forms_end_where_numbers_do():
    from basketlens.functions import forms

    R = layout.Run
    line = lambda y, *cells, page=1: [R(t, x, y, page) for t, x in cells]
    head = line(10, ("ที่", 10), ("ชื่อวัตถุดิบ", 60))
    rows = [line(30, ("1", 10), ("เกลือ", 60)), line(50, ("หยาบ", 60)), line(70, ("๓.", 10), ("ข้าว", 60)), line(90, ("9", 10), ("หก", 60)), line(400, ("4", 10), ("ไกล", 60))]
    assert [forms.shown(x) for x in forms.bounded([head, *rows])] == ["1เกลือ", "หยาบ", "๓.ข้าว"]
    over = line(20, ("4", 10), ("น้ำ", 60), page=2)
    assert forms.shown(forms.bounded([head, *rows[:4], over])[-1]) == "4น้ำ"
    assert forms.table_names([head, *rows[:3]]) == [("เกลือ หยาบ", ""), ("ข้าว", "")]
    spoken = [head, line(30, ("ช่วยบำรุง", 60)), line(50, ("ป้องกันโรค", 60)), line(70, ("เกลือ", 60))]
    assert forms.listed_names(spoken) == [] and forms.listed_names([head, line(30, ("1.เกลือ", 60)), line(50, ("น้ำ", 60))]) == [("เกลือ", ""), ("น้ำ", "")]
    assert forms.bounded([rows[0]]) == [] and forms.record([], {})["notes"] == ["nothing redacted", "no boxes", "no names"]
    assert layout.anchors([[R("a", 0, 0), R("b", 50, 0)], [R("a", 1, 9)], [R("c", 90, 18)]], expected=1) == [0.5]


def test_candidates_are_not_shuffled(spark):
    """Many sets share rare pairs and few are alike: what is shuffled grows with the sets, not with the pairs that are judged."""
    items = spark.range(300).select(F.col("id").alias("key"), F.explode(F.array(F.lit(-1), F.lit(-2), F.col("id") * 2, F.col("id") * 2 + 1)).alias("item"))
    pairs, members = similarity.similar_classes(items, 0.5)
    assert pairs.count() == 0 and members.count() == 300
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 + 2  # the candidates', and one of item counts on each side


def test_best_matches_against_brute_force(spark):
    r = random.Random(3)
    sets = {k: frozenset(r.sample(range(9), r.randint(1, 4))) for k in range(80)}
    df = spark.createDataFrame([(k, f"i{x}") for k, s in sets.items() for x in s], "key long, item string")
    found = similarity.best_matches(df.where("key < 30"), df.where("key >= 30"))
    want = {}
    for k in range(30):
        near = [(-len(sets[k] & sets[j]) / len(sets[k] | sets[j]), j) for j in range(30, 80) if sets[k] & sets[j]]
        if near:
            want[k] = (min(near)[1], -min(near)[0])
    assert {x["left"]: (x["right"], x["similarity"]) for x in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join Inner") == 2


def test_documents_are_read_in_batches(spark):
    runs = spark.createDataFrame([(d, f"t{d}-{i}", float(i), 0.0 if i < 2 else 20.0, 1) for d in range(50) for i in range(3)], "doc long, text string, x double, y double, page int")
    got = layout.documents(runs)
    assert sorted(map(tuple, got.collect())) == [(d, i, t, 0) for d in range(50) for i, t in enumerate((f"t{d}-0 t{d}-1", f"t{d}-2"))]
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_parsed_once(spark):
    files = spark.createDataFrame([("a", '{"recipe_id":5}'), ("b", "{")], "file string, data string")
    found = validation.check(files, validation.COOKED)
    assert {tuple(r) for r in found.collect()} == {("a", "", "cook_date: required"), ("b", "", "not readable")}
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") + found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") < 10


def test_mentions_are_dealt_by_the_size_of_their_input(spark, sf, monkeypatch):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.lit("official").alias("register"), F.lit("s").alias("source_id"), F.col("l_orderkey").alias("recipe_id"), F.col("l_partkey").cast("string").alias("key"))
    monkeypatch.setattr(vocabulary, "PIECE", 1000)
    rows = vocabulary.dealt(lines, "recipe_id").distinct()
    assert rows.rdd.getNumPartitions() > 4 and rows.count() == lines.distinct().count()
    found = vocabulary.coverage(lines, spark.createDataFrame([], "key string, entry string"), ("official",))
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()


def test_title_hits_are_not_shuffled(spark, shuffled):
    texts = spark.range(400).selectExpr("id", "concat('name', id % 4, case when id % 40 = 0 then ' and name1' else '' end) as title")
    names = spark.range(4).selectExpr("concat('name', id) as name", "explode(transform(sequence(1, 30), x -> concat('c', x))) as code")
    hits = attribution.title_hits(texts, "id", "title", names)
    n = len(hits.collect())
    assert n == 390 * 60 + 10 * 30 and shuffled(hits)[0] < n / 4


def test_title_hits_of_keys_with_several_titles(spark):
    texts = spark.createDataFrame([(1, "ab"), (1, "b"), (1, None), (None, "b"), (None, "ab"), (2, "b"), (2, "b"), (3, "c"), (4, None)], "id long, title string")
    names = spark.createDataFrame([("b", "x"), ("b", None), ("ab", "x"), ("ab", "x")], "name string, code string")
    got = [tuple(r) for r in attribution.title_hits(texts, "id", "title", names).collect()]
    want = {(i, rule, code) for i in (1, None, 2) for rule in ("exact", "substring") for code in ("x", None)}
    assert len(got) == len(set(got)) and set(got) == want
