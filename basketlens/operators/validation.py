"""Hand-written records (JSON, one per file) against a form: every problem of every file in one table, and never a value.

A form is data: which keys there may be, which are refused by name, which values a key takes. Its
rules become one projection; lists within a record are checked by a form of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions import privacy, text

# Names of keys that would hold personal data, or a place finer than a district.
PERSONAL_KEY = r"(^|_)(name|first_name|last_name|surname|nickname|phone|tel|mobile|email|line|line_id|facebook|address|house|gps|lat|lon|photo)($|_)"
FINER_KEY = r"(subdistrict|tambo|ตำบล|village|หมู่บ้าน|^moo$|หมู่)"


@dataclass(frozen=True)
class Form:
    """What a record may hold. Texts are bounded by ``most`` characters and must be free of personal data."""

    texts: tuple[str, ...] = ()
    most: int = 500
    required: tuple[str, ...] = ()
    choices: dict[str, tuple[str, ...]] = field(default_factory=dict)
    integers: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    true: tuple[str, ...] = ()
    lists: dict[str, Form] = field(default_factory=dict)
    numbered: str | None = None
    strings: tuple[str, ...] = ()
    refused: str = PERSONAL_KEY
    finer: str = FINER_KEY

    @property
    def keys(self) -> list[str]:
        return sorted({*self.texts, *self.required, *self.choices, *self.integers, *self.dates, *self.flags, *self.true, *self.lists, *self.strings})


def _value(v: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _type(v: Column, key: str) -> Column:
    """The kind of a value as variants name it; null where the key is absent or its value is null."""
    kind = F.schema_of_variant(_value(v, key, "variant"))
    return F.nullif(F.coalesce(kind, F.lit("VOID")), F.lit("VOID"))


def _rules(form: Form, raw: Column, v: Column) -> Column:
    """array<string>: what is wrong with one record, apart from its lists' entries. v: the record, parsed once in a column of its own."""
    unknown = F.filter(F.json_object_keys(raw), lambda k: ~k.isin(*form.keys))
    named = F.transform(unknown, lambda k: F.when(F.lower(k).rlike(form.finer), F.concat(F.lit("finer than district: "), k)).when(F.lower(k).rlike(form.refused), F.concat(F.lit("personal key: "), k)).otherwise(F.concat(F.lit("unknown key: "), k)))
    shown = {k: text.collapse(_value(v, k)) for k in form.texts}
    found = []
    for k in form.texts:
        found += [(f"{k}: not a string", _type(v, k) != "STRING"), (f"{k}: too long", F.length(shown[k]) > form.most)]
    for k in form.required:
        found.append((f"{k}: required", _type(v, k).isNull() | (F.trim(F.coalesce(_value(v, k), F.lit("?"))) == "")))
    for k, values in form.choices.items():
        found.append((f"{k}: not in list", _type(v, k).isNotNull() & ~F.coalesce(_value(v, k).isin(*values), F.lit(False))))
    for k in form.integers:
        found.append((f"{k}: not an integer", _type(v, k).isNotNull() & (_type(v, k) != "BIGINT")))
    for k in form.dates:
        found.append((f"{k}: not a date", _type(v, k).isNotNull() & ~F.coalesce(_value(v, k).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(_value(v, k), "yyyy-MM-dd").isNotNull(), F.lit(False))))
    for k in form.flags:
        found.append((f"{k}: not true or false", _type(v, k).isNotNull() & (_type(v, k) != "BOOLEAN")))
    for k in form.true:
        found.append((f"{k}: must be true", ~F.coalesce((_type(v, k) == "BOOLEAN") & _value(v, k, "boolean"), F.lit(False))))
    for k in form.strings:
        found.append((f"{k}: not a list of strings", _type(v, k).isNotNull() & (_type(v, k) != "ARRAY<STRING>") & (_type(v, k) != "ARRAY<VOID>")))
    hits = F.array_compact(F.array(*[F.when(c, F.lit(rule)) for rule, c in found])) if found else F.expr("cast(array() as array<string>)")
    said = F.concat_ws("\n", *shown.values(), *[F.array_join(_value(v, k, "array<string>"), "\n") for k in form.strings])
    classes = privacy.personal_data_classes(said)
    return F.concat(hits, named, F.when(F.size(classes) > 0, F.array(F.concat(F.lit("personal data: "), F.array_join(classes, ", ")))).otherwise(F.expr("cast(array() as array<string>)")))


def check(files: DataFrame, form: Form) -> DataFrame:
    """(file, place, rule) of files (file, data): place is empty for the record itself, else the list and the entry's number."""
    parsed = files.select("file", "data", F.try_parse_json("data").alias("v"))
    broken = parsed.where(F.col("v").isNull()).select("file", F.lit("").alias("place"), F.lit("not readable").alias("rule"))
    good = parsed.where(F.col("v").isNotNull())
    out = broken.unionByName(good.select("file", F.lit("").alias("place"), F.explode(_rules(form, F.col("data"), F.col("v"))).alias("rule")))
    for name, inner in form.lists.items():
        entries = good.select("file", F.posexplode(_value(F.col("v"), name, "array<variant>")).alias("i", "v"))
        rows = entries.select("file", F.concat(F.lit(f"{name} "), F.col("i") + 1).alias("place"), F.to_json("v").alias("data"), "v")
        out = out.unionByName(rows.select("file", "place", F.explode(_rules(inner, F.col("data"), F.col("v"))).alias("rule")))
        if inner.numbered:
            number = _value(F.col("v"), inner.numbered)
            twice = rows.groupBy("file", number.alias("number")).agg(F.count("*").alias("n"), F.min("place").alias("place")).where("n > 1 and number is not null")
            out = out.unionByName(twice.select("file", F.lit(name).alias("place"), F.lit(f"{inner.numbered}: used twice").alias("rule")).distinct())
    return out


def outcomes(files: DataFrame, found: DataFrame) -> DataFrame:
    """(file, n_problems, loads): a record loads only if no file has a problem."""
    n = files.select("file").join(found.groupBy("file").agg(F.count("*").alias("n")), "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("n_problems"))
    any_ = found.agg((F.count("*") == 0).alias("loads"))
    return n.crossJoin(F.broadcast(any_))  # one row


def misfiled(files: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """(file, rule) of interviews (file, data): the id, the file's name and the province's prefix must agree, and consent precede the interview."""
    v = F.try_parse_json("data")
    id_, province = _value(v, "informant_id"), _value(v, "province_code")
    expected = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])[province]
    prefix = F.coalesce(F.regexp_extract(id_, "^INT_([A-Z]{3})_[0-9]{3}$", 1), F.lit(""))
    found = [
        ("informant_id: not like INT_ABC_001", prefix == ""),
        ("informant_id: not the file's name", (prefix != "") & (id_ != F.col("file"))),
        ("province_code: not a fieldwork province", expected.isNull()),
        ("informant_id: not the province's prefix", (prefix != "") & (prefix != expected)),
        ("consent_date: after interview_date", F.try_to_date(_value(v, "consent_date"), "yyyy-MM-dd") > F.try_to_date(_value(v, "interview_date"), "yyyy-MM-dd")),
    ]
    return files.select("file", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in found]))).alias("rule"))


def linked(records: DataFrame, recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (file, recipe_id, province) to recipes (recipe_id, register, province) that are not official ones, and official ones of another province."""
    of = recipes.select("recipe_id", "register", F.col("province").alias("of_province"))
    both = records.where("recipe_id is not null").join(of, "recipe_id", "left")
    official = F.coalesce(F.col("register") == "official", F.lit(False))
    return both.where(~official).select("file", "recipe_id"), both.where(official & (F.col("province") != F.col("of_province"))).select("file", "recipe_id", "province", "of_province")


def counted_twice(transcribed: DataFrame, parsed: DataFrame) -> DataFrame:
    """Documents that were transcribed though the parser has loaded them; must be empty."""
    return transcribed.select("document").distinct().join(parsed.select("document"), "document", "left_semi")


# The three hand-written forms.
LEVELS = ("lost", "near_lost", "transmitted")
DISH = Form(
    texts=("name_th", "cook_status_verbatim", "distinctiveness_claim", "stated_absence", "stated_substitutions", "differs_from_bangkok", "validation_notes"),
    required=("dish_no", "name_th"), integers=("dish_no", "official_recipe_id"), choices={"cook_status_level": LEVELS}, strings=("ingredients",), numbered="dish_no",
)
ANSWER = Form(texts=("still_made", "who_makes", "young_people_know", "notes"), required=("official_recipe_id",), integers=("official_recipe_id",), numbered="official_recipe_id")
INTERVIEW = Form(
    texts=("informant_id", "province_code", "district", "role"), required=("informant_id", "province_code", "district", "consent_date", "interview_date", "dishes"),
    choices={"age_bracket": ("lt40", "40_60", "gt60"), "acquisition_mode": ("grown", "foraged", "market", "packaged")},
    dates=("consent_date", "interview_date"), true=("consent_form",), lists={"dishes": DISH, "q10": ANSWER},
)
ROW = Form(texts=("name_th", "quantity_value", "quantity_unit", "acquisition_raw"), most=300, required=("name_th",))
MANUAL = Form(
    texts=("dish_name_th", "province_th", "district_th", "dish_category_source", "occasion_th", "notes"), most=300, required=("dish_name_th", "province_th", "transcribed_on", "ingredients"),
    choices={"endangerment": LEVELS}, dates=("transcribed_on",), lists={"ingredients": ROW},
)
FIDELITY = ("survived", "degraded", "lost")
COOKED = Form(
    texts=("missing_ingredients", "substitutions_made", "normalization_losses", "notes"), required=("recipe_id", "cook_date"), integers=("recipe_id",), dates=("cook_date",),
    flags=("result_recognizable", "classifier_gets_wrong"), choices={f"fidelity_{x}": FIDELITY for x in ("quantities", "order", "technique", "specificity", "completeness")},
)
