"""Language-model replies as reports: JSON read as VARIANT, so that wrongly typed fields can be told from right ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTS = ("item_id", "name", "element_type", "size", "material", "designation", "note", "raw_text_fragment")
ISSUE_TEXTS = ("field", "actual_value", "expected", "message", "tz_reference")
SOURCES, LEVELS = ("pdf_text", "ocr", "llava_caption", "combined"), ("high", "medium", "low")
NO_JSON = "LLM не вернул валидный JSON — результат ненадёжен"
BAD_JSON = "Ошибка парсинга JSON от LLM"


def _get(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _texts_only(v: Column, names: tuple[str, ...], never_null: tuple[str, ...] = ()) -> Column:
    """Whether v is an object whose named fields are strings, absent or, but for those never null, null."""
    fine = _kind(v).startswith("OBJECT")
    for n in names:
        kind = F.schema_of_variant(_get(v, n, "variant"))  # null where absent
        fine = fine & (kind.isNull() | kind.isin("STRING", *["VOID"] * (n not in never_null)))
    return fine


def one_of(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def tri_state(v: Column) -> Column:
    """JSON booleans, and the words true and false in any case; else null."""
    kind, said = _kind(v), F.lower(F.try_variant_get(v, "$", "string"))
    return F.when(kind.isin("BOOLEAN", "STRING") & (said == "true"), True).when(kind.isin("BOOLEAN", "STRING") & (said == "false"), False)


def _number(x: Column) -> Column:
    """A JSON number as text: whole numbers that were written with a fraction keep one zero of it."""
    plain = F.try_variant_get(x, "$", "string")
    # whole numbers are BIGINT, or decimals of more digits than that has
    return F.when(_kind(x).rlike(r"^DECIMAL\((\d|1[0-8]),") & ~plain.contains("."), F.concat(plain, F.lit(".0"))).otherwise(plain)


def text_list(v: Column, keys: tuple[str, ...]) -> Column:
    """A list of texts from a list, one other value or nothing. Of a list's objects the first of keys that has something,
    else their JSON; an object that stands alone is one text, its JSON."""

    def said(x: Column) -> Column:
        own = F.coalesce(*[F.nullif(_get(x, k), F.lit("")) for k in keys])
        plain = F.try_variant_get(x, "$", "string")
        word = F.when(_kind(x) == "BOOLEAN", F.initcap(plain)).when(_kind(x) == "VOID", "None").when(_kind(x) == "STRING", plain).otherwise(_number(x))
        return F.when(_kind(x).startswith("OBJECT"), F.coalesce(own, F.to_json(x))).when(_kind(x).startswith("ARRAY"), F.to_json(x)).otherwise(word)

    several = F.transform(F.try_variant_get(v, "$", "array<variant>"), said)
    return F.when(_kind(v) == "VOID", F.array().cast("array<string>")).when(_kind(v).startswith("ARRAY"), several).when(_kind(v).startswith("OBJECT"), F.array(F.to_json(v))).otherwise(F.array(said(v)))


def reply_confidence(n: Column, low: Column, compliant: Column) -> Column:
    return F.when((n == 0) | (low > F.floor(n / 2)), "low").when((low > 0) | compliant.isNull(), "medium").otherwise("high")


def parsed(replies: DataFrame, keep: tuple[str, ...] = ("drawing_id",)) -> DataFrame:
    """The columns in keep, elements, standard, is_compliant, issues, missing_info, citations, overall_confidence of each reply (raw).

    The JSON is what stands from the first brace to the last. Elements with a field that should be text but isn't are
    dropped, and issues whose field or message is null too; unknown sources and levels become the defaults. A null list or
    object counts as absent.
    """
    found = F.regexp_extract(F.coalesce("raw", F.lit("")), r"\{[\s\S]+\}", 0)
    read = replies.select(*keep, found.alias("found")).withColumn("v", F.try_parse_json(F.nullif("found", F.lit(""))))
    v = F.col("v")
    about = _get(v, "compliance", "variant")
    listed = lambda x, n: F.coalesce(_get(x, n, "array<variant>"), F.array().cast("array<variant>"))

    def element(e: Column) -> Column:
        level = one_of(_get(e, "confidence"), LEVELS, "medium")
        return F.struct(*[_get(e, n).alias(n) for n in TEXTS], one_of(_get(e, "source"), SOURCES, "pdf_text").alias("source"), level.alias("confidence"))

    def issue(i: Column) -> Column:
        default = {"field": "unknown", "message": ""}
        return F.struct(*[(F.coalesce(_get(i, n), F.lit(default[n])) if n in default else _get(i, n)).alias(n) for n in ISSUE_TEXTS])

    made = read.select(
        *keep,
        F.transform(F.filter(listed(v, "elements"), lambda e: _texts_only(e, TEXTS)), element).alias("elements"),
        _get(about, "standard").alias("standard"),
        tri_state(_get(about, "is_compliant", "variant")).alias("is_compliant"),
        F.transform(F.filter(listed(about, "issues"), lambda i: _texts_only(i, ISSUE_TEXTS, ("field", "message"))), issue).alias("issues"),
        F.when(F.col("found") == "", F.array(F.lit(NO_JSON))).when(v.isNull(), F.array(F.lit(BAD_JSON))).otherwise(text_list(_get(about, "missing_info", "variant"), ("field", "text"))).alias("missing_info"),
        text_list(_get(about, "citations", "variant"), ("text", "field")).alias("citations"),
    )
    low = F.size(F.filter("elements", lambda e: e["confidence"] == "low"))
    return made.withColumn("overall_confidence", reply_confidence(F.size("elements"), low, F.col("is_compliant")))
