"""Heuristic extraction: mentions of threads, materials and designations in texts, as elements of low confidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import pattern, snippet

ELEMENT = ("item_id", "name", "size", "material", "designation", "note", "source", "confidence", "raw_text_fragment")
#: Any metric thread, and what elements are called.
THREAD = r"\bM\d+(?:[x×]\d+(?:[.,]\d+)?)?\b"
NAMES = {"size": "Резьба (найдена в тексте)", "material": "Материал (найден в тексте)", "designation": "Обозначение (найдено в тексте)"}
NOTES = {
    "listed": "Извлечено эвристикой по совпадению с допустимыми значениями ТЗ",
    "thread": "Извлечено эвристикой по шаблону M…",
    "unlisted": "Извлечено эвристикой; может не входить в допустимые по ТЗ",
    "material": "Извлечено эвристикой по вхождению марки в текст",
    "designation": "Извлечено эвристикой по regex из rules.json",
}


def _element(text: Column, kind: str, value: Column, note: Column, prefix: str = "") -> Column:
    own = {k: (value if k == kind else F.lit(None).cast("string")) for k in ("size", "material", "designation")}
    made = {"item_id": F.concat(F.lit(f"эвристика:{prefix}"), value), "name": F.lit(NAMES[kind]), **own, "note": note, "source": F.lit("combined"), "confidence": F.lit("low"), "raw_text_fragment": snippet(text, value)}
    return F.struct(*[made[k].cast("string").alias(k) for k in ELEMENT])


def first_of_each(values: Column, key=lambda x: x) -> Column:
    """values without those whose key came before."""
    keys = F.transform(values, key)
    return F.filter(values, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def elements_of(text: Column, rules: dict) -> Column:
    """Array of elements: listed threads, other threads as they come, materials, designations."""
    bolts = [d for d in rules.get("dimensions", []) if d.get("field") == "bolt_size"][:1]
    threads: dict[str, str] = {}
    for v in map(str, [v for d in bolts for v in d.get("allowed_values", [])]):
        threads.setdefault(v.lower(), v)
    threads = list(threads.values())
    listed = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(text.rlike(pattern(re.escape(v).replace("x", "[x×X]"), True)), v) for v in threads]))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern(THREAD, True)), 0), lambda m: F.replace(m, F.lit("×"), F.lit("x")))
    low = F.transform(listed, F.lower)
    others = F.filter(first_of_each(found, F.lower), lambda m: ~F.array_contains(low, F.lower(m)))
    known = F.array(*[F.lit(v.lower()) for v in threads]) if threads else F.array().cast("array<string>")
    own = rules.get("materials", {})
    named = list(dict.fromkeys(m for m in own.get("allowed", []) + own.get("forbidden", []) if m and len(m) >= 2))
    materials = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(text.contains(m), m) for m in named]))
    marks = F.array().cast("array<string>")
    if p := rules.get("designations", {}).get("pattern"):
        marks = first_of_each(F.regexp_extract_all(text, F.lit(pattern(p)), 0))
    return F.concat(
        F.transform(listed, lambda v: _element(text, "size", v, F.lit(NOTES["listed"]))),
        F.transform(others, lambda v: _element(text, "size", v, F.when(F.array_contains(known, F.lower(v)), NOTES["thread"]).otherwise(NOTES["unlisted"]))),
        F.transform(materials, lambda v: _element(text, "material", v, F.lit(NOTES["material"]), "мат-")),
        F.transform(marks, lambda v: _element(text, "designation", v, F.lit(NOTES["designation"]))),
    )


def extracted(texts: DataFrame, rules: dict) -> DataFrame:
    """drawing_id, pos (from 0) and the element columns of each mention. texts: drawing_id, text."""
    if not rules:
        return texts.sparkSession.createDataFrame([], f"drawing_id {texts.schema['drawing_id'].dataType.simpleString()}, pos int, " + ", ".join(f"{c} string" for c in ELEMENT))
    return texts.where("text is not null").select("drawing_id", F.posexplode(elements_of(F.col("text"), rules)).alias("pos", "e")).select("drawing_id", "pos", "e.*")
