"""Overlapping chunks of texts, folded paragraph by paragraph inside each row; the rules as sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import pattern, strip

SIZE, OVERLAP = 500, 100


def _join(a: Column, sep: str, b: Column) -> Column:
    return strip(F.concat(a, F.lit(sep), b))


def chunks_of(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of chunks. Paragraphs fill a chunk up to size; the next begins with the last overlap characters. A first
    paragraph that is too long is split by sentences, without overlap."""
    paragraphs = F.filter(F.transform(F.split(text, pattern(r"\n\s*\n")), strip), lambda p: p != "")
    state = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))
    make = lambda now, done: F.struct(now.alias("now"), done.alias("done"))
    shut = lambda s: F.when(s["now"] != "", F.array_append(s["done"], s["now"])).otherwise(s["done"])

    def sentence(s: Column, x: Column) -> Column:
        fits = F.length(s["now"]) + F.length(x) <= size
        return make(F.when(fits, _join(s["now"], " ", x)).otherwise(x), F.when(fits, s["done"]).otherwise(shut(s)))

    def paragraph(s: Column, p: Column) -> Column:
        split = F.aggregate(F.split(p, pattern(r"(?<=[.!?])\s+")), s, sentence)
        tail = F.substring(s["now"], F.greatest(F.length(s["now"]) - overlap + 1, F.lit(1)), F.lit(overlap)) if overlap else s["now"]
        return (
            F.when(F.length(s["now"]) + F.length(p) <= size, make(_join(s["now"], "\n\n", p), s["done"]))
            .when(s["now"] != "", make(_join(tail, "\n\n", p), shut(s)))
            .otherwise(split)
        )

    return F.aggregate(paragraphs, state, paragraph, shut)


def chunked(docs: DataFrame, source: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """source, chunk_id (from 0), text of each chunk of docs (its column source, and text)."""
    return docs.select(F.col(source).alias("source"), F.posexplode(chunks_of(F.coalesce("text", F.lit("")), size, overlap)).alias("chunk_id", "text"))


def rules_text(rules: dict) -> str:
    """The rules as sentences, for the index."""
    lines = ["=== Машиночитаемые правила ТЗ ===\n"]
    get = lambda d, k: d.get(k, "")
    for d in rules.get("dimensions", []):
        about = f"Поле '{d['field']}' ({get(d, 'description')}): "
        tail = f"Стандарт: {get(d, 'standard')}. Ссылка: {get(d, 'tz_reference')}."
        if "allowed_values" in d:
            lines.append(f"{about}допустимые значения: {', '.join(d['allowed_values'])}. Единица: {get(d, 'unit')}. {tail}")
        elif "min" in d and "max" in d:
            lines.append(f"{about}диапазон {d['min']}–{d['max']} {get(d, 'unit')}. {tail}")
    if m := rules.get("materials"):
        lines.append(f"Материалы: допустимые: {', '.join(m.get('allowed', []))}. Запрещённые: {', '.join(m.get('forbidden', []))}. Стандарт: {get(m, 'standard')}. Ссылка: {get(m, 'tz_reference')}.")
    if m := rules.get("designations"):
        lines.append(f"Обозначения: паттерн '{get(m, 'pattern')}'. Примеры: {', '.join(m.get('examples', []))}. Ссылка: {get(m, 'tz_reference')}.")
    if m := rules.get("coatings"):
        lines.append(f"Покрытия: допустимые коды: {', '.join(m.get('allowed_codes', []))}. Стандарт: {get(m, 'standard')}. Ссылка: {get(m, 'tz_reference')}.")
    return "\n".join(lines)
