"""Text functions as Column builders. Patterns follow Python's Unicode rules: case, \\w, \\s, \\b and $ alike."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

CYRILLIC, LATIN = r"[\x{0400}-\x{04FF}]", "[A-Za-z]"
#: Fixed value: words that hint at a title page.
TITLE_HINTS = ("жилой", "дом", "мансард", "этажн", "гараж", "арболит", "брус", "кирпич", "одноэтаж", "двухэтаж", "вариант", "стен")
#: Fixed value: a project's title line.
PROJECT_TITLE = (
    r"(?:ЖИЛОЙ\s+ДОМ(?:\s*\(\s*[\d\.,]+\s*[хx×]\s*[\d\.,]+\s*\))[^\n]{0,400}"
    r"|ЖИЛОЙ\s+ДОМ[^\n]{0,120}?[\d\.,]+\s*[хx×]\s*[\d\.,]+(?:\s*м\b)?[^\n]{0,280}"
    r"|(?:ДВУХЭТАЖНЫЙ|ОДНОЭТАЖНЫЙ|МАНСАРДНЫЙ|Двухэтажный|Одноэтажный|Мансардный)\s+жилой\s+дом[^\n]{0,400}?(?:\(\s*[\d\.,]+\s*[хx×]\s*[\d\.,]+\s*\)|[\d\.,]+\s*[хx×]\s*[\d\.,]+(?:\s*м\b)?)[^\n]{0,320}(?:\([^)]{1,200}\))?)"
)
#: Where a sheet's name is looked for.
LABEL_PATTERNS = (r"черт[её]ж\s*(?:№|#)?\s*([^\n]{1,80})", r"(план\s+(?:этажа|осей|фасада|кровли|помещен)[^\n]{0,60})")
LABEL_SHEET = r"\b(\d{1,4}\s*[-–—]\s*[А-ЯA-ZЁё0-9]{1,8})\b"
SUPPORT_PATTERN = r"\d{2,4}\s*[xх×]\s*\d{2,4}|\d+\s*[=≈]\s*\d+|масштаб\s*1\s*[:]"
SUPPORT_WORDS = ("примечани", "условн", "размер", "экспликац", "легенда")
#: Names that a project's name is made of.
STOREYS = (("двух", "2etaj"), ("одно", "1etaj"), ("мансард", "mansard"), (r"жилой\s+дом", "zhdom"))
MATERIALS = (("кирпич", "kirpich"), ("арболит", "arbolit"), ("брус", "brus"), ("каркас", "karkas"), ("тамбур", "tambur"), ("гараж", "garage"))


def pattern(p: str, ignore_case: bool = False) -> str:
    """p with Python's meaning under Java."""
    return ("(?iudU)" if ignore_case else "(?udU)") + p


def either(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def any_match(col: Column, patterns: Iterable[str]) -> Column:
    patterns = tuple(patterns)
    return col.rlike(pattern(either(patterns), True)) if patterns else F.lit(False)


#: Lower-case letters that are another letter's where case is ignored.
FOLDED = r"[\x{017F}\x{1C80}-\x{1C88}]"


def matches_normalised(col: Column, patterns: Iterable[str]) -> Column:
    """any_match for texts in lower case. Patterns without upper-case letters then need no case folding, which is slow;
    plain words need no pattern."""
    patterns = tuple(patterns)
    said = re.sub(r"\\.", "", "".join(patterns))
    if not patterns or said != said.lower():
        return any_match(col, patterns)
    words = [p for p in patterns if not re.search(r"[\\.^$*+?{}\[\]|()]", p)]
    others = [p for p in patterns if p not in words]
    found = contains_any(col, words)
    if others:
        found = found | col.rlike(pattern(either(others)))
    return F.when(col.rlike(FOLDED), any_match(col, patterns)).otherwise(found)


def contains_any(col: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | col.contains(w)
    return found


def strip(col: Column) -> Column:
    return F.regexp_replace(col, pattern(r"^\s+|\s+\z"), "")


def collapse(col: Column) -> Column:
    """Runs of white space, no-break spaces too, as one space; none at the ends."""
    return strip(F.regexp_replace(col, pattern(r"\s+"), " "))


def normalised(col: Column) -> Column:
    return collapse(F.lower(col))


def for_match(col: Column) -> Column:
    """Multiplication signs and Latin x as Cyrillic х; white space collapsed but not stripped."""
    return F.regexp_replace(F.translate(col, " ×xX", " ххх"), pattern(r"\s+"), " ")


def first_number(col: Column) -> Column:
    """The first number in a text, decimal commas allowed; else null."""
    found = F.regexp_extract(F.replace(col, F.lit(","), F.lit(".")), r"[-+]?\d+(?:\.\d+)?", 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def count_of(col: Column, p: str) -> Column:
    return F.regexp_count(col, F.lit(p))


def meaningful_chars(col: Column) -> Column:
    # what is left without them: a count of matches would make a list of them
    return F.length(col) - F.length(F.regexp_replace(col, "[a-zA-Z0-9а-яА-ЯёЁ]++", ""))


def confidence_band(n: Column) -> Column:
    return F.when(n >= 200, "high").when(n >= 50, "medium").otherwise("low")


def snippet(text: Column, needle: Column, radius: int = 80) -> Column:
    at, size = F.instr(text, needle), F.length(needle)
    begin = F.greatest(at - radius, F.lit(1))
    around = F.substring(text, begin, at + size + radius - begin)
    return F.when(at == 0, F.substring(needle, 1, 2 * radius)).otherwise(strip(F.replace(around, F.lit("\n"), F.lit(" "))))


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once, however often it stands in of."""
    return F.get(F.transform(F.array(value), of), 0)


def _some(col: Column) -> Column:
    """A text that is not empty, else null."""
    return once(col, lambda c: F.nullif(c, F.lit("")))


def file_stem(col: Column, most: int = 72) -> Column:
    ends = lambda c: F.regexp_replace(c, r"^[._]+|[._]+\z", "")
    clean = F.regexp_replace(strip(F.regexp_replace(col, r'[<>:"/\\|?*\x00-\x1f]', "_")), pattern(r"\s+"), "_")
    named = F.coalesce(_some(ends(clean)), F.lit("drawing"))
    return F.coalesce(_some(F.regexp_replace(F.substring(named, 1, most), r"[._]+\z", "")), F.lit("drawing"))


def sheet_label(text: Column) -> Column:
    """A sheet's name from its text: drawing number, plan title, sheet number or the first 64 characters."""

    def label(flat: Column) -> Column:
        found = [_some(F.regexp_extract(flat, pattern(p, True), 1)) for p in LABEL_PATTERNS]
        # a digit is looked for before its word's edge
        found.append(_some(F.replace(F.regexp_extract(flat, pattern(r"(?=\d)" + LABEL_SHEET), 1), F.lit(" "), F.lit(""))))
        return F.when(F.coalesce(flat, F.lit("")) == "", "drawing").otherwise(file_stem(F.coalesce(*found, F.substring(flat, 1, 64))))

    return once(collapse(text), label)


def is_garbled(text: Column) -> Column:
    letters, cyrillic = count_of(text, pattern(r"[\w\x{0400}-\x{04FF}]")), count_of(text, CYRILLIC)
    return text.contains("�") | ((letters > 20) & (cyrillic < 0.15 * letters))


def needs_ocr(text: Column, hints: Iterable[str] = TITLE_HINTS) -> Column:
    """Whether a page's text layer is too poor to look for titles in."""
    s = strip(F.coalesce(text, F.lit("")))
    cyrillic, latin = count_of(s, CYRILLIC), count_of(s, LATIN)
    hinted = contains_any(F.lower(for_match(s)), hints)
    poor = ((cyrillic < 5) & (latin >= 25)) | (~hinted & (cyrillic < F.when(F.length(s) >= 120, 20).otherwise(12)))
    return (F.length(s) < 100) | is_garbled(F.coalesce(text, F.lit(""))) | poor


def page_text(raw: Column, ocr: Column, use_ocr: bool = True) -> Column:
    """The text layer, and what OCR read where that was needed."""
    if not use_ocr:
        return raw
    return F.when(needs_ocr(raw) & (strip(F.coalesce(ocr, F.lit(""))) != ""), F.concat(F.coalesce(raw, F.lit("")), F.lit("\n"), ocr)).otherwise(raw)


def project_signature(text: Column, title: str = PROJECT_TITLE) -> Column:
    return F.nullif(collapse(F.regexp_extract(text, "(?siuU)" + title, 0)), F.lit(""))


def project_slug(signature: Column) -> Column:
    low = F.lower(signature)
    storey = F.when(F.lit(False), "")
    for p, slug in STOREYS:
        storey = storey.when(low.rlike(pattern(p)), slug)
    size = r"(\d+[\.,]?\d*)\s*[хx×]\s*(\d+[\.,]?\d*)"
    side = lambda k: F.replace(F.regexp_extract(signature, pattern(size, True), k), F.lit(","), F.lit("."))
    sized = F.when(signature.rlike(pattern(size, True)), F.replace(F.concat(side(1), F.lit("x"), side(2)), F.lit("."), F.lit("_")))

    def keyword(c: Column) -> Column:
        named = F.when(F.lit(False), "")
        for key, slug in MATERIALS:
            named = named.when(c.contains(key), slug)
        return named

    def named(inner: Column) -> Column:
        plain = F.regexp_replace(F.substring(F.regexp_replace(F.lower(inner), pattern(r"[^\w]+"), "_"), 1, 32), r"^_+|_+\z", "")
        return F.coalesce(keyword(F.lower(inner)), F.nullif(plain, F.lit("")))

    inners = F.transform(F.regexp_extract_all(signature, F.lit(r"\(([^)]{1,160})\)"), 1), strip)
    others = F.filter(inners, lambda x: ~x.rlike(pattern(r"^[\d\.,]+\s*[хx×]\s*[\d\.,]+$", True)))
    slugs = F.filter(F.transform(others, named), lambda x: x.isNotNull())
    material = F.coalesce(F.try_element_at(slugs, F.lit(-1)), keyword(low))
    base = F.concat_ws("_", storey, sized, material)
    safe = F.lower(F.regexp_replace(F.regexp_replace(base, pattern(r"[^\w]+"), "_"), r"^_+|_+\z", ""))
    return F.substring(F.concat(F.lit("project_"), F.coalesce(F.nullif(safe, F.lit("")), F.lit("project"))), 1, 120)


def has_support_text(text: Column) -> Column:
    flat = normalised(text)
    return flat.rlike(pattern(SUPPORT_PATTERN, True)) | contains_any(flat, SUPPORT_WORDS)


def base64_line(content: Column) -> Column:
    """Bytes as one line of base64; Spark's own may break lines."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")
