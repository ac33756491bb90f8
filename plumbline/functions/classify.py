"""Page classification as Column builders: scores of markers, a winner by margin, and advertising above all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import collapse, contains_any, matches_normalised, normalised, pattern


@dataclass(frozen=True)
class Markers:
    """What scores are made of. The defaults are fixed values."""

    drawing_strong: tuple[str, ...] = (
        r"черт[её]ж\s*№",
        r"черт[её]ж\s+",
        r"рабочий\s+черт[её]ж",
        r"план\s+(этажа|помещен|кровли|фасада|осей)",
        r"схема\s+(этажа|расположения|осей|коллектор)",
        r"план\s*[-–—]\s*",
    )
    drawing_weak: tuple[str, ...] = (r"\bплан\b", r"\bсхема\b", r"\bчерт[её]ж\b", r"\bразрез\b", r"\bфасад\b")
    explication_strong: tuple[str, ...] = (r"экспликац(?:ия|ии)\s+помещен", r"таблица\s+экспликац")
    explication_weak: tuple[str, ...] = (r"\bэкспликац", r"площад[ьи]\s+помещен", r"наименовани[ея]\s+помещен")
    annotation: tuple[str, ...] = (r"примечани", r"условн(?:ые|ых)\s+обозначен", r"масштаб\s*1\s*[:]", r"\bразмеры\b", r"\bлегенда\b", r"сокращени[ея]")
    project: tuple[str, ...] = (
        r"заказчик",
        r"застройщик",
        r"объект\s+капитального\s+строительства",
        r"наименовани[ея]\s+объекта",
        r"площадк[аи]\s+строительства",
        r"сведени[яь]\s+о\s+застройщике",
        r"состав\s+проектной\s+документации",
        r"задани[ея]\s+на\s+проектирование",
        r"шифр\s+проекта",
        r"гип[\s\.]",
        r"главный\s+инженер\s+проекта",
        r"технико-экономическ(?:ие|их)\s+показател",
    )
    project_weak: tuple[str, ...] = (r"проектная\s+документаци", r"пояснительн\w*\s+записк", r"разрешени[ея]\s+на\s+строительство")
    dimensions: str = r"\d{2,4}\s*[xх×]\s*\d{2,4}|\d+\s*[=≈]\s*\d+"
    ad_phrases: tuple[str, ...] = ("реклама", "фото здания", "фотография здания", "сайт:", "www.", "http://", "https://")
    ad_author: str = r"\bАВТОР\b"
    ad_soft: tuple[str, ...] = ("скидк", "акци", "купить", "заказать", "телефон:", "объявлен")
    project_sheet: str = r"лист\s*1\s*из"
    project_sheet_with: tuple[str, ...] = ("пояснительн", "проектная документаци", "наименование объекта", "задание на проектирование", "состав проектной документации")
    project_notes: tuple[str, ...] = ("пояснительная записка к проекту", "пояснительная записка к архитектурно")


RUSSIAN = Markers()
CONFIDENT, MARGIN = 0.52, 0.12
FLAGS = ("is_drawing", "is_explication", "is_annotation", "is_project_info", "is_irrelevant_photo_or_ad")


def features(pages: DataFrame, text: str = "pdf_text") -> DataFrame:
    """Adds text, text_upper and char_count of a page's raw text."""
    raw = F.coalesce(pages[text], F.lit(""))
    return pages.withColumns({"text": normalised(raw), "text_upper": F.upper(collapse(raw))}).withColumn("char_count", F.length("text"))


def two_tiers(text: Column, strong: tuple, weak: tuple, high: float, low: float) -> Column:
    return F.when(matches_normalised(text, strong), high).when(matches_normalised(text, weak), low).otherwise(0.0)


def is_advertising(text: Column, upper: Column, m: Markers = RUSSIAN) -> Column:
    return contains_any(text, m.ad_phrases) | upper.rlike(pattern(m.ad_author))


#: The weights and limits below are fixed values.
def scores(text: Column, upper: Column, chars: Column, ratio: Column, images: Column, m: Markers = RUSSIAN) -> dict[str, Column]:
    drawing = two_tiers(text, m.drawing_strong, m.drawing_weak, 0.88, 0.42)
    hits = sum((matches_normalised(text, (p,)).cast("int") for p in m.annotation), F.lit(0))
    noted = F.greatest(F.when(hits > 0, 0.35 + F.least(F.lit(0.45), 0.12 * hits)).otherwise(0.0), F.when(matches_normalised(text, (m.dimensions,)), 0.4).otherwise(0.0))
    few = chars < 220
    photo = [
        F.when(contains_any(text, m.ad_soft), 0.35),
        F.when(few & ((ratio >= 0.38) | (images >= 2)), 0.55),
        F.when((chars < 80) & (images >= 1), 0.45),
        F.when(is_advertising(text, upper, m), 0.95),
    ]
    return {
        "drawing": drawing,
        "explication": two_tiers(text, m.explication_strong, m.explication_weak, 0.90, 0.48),
        "annotation": F.when(drawing > 0, 0.0).otherwise(noted),
        "ad": F.coalesce(F.greatest(F.lit(0.0), *photo), F.lit(0.0)),
    }


def project_score(text: Column, m: Markers = RUSSIAN) -> Column:
    return two_tiers(text, m.project, m.project_weak, 0.82, 0.44)


def classified(pages: DataFrame, m: Markers = RUSSIAN) -> DataFrame:
    """Adds the five flags to pages with text, text_upper, char_count, image_area_ratio and image_count.

    A page is what its best score says, if that is high and ahead of the next. Advertising phrases make it
    advertising and nothing else. A page of no other kind, or one of annotations, can be project information.
    """
    s = scores(*(F.col(c) for c in ("text", "text_upper", "char_count", "image_area_ratio", "image_count")), m)
    scored = pages.withColumns({f"_{k}": v for k, v in s.items()} | {"_ads": is_advertising(F.col("text"), F.col("text_upper"), m), "_project": matches_normalised(F.col("text"), m.project)})
    ranked = F.sort_array(F.array(*[F.col(f"_{k}") for k in s]), asc=False)
    scored = scored.withColumn("_best", F.when((ranked[0] >= CONFIDENT) & (ranked[0] - ranked[1] >= MARGIN), ranked[0]))
    wins = lambda k: ~F.col("_ads") & F.coalesce(F.col(f"_{k}") == F.col("_best"), F.lit(False))
    flags = {
        "is_drawing": wins("drawing"),
        "is_explication": wins("explication"),
        "is_annotation": wins("annotation"),
        "is_project_info": ~F.col("_ads") & F.col("_project") & (F.col("_best").isNull() | wins("annotation")),
        "is_irrelevant_photo_or_ad": F.col("_ads") | wins("ad"),
    }
    return scored.withColumns(flags).drop(*[f"_{k}" for k in s], "_ads", "_project", "_best")


def begins_new_project(text: Column, m: Markers = RUSSIAN) -> Column:
    """Whether a page (normalised text) starts another project's part of an album."""
    head = F.substring(text, 1, 1800)
    return (matches_normalised(head, (m.project_sheet,)) & contains_any(head, m.project_sheet_with)) | contains_any(head, m.project_notes)


def image_metrics(images: DataFrame, page_area: str = "page_area") -> DataFrame:
    """doc_id, page_number, image_area_ratio, image_count from one row for each placed image (xref, width and height of
    what lies on the page)."""
    area = F.greatest(F.col("width"), F.lit(0.0)) * F.greatest(F.col("height"), F.lit(0.0))
    total = F.max(page_area)
    return images.groupBy("doc_id", "page_number").agg(F.when(total > 0, F.least(F.lit(1.0), F.sum(area) / total)).otherwise(0.0).alias("image_area_ratio"), F.count_distinct("xref").alias("image_count"))


def has_graphics(rects: Column, paths: Column) -> Column:
    """Whether a page has an image of 10,000 units or over five vector paths."""
    return F.exists(rects, lambda r: r["width"] * r["height"] >= 10_000) | (paths > 5)


def _clipped(low: str, high: str, page_low: str, page_high: str) -> Column:
    """The length of what a side has in common with the page's; 0 where that is nothing."""
    return F.greatest(F.least(high, page_high) - F.greatest(low, page_low), F.lit(0.0))


def placed_metrics(images: DataFrame) -> DataFrame:
    """doc_id, page_number, image_area_ratio, image_count from one row for each rectangle of an image.

    images: xref, left, top, right, bottom, and page_left, page_top, page_right, page_bottom. What lies beside the page does
    not count as area, but an image with any rectangle counts as one; without rectangles (nulls) it does not. A page without
    an area has neither.
    """
    width, height = F.col("page_right") - F.col("page_left"), F.col("page_bottom") - F.col("page_top")
    common = _clipped("left", "right", "page_left", "page_right") * _clipped("top", "bottom", "page_top", "page_bottom")
    placed = F.col("left").isNotNull() & F.col("top").isNotNull() & F.col("right").isNotNull() & F.col("bottom").isNotNull()
    whole = F.max(F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0)))
    found = images.groupBy("doc_id", "page_number").agg(whole.alias("_page"), F.sum(F.when(placed, common)).alias("_area"), F.count_distinct(F.when(placed, F.col("xref"))).alias("_images"))
    ratio = F.least(F.lit(1.0), F.coalesce("_area", F.lit(0.0)) / F.nullif("_page", F.lit(0.0)))
    return found.select("doc_id", "page_number", F.when(F.col("_page") > 0, ratio).otherwise(0.0).alias("image_area_ratio"), F.when(F.col("_page") > 0, F.col("_images")).otherwise(0).alias("image_count"))


def page_graphics(images: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_id, page_number, has_drawings of each page of paths (doc_id, page_number, n_paths): the first rectangle (by place)
    of an image has 10,000 units or more, or there are over five paths. images: xref, place, left, top, right, bottom."""
    area = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    first = images.groupBy("doc_id", "page_number", "xref").agg(F.min_by(area, F.col("place")).alias("_area"))
    large = first.groupBy("doc_id", "page_number").agg((F.max("_area") >= 10_000).alias("_large"))
    return paths.join(large, ["doc_id", "page_number"], "left").select("doc_id", "page_number", (F.coalesce("_large", F.lit(False)) | (F.col("n_paths") > 5)).alias("has_drawings"))
