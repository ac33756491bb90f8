"""Segmentation of albums by window functions: drawings, projects, and checks of the split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plumbline.functions.text import project_slug
from plumbline.operators.names import free_names


def by_page() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("page_number")


def segments(pages: DataFrame, respect_projects: bool = True) -> DataFrame:
    """Adds at (place in the album, from 1) and segment (from 1): a page that begins a project begins a segment."""
    first = F.row_number().over(by_page())
    breaks = F.when(F.col("begins_new_project") & (F.col("at") > 1), 1).otherwise(0)
    placed = pages.withColumn("at", first)
    return placed.withColumn("segment", F.sum(breaks).over(by_page()) + 1 if respect_projects else F.lit(1))


def drawing_runs(pages: DataFrame, inner_gap: int = 3, edge: int = 2, respect_projects: bool = True) -> DataFrame:
    """Pages of runs that hold a drawing: all columns of pages, at, segment, zone and run.

    Advertising pages cut a segment into zones. In a zone, pages with content that are at most inner_gap unknown pages
    apart form a run with the pages between; the unknown pages before the first and after the last run join it if
    they are at most edge, or else none does.
    """
    ad, content = F.col("is_irrelevant_photo_or_ad"), F.expr("is_drawing or is_explication or is_annotation or is_project_info")
    own = Window.partitionBy("doc_id", "segment").orderBy("at")
    zoned = segments(pages, respect_projects).withColumn("zone", F.sum(ad.cast("int")).over(own)).where(~ad)
    zone = Window.partitionBy("doc_id", "segment", "zone")
    forward, back = zone.orderBy("at"), zone.orderBy(F.col("at").desc())
    kept = F.when(content, F.col("at"))
    # the content on both sides of each page, itself included, and the zone's first and last
    seen = zoned.withColumns({"_before": F.max(kept).over(forward), "_earlier": F.max(kept).over(forward.rowsBetween(Window.unboundedPreceding, -1)), "_after": F.min(kept).over(back)})
    seen = seen.withColumns({"_first": F.min(kept).over(zone), "_last": F.max(kept).over(zone), "_low": F.min("at").over(zone), "_high": F.max("at").over(zone)})
    new = content & (F.col("_earlier").isNull() | (F.col("at") - F.col("_earlier") - 1 > inner_gap))
    seen = seen.withColumn("_island", F.sum(new.cast("int")).over(forward))
    inside = F.col("_after") - F.col("_before") - 1 <= inner_gap
    run = (
        F.when(content, F.col("_island"))
        .when(F.col("_before").isNull() & (F.col("_first") - F.col("_low") <= edge), 1)
        .when(F.col("_after").isNull() & (F.col("_high") - F.col("_last") <= edge), F.col("_island"))
        .when(inside, F.col("_island"))
    )
    runs = seen.withColumn("run", run).where("run is not null")
    drawn = runs.withColumn("_drawn", F.bool_or("is_drawing").over(Window.partitionBy("doc_id", "segment", "zone", "run"))).where("_drawn")
    return drawn.drop("_before", "_earlier", "_after", "_first", "_last", "_low", "_high", "_island", "_drawn")


def drawing_files(pages: DataFrame, most_pages: int | None = 48, inner_gap: int = 3, edge: int = 2, respect_projects: bool = True, taken: DataFrame | None = None) -> DataFrame:
    """doc_id, seq, segment, run_first, first_page, last_page, n_pages, pages, stem of each output drawing.

    pages has a label for each page. Runs over most_pages pages are cut, and their names numbered by seq; of names that
    come again, or that taken (doc_id, name: files that are there) has, the first free one with _1, _2 and so on is used.
    """
    if most_pages is not None and most_pages < 1:
        raise ValueError("most_pages must be at least 1")
    run = ["doc_id", "segment", "zone", "run"]
    paged = drawing_runs(pages, inner_gap, edge, respect_projects)
    number = F.row_number().over(Window.partitionBy(*run).orderBy("at"))
    paged = paged.withColumn("part", F.floor((number - 1) / most_pages) if most_pages else F.lit(0))
    labelled = F.coalesce(F.min_by("label", F.when(F.col("is_drawing"), F.col("at"))), F.min_by("label", "at"))
    files = paged.groupBy(*run, "part").agg(F.min("at").alias("first"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count("*").alias("n_pages"), F.sort_array(F.collect_list("page_number")).alias("pages"), labelled.alias("label"))
    whole = Window.partitionBy(*run)
    files = files.withColumns({"run_first": F.min("first_page").over(whole), "cut": F.count("*").over(whole) > 1, "seq": F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))})
    prefix = F.format_string("p%02d_", F.col("segment")) if respect_projects else F.lit("")
    stem = F.concat(F.lit("drawing_"), prefix, "label", F.when(F.col("cut"), F.format_string("_p%03d", F.col("seq"))).otherwise(""))
    named = files.select("doc_id", "seq", "segment", "run_first", "first_page", "last_page", "n_pages", "pages", stem.alias("stem"))
    return free_names(named, "stem", "seq", taken, ("doc_id",))


def drawing_pages(pages: DataFrame) -> DataFrame:
    """doc_id, total_pages and pages_with_drawings (has_drawings) of each document."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.count_if("has_drawings").alias("pages_with_drawings"))


def project_boundaries(pages: DataFrame) -> DataFrame:
    """doc_id, start_page, end_page, signature of each project: a page with another signature than the last one that
    was seen begins one. Pages before the first signature belong to none."""
    total = Window.partitionBy("doc_id")
    signed = pages.withColumn("page_count", F.max("page_number").over(total)).where("signature is not null")
    before = F.lag("signature").over(by_page())
    starts = signed.withColumn("before", before).where("before is null or before <> signature")
    end = F.coalesce(F.lead("page_number").over(by_page()) - 1, F.col("page_count"))
    return starts.select("doc_id", F.col("page_number").alias("start_page"), end.alias("end_page"), "signature")


def named_projects(boundaries: DataFrame) -> DataFrame:
    """Adds stem: the signature's slug, with _2, _3 and so on where an album has it again."""
    slugged = boundaries.withColumn("slug", project_slug(F.col("signature")))
    return with_stems(slugged, "slug")


def with_stems(rows: DataFrame, slug: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("doc_id", slug).orderBy("start_page"))
    return rows.withColumn("number", number).withColumn("stem", F.when(F.col("number") == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("_"), F.col("number").cast("string")))).drop("number", slug)


def pages_of_projects(pages: DataFrame, boundaries: DataFrame) -> DataFrame:
    """pages with the stem of the project that they lie in, by a range join within an album."""
    b = boundaries.select(F.col("doc_id").alias("_doc"), "start_page", "end_page", "stem")
    return pages.join(b, (F.col("doc_id") == F.col("_doc")) & F.col("page_number").between(F.col("start_page"), F.col("end_page"))).drop("_doc", "start_page", "end_page")


def checked_files(pages: DataFrame) -> DataFrame:
    """file, n_pages, status, reason of each split file. pages: file, page_number, the flags, support_text;
    error, if there is such a column: why a file could not be opened, in a row without a page."""
    ads = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("is_irrelevant_photo_or_ad"), F.col("page_number")))), lambda p: p.cast("string")), ", ")
    error = [F.max("error").alias("error")] if "error" in pages.columns else []
    found = pages.groupBy("file").agg(*error, F.count("page_number").alias("n_pages"), F.bool_or("is_drawing").alias("drawn"), ads.alias("ads"), F.bool_or(F.col("is_annotation") | F.col("is_explication") | F.col("is_project_info") | F.col("support_text")).alias("supported"))
    reason = F.concat_ws(
        "; ",
        F.when(~F.col("drawn"), "ни одна страница не распознана как чертёж"),
        F.when(F.col("ads") != "", F.concat(F.lit("страницы с маркерами рекламы/фото: "), "ads")),
        F.when((F.col("n_pages") >= 2) & ~F.col("supported"), "несколько страниц без экспликации/примечаний и без явных размеров/масштаба в тексте"),
    )
    if "error" in pages.columns:
        # a file that could not be opened has one row with its error
        failed = F.concat(F.lit("не удалось открыть или обработать PDF: "), "error")
        reason = F.when(F.col("error").isNotNull(), failed).otherwise(reason)
    fine = "чертёж найден, реклама/фото не обнаружены, контент выглядит согласованным"
    return found.select("file", "n_pages", F.when(reason == "", "ok").otherwise("suspicious").alias("status"), F.when(reason == "", fine).otherwise(reason).alias("reason"))


def split_advice(checked: DataFrame) -> DataFrame:
    """total, suspicious and advice (empty, none, few, many or some) over all files."""
    n, s = F.col("total"), F.col("suspicious")
    advice = F.when(n == 0, "empty").when(s == 0, "none").when(s <= F.greatest(F.lit(1), F.floor(n / 5)), "few").when(s >= F.greatest(F.lit(2), F.floor(n * 0.4)), "many").otherwise("some")
    return checked.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "suspicious").alias("suspicious")).withColumn("advice", advice)
