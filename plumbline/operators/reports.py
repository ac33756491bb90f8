"""Report assembly: fused texts, prompts, verdict buckets and batch reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import confidence_band, meaningful_chars, strip
from plumbline.operators import extract

#: What errors among captions begin with, the queries for a blank text, and a prompt without hits.
CAPTION_ERROR = "[ОШИБКА"
SHEET_QUERY = "техническое задание требования материалы"
BLANK_QUERY = "Требования к материалам, размерам и обозначениям"
NO_CHUNKS = "[Релевантные разделы ТЗ не найдены. Проверка по ТЗ невозможна.]"
LABELS = {True: "✓ СООТВЕТСТВУЕТ", False: "✗ НЕ СООТВЕТСТВУЕТ", None: "? НЕ ОПРЕДЕЛЕНО"}


def marked(text: Column, mark: Column) -> Column:
    return F.when(strip(F.coalesce(text, F.lit(""))) != "", F.concat(mark, F.lit("\n"), text))


def page_parts(pages: DataFrame) -> DataFrame:
    """Adds parts (array of kind and text) to pages: page_number, pdf_text, ocr_text, ocr_engine, caption."""
    at = F.concat(F.lit(" стр."), F.col("page_number").cast("string"))
    caption = F.when(~F.col("caption").startswith(CAPTION_ERROR), F.col("caption"))
    made = [marked(F.col("pdf_text"), F.concat(F.lit("[PDF"), at, F.lit("]"))), marked(F.col("ocr_text"), F.concat(F.lit("[OCR"), at, F.lit(" ("), F.coalesce("ocr_engine", F.lit("tesseract")), F.lit(")]"))), marked(caption, F.concat(F.lit("[LLaVA"), at, F.lit("]")))]
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("page_number"), t.alias("text")) for k, t in enumerate(made)])
    return pages.withColumn("parts", F.filter(parts, lambda p: p["text"].isNotNull()))


def fused(pages: DataFrame, *by: str, sizes: bool = False) -> DataFrame:
    """by, text: all PDF texts, then what OCR read, then captions, each by page; raw_ocr_text and llava_caption: of the
    latter two alone, null where there is none; with sizes, total_pages too."""
    said = lambda parts: F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n")
    kind = lambda k: F.nullif(said(F.filter("_parts", lambda p: p["kind"] == k)), F.lit(""))
    total = [F.count("*").cast("int").alias("total_pages")] if sizes else []
    ordered = page_parts(pages).groupBy(*by).agg(F.sort_array(F.flatten(F.collect_list("parts"))).alias("_parts"), *total)
    return ordered.select(*by, *["total_pages"][: len(total)], said(F.col("_parts")).alias("text"), kind(1).alias("raw_ocr_text"), kind(2).alias("llava_caption"))


def query_text(text: Column, blank: str = BLANK_QUERY, most: int = 800) -> Column:
    return F.when(strip(F.coalesce(text, F.lit(""))) != "", F.substring(text, 1, most)).otherwise(blank)


def prompt_lines(chunks: Column) -> Column:
    """Numbered blocks of a sheet's hits (an array of rank, source, text, score), at most 2000 characters of text."""
    block = lambda c: F.format_string("[%d] Источник: %s (релевантность: %.2f)\n%s", c["rank"], c["source"], c["score"], c["text"])
    return F.substring(F.array_join(F.transform(chunks, block), "\n\n---\n\n"), 1, 2000)


def best_ocr(pages: DataFrame, forced: bool = False) -> DataFrame:
    """Adds text, engine, confidence, char_count: the second engine counts if the first read below 50 characters, and
    replaces it only with more. pages: tess_text, easy_text."""
    first, second = F.coalesce("tess_text", F.lit("")), F.coalesce("easy_text", F.lit(""))
    n1, n2 = meaningful_chars(first), meaningful_chars(second)
    asked = F.lit(forced) | (n1 < 50)
    swap = asked & (n2 > n1)
    engine = F.when(swap, "easyocr").when(n1 > 0, "tesseract").otherwise("none")
    count = F.when(swap, n2).otherwise(n1)
    return pages.withColumns({"text": F.when(swap, second).when(n1 > 0, first).otherwise(""), "engine": engine, "confidence": confidence_band(count), "char_count": count})


def status_label(compliant: Column) -> Column:
    return F.when(compliant, LABELS[True]).when(~compliant, LABELS[False]).otherwise(LABELS[None])


def verdict_buckets(reports: DataFrame, by: str, order: str) -> DataFrame:
    """by, total_drawings and the ids (drawing_id) of compliant, non_compliant and undetermined ones, in order."""

    def ids(of: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(of, F.struct(order, "drawing_id")))), lambda x: x["drawing_id"])

    c = F.col("is_compliant")
    return reports.groupBy(by).agg(F.count("*").alias("total_drawings"), ids(c).alias("compliant"), ids(~c).alias("non_compliant"), ids(c.isNull()).alias("undetermined"))


def bucket_sizes(reports: DataFrame, by: str, order: str, first: int) -> DataFrame:
    """by, total_drawings, the numbers of compliant, non_compliant and undetermined ones, and the first compliant ids.

    Of a group no more than the first ids are gathered; a window group limit keeps as many in every partition.
    """
    c = F.col("is_compliant")
    sizes = reports.groupBy(by).agg(F.count("*").alias("total_drawings"), F.count_if(c).alias("n_compliant"), F.count_if(~c).alias("n_non_compliant"), F.count_if(c.isNull()).alias("n_undetermined"))
    yes = reports.where(c).select(F.col(by).alias("_by"), F.struct(F.col(order).alias("at"), F.col("drawing_id").alias("id")).alias("_at"))
    rank = F.row_number().over(Window.partitionBy("_by").orderBy("_at"))
    few = yes.withColumn("_rank", rank).where(F.col("_rank") <= first).groupBy("_by").agg(F.transform(F.sort_array(F.collect_list("_at")), lambda x: x["id"]).alias("first_compliant"))
    empty = F.array().cast(few.schema["first_compliant"].dataType)
    return sizes.join(few, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by").withColumn("first_compliant", F.coalesce("first_compliant", empty))


def shortened(values: Column, n: int, size: Column | None = None) -> Column:
    """The first n values, and a line on how many more there are; size: of all, where values has the first alone."""
    size = F.size(values) if size is None else size
    return F.when(size > n, F.array_append(F.slice(values, 1, n), F.concat(F.lit("… ещё "), (size - n).cast("string")))).otherwise(values)


#: Columns of a report's elements, in their order.
ELEMENT = ("item_id", "name", "element_type", "size", "material", "designation", "note", "source", "confidence", "raw_text_fragment")


def final_elements(said: Column, text: Column, rule_set: dict) -> tuple[Column, Column]:
    """(elements, whether heuristics found them): a reply's, or, where it gave none, the text's mentions. Blank texts have none."""
    kind = "array<struct<" + ",".join(f"{c}:string" for c in ELEMENT) + ">>"
    if not rule_set:
        return said, F.lit(False)
    own = lambda e: F.struct(*[(F.lit(None).cast("string") if c == "element_type" else e[c]).alias(c) for c in ELEMENT])
    mentions = F.when((F.size(said) == 0) & (strip(F.coalesce(text, F.lit(""))) != ""), F.transform(extract.elements_of(text, rule_set), own))
    found = F.coalesce(mentions, F.array().cast(kind))
    return F.concat(F.transform(said, lambda e: F.struct(*[e[c].alias(c) for c in ELEMENT])), found), found
