"""Registered queries of the document-compliance operators over the driver's tables, and DuckDB SQL for each.

The tables hold no Russian texts, so markers and rules are parameters here; the operators' defaults are tested on inline
rows. Parts stand for drawing elements, a customer's events or a conversation's turns for the pages of an album.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import classify, text
from plumbline.operators import analysis, chunk, extract, replies, reports, rule_tables, rules, search, segment, sheets
from plumbline.plans.oracle import ORACLE_SQL  # noqa: F401
from plumbline.sources.shared import Stages

PART_RULES = {
    "dimensions": [
        {"field": "bolt_size", "allowed_values": ["M8", "M10"], "standard": "S1", "tz_reference": "1"},
        {"field": "wall", "min": 4.0, "max": 46.0, "unit": "mm", "standard": "S2", "tz_reference": "2"},
        {"field": "gap", "min": 1.0, "max": 40.0, "unit": "mm", "standard": "S3"},
    ],
    "materials": {"allowed": ["STANDARD", "MEDIUM", "LARGE", "SMALL"], "forbidden": ["PROMO"], "standard": "S4", "tz_reference": "4"},
    "designations": {"pattern": "^Brand#[0-9]{2}$", "examples": ["Brand#10"], "tz_reference": "5"},
    "coatings": {"allowed_codes": ["bolt", "ring"], "standard": "S6", "tz_reference": "6"},
}
#: ASCII markers for texts of the documents table; word ends are avoided, as SQL engines differ on them.
ASCII = classify.Markers(
    drawing_strong=(r"ertion\s+the", r"stand", r"tion,\s+the"),
    drawing_weak=("nder", "keit"),
    explication_strong=("mentre", r"the\s+thnt"),
    explication_weak=("eaux", "ción"),
    annotation=("ing,", "heit", r"of\s+the\s+", "eren", "ement", r"\.\n?\s*th"),
    project=(r"here\s+", "ungen"),
    dimensions=r"\d{2,4}\s*[x]\s*\d{2,4}|\d+\s*[=]\s*\d+",
    ad_phrases=("licensed", "http://", "https://"),
    ad_author="COPYRIGHT",
    ad_soft=("thing", "ouan"),
    project_sheet=r"the\s*an",
    project_sheet_with=("tion", "keit"),
    project_notes=("thouin", "ondre"),
)
#: Enough Russian for a text layer that needs no OCR.
TITLE = "Двухэтажный жилой дом из кирпича с гаражом и мансардой, вариант первый, стены и план этажа. " * 3
_EVENT_FLAGS = {"is_drawing": "click", "is_explication": "explication", "is_annotation": "view", "is_project_info": "info", "is_irrelevant_photo_or_ad": "error"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("M"), F.col("p_size"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" mm")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.col("p_partkey").cast("string").alias("drawing_id"), F.lit(0).alias("pos"), F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("name"),
        size.alias("size"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_type")).alias("material"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand")).alias("designation"), F.col("p_name").alias("note"),
    )


def element_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.element_findings(_parts(spark, sf_dir), PART_RULES)
    return found.select("p_partkey", F.size("missing").alias("n_missing"), F.posexplode_outer("issues").alias("ord", "i")).select("p_partkey", "n_missing", "ord", F.col("i.field").alias("field"), F.col("i.actual_value").alias("actual_value"), F.col("i.expected").alias("expected"), F.col("i.message").alias("message"), F.col("i.tz_reference").alias("tz_reference"))


def _validated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    prior = F.when(F.col("p_partkey") % 3 == 0, True).when(F.col("p_partkey") % 3 == 1, False)
    blank = parts.select(
        "p_brand", "drawing_id", (F.col("p_partkey") % 2 == 0).alias("heuristic"), prior.alias("is_compliant"), F.array().cast(f"array<{rules.ISSUE}>").alias("issues"), F.array().cast("array<string>").alias("missing_info"), F.lit("high").alias("overall_confidence")
    )
    return rules.validated(blank, parts, PART_RULES)


def report_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _validated_parts(spark, sf_dir)
    return r.select("drawing_id", "n_elements", F.size("issues").alias("n_issues"), F.array_join("missing_info", " | ").alias("missing_info"), "is_compliant", "overall_confidence", reports.status_label(F.col("is_compliant")).alias("label"))


def verdict_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _validated_parts(spark, sf_dir).withColumn("place", F.col("drawing_id").cast("long"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return reports.verdict_buckets(r, "p_brand", "place").select("p_brand", "total_drawings", *[joined(c) for c in ("compliant", "non_compliant", "undetermined")])


def first_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"), F.col("l_quantity").alias("value"))
    ranges = spark.sql("select * from values (1, 'a', 10.0d, 50.0d), (2, 'b', 1.0d, 30.0d), (3, 'c', 5.0d, 45.0d) as r(ord, field, low, high)")
    return rules.first_violations(lines, ranges).groupBy("field", "ord").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def allowed_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.sql("select * from values ('STANDARD'), ('SMALL') as a(p_type)")
    return rules.by_allowance(table(spark, sf_dir, "part").select("p_partkey", "p_type"), allowed, "p_type").groupBy("p_type", "kind").agg(F.count("*").alias("n"))


def _documents_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("pdf_text"))
    return classify.features(docs).withColumns({"image_count": (F.col("char_count") % 4).cast("int"), "image_area_ratio": (F.col("char_count") % 10) / 10.0})


def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents_as_pages(spark, sf_dir)
    return docs.select("doc_id", "char_count", F.md5(F.col("text").cast("binary")).alias("text_md5"), text.is_garbled(F.col("pdf_text")).alias("garbled"), text.meaningful_chars(F.col("pdf_text")).alias("meaningful"), text.count_of(F.col("pdf_text"), text.LATIN).alias("latin"), text.confidence_band(text.meaningful_chars(F.col("pdf_text"))).alias("band"))


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = classify.scores(*(F.col(c) for c in ("text", "text_upper", "char_count", "image_area_ratio", "image_count")), ASCII)
    return _documents_as_pages(spark, sf_dir).select("doc_id", *[F.round(v, 6).alias(k) for k, v in s.items()])


def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.classified(_documents_as_pages(spark, sf_dir), ASCII)
    return found.select("doc_id", *classify.FLAGS, classify.begins_new_project(F.col("text"), ASCII).alias("begins_new_project"))


def _events_as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events")
    kinds = {k: F.col("event_type") == v for k, v in _EVENT_FLAGS.items()}
    return e.select(F.col("user_id").alias("doc_id"), number.cast("int").alias("page_number"), (F.col("event_type") == "signup").alias("begins_new_project"), *[c.alias(k) for k, c in kinds.items()], F.concat(F.lit("v"), F.floor("value").cast("string")).alias("label"), "event_type")


def drawing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.drawing_runs(_events_as_pages(spark, sf_dir))
    return found.groupBy("doc_id", "segment", "zone", "run").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count_if("is_drawing").alias("drawings"))


def drawing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.drawing_files(_events_as_pages(spark, sf_dir), most_pages=5)
    return found.select("doc_id", "seq", "segment", "run_first", "first_page", "last_page", "n_pages", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "stem")


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _events_as_pages(spark, sf_dir)
    return pages.withColumn("signature", F.when(~F.col("event_type").isin("error", "view"), F.col("event_type")))


def project_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.with_stems(segment.project_boundaries(_signed(spark, sf_dir)).withColumn("slug", F.col("signature")), "slug")


def project_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _signed(spark, sf_dir)
    stems = segment.with_stems(segment.project_boundaries(pages).withColumn("slug", F.col("signature")), "slug")
    return segment.pages_of_projects(pages, stems).groupBy("doc_id", "stem").agg(F.count("*").alias("n"), F.min("page_number").alias("first_page"))


def _split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _events_as_pages(spark, sf_dir)
    file = F.concat(F.lit("drawing_"), F.col("doc_id").cast("string"), F.lit("_"), F.floor((F.col("page_number") - 1) / 3).cast("string"), F.lit(".pdf"))
    return segment.checked_files(pages.withColumns({"file": file, "support_text": F.col("event_type") == "purchase"}))


def split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_files(spark, sf_dir)


def split_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.split_advice(_split_files(spark, sf_dir))


def fused_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    of = lambda role: F.when(F.col("role") == role, F.col("text"))
    pages = c.select(F.col("conv_id"), F.col("turn").alias("page_number"), of("system").alias("pdf_text"), of("user").alias("ocr_text"), F.lit("tesseract").alias("ocr_engine"), of("assistant").alias("caption"))
    made = reports.fused(pages, "conv_id")
    return made.select("conv_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.md5(reports.query_text(F.col("text")).cast("binary")).alias("query_md5"))


def ocr_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a poor scan: the first engine reads digits alone, the second all."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^0-9]+", " ").alias("tess_text"), F.col("text").alias("easy_text"))
    return reports.best_ocr(d).select("doc_id", "engine", "confidence", "char_count", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def first_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.first_number(F.concat(F.col("event_type"), F.lit(" "), F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")), F.lit(" мм"))).alias("number"))


def file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.file_stem(F.col("url")).alias("stem"), text.file_stem(F.col("html")).alias("html_stem"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), F.lit("tion"), 20).alias("snippet"))


def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    images = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), F.col("l_suppkey").alias("xref"), (F.col("l_quantity") - 5).alias("width"), F.col("l_discount").alias("height"), F.lit(10.0).alias("page_area"))
    return classify.image_metrics(images).select("doc_id", F.round("image_area_ratio", 6).alias("image_area_ratio"), "image_count")


def placed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of 50 by 40 with a margin, their lines as images that lie on the page, over its edges or beside it; those
    of one supplier are one image."""
    lines = table(spark, sf_dir, "lineitem")
    left, top = F.col("l_quantity") * 2 - 30, F.col("l_discount") * 800 - 20
    box = {"left": left, "top": top, "right": left + F.col("l_linenumber") * 4, "bottom": top + 15}
    placed = {k: F.when(F.col("l_linenumber") != 4, v) for k, v in box.items()}
    page = {"page_left": F.lit(-5.0), "page_top": F.lit(0.0), "page_right": F.lit(45.0), "page_bottom": F.when(F.col("l_orderkey") % 9 == 0, 0.0).otherwise(40.0)}
    images = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), F.col("l_suppkey").alias("xref"), *[v.cast("double").alias(k) for k, v in (placed | page).items()])
    return classify.placed_metrics(images).select("doc_id", F.round("image_area_ratio", 6).alias("image_area_ratio"), "image_count")


def page_graphics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages; lines as placed images, and as many paths as the key says."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    side = {"left": F.lit(0.0), "top": F.lit(0.0), "right": F.col("l_quantity") * 4, "bottom": F.col("l_quantity") * 2 - 10}
    images = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), F.col("l_suppkey").alias("xref"), (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("place"), *[v.cast("double").alias(k) for k, v in side.items()])
    paths = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), (F.col("o_orderkey") % 8).alias("n_paths"))
    return classify.page_graphics(images, paths).select("doc_id", "has_drawings")


def _brand_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification for each brand, made of its parts with an even key: their sizes, types and names."""
    even = table(spark, sf_dir, "part").where("p_partkey % 2 = 0")
    types = F.array_sort(F.collect_set("p_type"))
    large = F.array_sort(F.collect_set(F.when(F.col("p_size") > 40, F.col("p_type"))))
    of = even.groupBy(F.col("p_brand").alias("spec")).agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"), types.alias("types"), large.alias("large"))
    base = {"description": F.lit("размер"), "unit": F.lit("mm"), "standard": F.concat(F.lit("S "), "spec"), "tz_reference": F.lit("1")}
    wall = {"ord": F.lit(1), "field": F.lit("wall"), "min": (F.col("low") + 5).cast("double"), "max": (F.col("high") - 5).cast("double"), "allowed_values": F.lit(None).cast("array<string>")}
    none = F.lit(None).cast("double")
    bolt = {"ord": F.lit(2), "field": F.lit("bolt_size"), "min": none, "max": none, "allowed_values": F.array(F.concat(F.lit("M"), F.col("low").cast("string")), F.concat(F.lit("M"), F.col("high").cast("string")))}
    dimensions = [of.select("spec", *[v.alias(k) for k, v in (base | kind).items()]) for kind in (wall, bolt)]
    material = F.struct(F.slice("types", 1, 4).alias("allowed"), F.col("large").alias("forbidden"), F.lit("").alias("standard"), F.lit("2").alias("tz_reference"))
    name = F.struct(F.concat("spec", F.lit("$")).alias("pattern"), F.array("spec").alias("examples"), F.lit("3").alias("tz_reference"))
    coating = F.struct(F.array(F.lit("bolt")).alias("allowed_codes"), F.lit("S9").alias("standard"), F.lit("").alias("tz_reference"))
    others = of.select("spec", material.alias("materials"), name.alias("designations"), coating.alias("coatings"))
    return rule_tables.by_specification(dimensions[0].unionByName(dimensions[1]), others)


def brand_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts judged by the rules of their brands, all in one job."""
    parts = _parts(spark, sf_dir).withColumns({"spec": F.col("p_brand"), "designation": F.when(F.col("p_partkey") % 13 == 1, F.lit("none")).otherwise(F.col("designation"))})
    found = rule_tables.element_findings(parts, _brand_rules(spark, sf_dir))
    return found.select("p_partkey", F.array_join("missing", " | ").alias("missing"), F.posexplode_outer("issues").alias("ord", "i")).select("p_partkey", "missing", "ord", F.col("i.field").alias("field"), F.col("i.expected").alias("expected"), F.col("i.message").alias("message"), F.col("i.tz_reference").alias("tz_reference"))


def brand_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of each brand as sentences of its index."""
    return rule_tables.sentences(_brand_rules(spark, sf_dir))


def top_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = e.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    return search.search(e, queries, leave_self=True).withColumn("score", F.round("score", 6))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunk.chunked(d, "doc_id")


def heuristic_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {"dimensions": [{"field": "bolt_size", "allowed_values": ["ertion", "thnd"]}], "materials": {"allowed": ["stand", "keit", "x"], "forbidden": ["mentre"]}, "designations": {"pattern": "oning[a-z]{1,3}"}}
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("drawing_id"), "text")
    return extract.extracted(d, given).select(F.col("drawing_id").alias("doc_id"), "pos", "item_id", "size", "material", "designation")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    size = F.when(k % 5 == 0, k.cast("string")).otherwise(F.concat(F.lit('"'), k.cast("string"), F.lit('"')))
    say = F.when(k % 4 == 0, "true").when(k % 4 == 1, '"False"').when(k % 4 == 2, '"maybe"').otherwise("null")
    raw = F.format_string('Answer: {"elements": [{"size": %s, "confidence": "%s", "source": "%s"}, {"name": "b"}], "compliance": {"is_compliant": %s, "missing_info": [{"field": "%s"}, "x"], "citations": "c"}} end', size, F.when(k % 3 == 0, "low").otherwise("odd"), F.col("event_type"), say, F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("drawing_id"), F.when(k % 7 == 0, "no json").when(k % 11 == 0, "{broken").otherwise(raw).alias("raw"))


def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = replies.parsed(_replies(spark, sf_dir))
    first = F.try_element_at("elements", F.lit(1))
    return p.select(F.col("drawing_id").alias("event_id"), F.size("elements").alias("n_elements"), first["size"].alias("size"), first["confidence"].alias("confidence"), first["source"].alias("source"), "is_compliant", F.array_join("missing_info", ",").alias("missing"), F.array_join("citations", ",").alias("citations"), "overall_confidence")


def labelled_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("is_compliant"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left").withColumn("drawing_id", F.col("doc_id"))
    b = reports.bucket_sizes(d, "source", "doc_id", 8)
    return b.select("source", "total_drawings", "n_compliant", "n_non_compliant", "n_undetermined", F.array_join(reports.shortened(F.col("first_compliant").cast("array<string>"), 8, F.col("n_compliant")), ",").alias("first_compliant"))


def drawing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.drawing_pages(_events_as_pages(spark, sf_dir).withColumn("has_drawings", F.col("is_drawing")))


def match_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    matched = text.for_match(F.col("text"))
    return d.select("doc_id", F.length(matched).alias("n"), F.md5(matched.cast("binary")).alias("text_md5"))


def support_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.has_support_text(F.col("text")).alias("supported"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text layers, English ones under a Russian title."""
    d = table(spark, sf_dir, "documents")
    raw = F.when(F.col("lang") == "en", F.concat(F.lit(TITLE), F.col("text"))).otherwise(F.col("text"))
    made = d.select("doc_id", raw.alias("raw"), F.upper("lang").alias("ocr"))
    return made.select("doc_id", text.needs_ocr(F.col("raw")).alias("needed"), F.md5(text.page_text(F.col("raw"), F.col("ocr")).cast("binary")).alias("text_md5"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title page for each part: its size as sides, its type as a material in brackets."""
    material = F.when(F.col("p_size") % 3 == 0, "кирпич").when(F.col("p_size") % 3 == 1, "Арболит и брус").otherwise("стены: монолит")
    title = F.concat(F.lit("ЖИЛОЙ  ДОМ ("), F.col("p_size").cast("string"), F.lit(",5 х 12.0) ("), material, F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Лист 1\n"), title, F.lit("\nстр. "), F.col("p_partkey").cast("string")).alias("text"))


def project_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    signature = text.project_signature(F.col("text"))
    return _titles(spark, sf_dir).select("p_partkey", signature.alias("signature"), text.project_slug(signature).alias("slug"))


def sheet_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    said = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Чертёж № "), k, F.lit(" / "), F.col("p_name"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("см. план этажа "), k)).when(F.col("p_size") % 4 == 2, F.concat(F.lit("узел "), F.col("p_size").cast("string"), F.lit(" - AB7 "), F.col("p_name"))).otherwise(F.concat(F.lit(" \n"), F.col("p_name"), F.lit(": "), k))
    return table(spark, sf_dir, "part").select("p_partkey", text.sheet_label(said).alias("label"))


def rules_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules in the index: the heading alone, then heading and sentences."""
    empty = spark.createDataFrame([], "source string, text string")
    return sheets.index_chunks(empty, PART_RULES).select("id", "chunk_id", F.length("text").alias("n"), "text")


def album_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings of albums from their texts: each source is an album, its documents by id are the pages."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("album"), F.col("doc_id").alias("page_number"), F.col("text").alias("pdf_text"))
    made = classify.features(d).withColumns({"image_count": (F.col("char_count") % 4).cast("int"), "image_area_ratio": (F.col("char_count") % 10) / 10.0})
    flagged = classify.classified(made, ASCII).withColumns({"begins_new_project": classify.begins_new_project(F.col("text"), ASCII), "label": text.sheet_label(F.col("pdf_text")), "doc_id": F.col("album")})
    found = segment.drawing_files(flagged.select("doc_id", "page_number", "begins_new_project", "label", *classify.FLAGS))
    return found.select("doc_id", "seq", "segment", "run_first", "first_page", "last_page", "n_pages", "stem")


def joined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as PDFs: turns that the assistant says have Markdown, users' turns OCR, each third a caption."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "role", F.col("text").alias("pdf_text"))
    key = ["doc_id", "page_number"]
    markdown = c.where("role = 'assistant'").select(*key, F.concat(F.lit("# "), "pdf_text").alias("text"))
    ocr = c.where("role = 'user'").select(*key, F.lower("pdf_text").alias("text"), F.lit("easyocr").alias("engine"))
    captions = c.where("page_number in (0, 3)").select(*key, F.when(F.col("page_number") == 0, F.concat(F.lit(reports.CAPTION_ERROR), F.lit("] x"))).otherwise(F.lit("a drawing")).alias("caption"))
    pages = sheets.page_inputs(sheets.with_markdown(c, markdown), ocr, captions)
    parts = reports.page_parts(pages)
    image = text.base64_line(F.col("pdf_text").cast("binary"))
    return parts.select(*key, F.size("parts").alias("n_parts"), F.md5(F.array_join(F.transform("parts", lambda p: p["text"]), "|").cast("binary")).alias("parts_md5"), F.md5(image.cast("binary")).alias("image_md5"), sheets.sheet_id(F.col("doc_id").cast("string"), F.col("page_number")).alias("sheet_id"))


#: Rules of the queries over conversations, and letters whose counts stand for an embedding.
TALK_RULES = {"dimensions": [{"field": "bolt_size", "allowed_values": ["tion", "ment"]}, {"field": "bolt_size", "allowed_values": ["the"]}], "materials": {"allowed": ["keit"], "forbidden": ["stand"], "tz_reference": "7"}}
LETTERS = "aeioudlnrst"


def _embedded(rows: DataFrame) -> DataFrame:
    low = F.lower("text")
    counts = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("double") for x in LETTERS])
    return rows.withColumn("embedding", search.normalised(counts))


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages, a conversation being a drawing."""
    c = table(spark, sf_dir, "conversations").withColumn("drawing_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    of = lambda role: F.when(F.col("role") == role, F.col("text"))
    return c.select("conv_id", F.concat("drawing_id", F.lit(".pdf")).alias("pdf_path"), "drawing_id", F.col("turn").alias("page_number"), of("system").alias("pdf_text"), of("user").alias("ocr_text"), F.lit(None).cast("string").alias("ocr_engine"), of("assistant").alias("caption"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as a specification."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("source"), "text")


def _answers(made: DataFrame) -> DataFrame:
    """Replies: an element, none, no JSON, or no answer."""
    k = F.length("text") % 4
    some = '{"elements": [{"name": "b", "material": "keit"}], "compliance": {"is_compliant": null}}'
    return made.withColumn("raw", F.when(k == 1, some).when(k == 2, '{"elements": [], "compliance": {"is_compliant": true}}').when(k == 3, "sorry"))


def _analyzed(spark: SparkSession, sf_dir: str, by: str, ask) -> DataFrame:
    return analysis.analyze(_talks(spark, sf_dir), _items(spark, sf_dir), TALK_RULES, _embedded, ask, by, 3, size=1_000_000)


def _numbers() -> list[Column]:
    return [F.size("elements").alias("n_elements"), F.size("compliance.issues").alias("n_issues"), F.size("compliance.missing_info").alias("n_missing"), F.col("compliance.is_compliant").alias("is_compliant"), "overall_confidence", "llm_used", F.md5(F.array_join("tz_chunks_used", "|").cast("binary")).alias("chunks_md5")]


def drawing_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as one drawing, from pages to its report."""
    r = _analyzed(spark, sf_dir, analysis.DRAWING, _answers)
    return r.select("drawing_id", *_numbers(), sheets.summary_line().alias("summary"))


def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a drawing, without a model, and one report for all of a conversation."""
    b = sheets.batch_reports(_analyzed(spark, sf_dir, analysis.PAGE, None), "base")
    ids = [F.array_join(c, ",").alias(c) for c in ("compliant", "non_compliant", "undetermined")]
    elements = F.aggregate(F.transform("drawings", lambda d: F.size(d["elements"])), F.lit(0), lambda a, x: a + x)
    return b.select("base_drawing_id", "pdf_path", "total_drawings", elements.alias("n_elements"), *ids)


def album_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which those with an even id have a file, in albums of their first turn's role."""
    c = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("role").alias("doc_id"), "conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("stem"))
    bounds = c.select("doc_id", (F.col("conv_id") * 8 + 1).alias("start_page"), (F.col("conv_id") * 8 + 8).alias("end_page"), "stem")
    files = c.where("conv_id % 2 = 0").select(F.concat(F.lit("/projects/"), "stem", F.lit(".pdf")).alias("path"))
    a = sheets.album_reports(bounds, files, _analyzed(spark, sf_dir, analysis.DRAWING, _answers), "/projects")
    sizes = [F.size(x).alias(f"n_{x}") for x in ("split_boundaries", "compliant", "non_compliant", "undetermined", "projects")]
    first = F.col("projects")[0]
    return a.select("source_album", *sizes, first["drawing_id"].alias("first_project"), first["album_pages"]["end"].alias("first_end"), "pipeline_report_path")


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = analysis.staged_sheets(Stages(spark), _talks(spark, sf_dir), _items(spark, sf_dir), TALK_RULES, _embedded, top_k=3, size=1_000_000)
    p = held.withColumn("chunks", F.transform("chunks", lambda c: c.withField("score", F.lit(0.25)))).select("drawing_id", sheets.prompt("{drawing_id}\n{text}\n{chunks}").alias("prompt"))
    return p.select("drawing_id", F.length("prompt").alias("n"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        report_verdicts, element_issues, verdict_buckets, first_violations, allowed_materials, page_features, page_scores, page_classes, drawing_runs, drawing_files, project_boundaries, project_pages,
        split_check, split_advice, fused_texts, ocr_choice, first_numbers, file_stems, snippets, image_metrics, top_chunks, chunks, heuristic_elements, parsed_replies, labelled_buckets,
        drawing_pages, match_texts, support_texts, page_texts, project_names, sheet_labels, rules_sentences, album_drawings, joined_pages, drawing_reports, page_batches, album_projects, prompt_texts, placed_images, page_graphics, brand_issues, brand_sentences,
    )
}
