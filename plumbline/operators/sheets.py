"""From pages to reports: the index of the specification, its hits, prompts, replies and nested reports.

What services give (embeddings, replies) comes as columns or plug-ins of sources.files; without a reply the report of the
gate stands in and the text's own mentions are validated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import chunk, replies, reports, rules
from plumbline.sources.files import REPORT

#: How a page's sheet is called, and what reports say that no model has seen.
SHEET = "-стр."
NOT_CALLED = "Текстовая LLM не вызывалась: Ollama недоступна или модель не установлена (ожидалась «{model}»). Будет эвристика + rules.json."
NO_ANSWER = "Текстовая LLM (Ollama) недоступна: запустите ollama serve и установите модель (например: ollama pull {model}). Дальше включится эвристика по тексту и rules.json."
NO_TEXTS = "Нет данных для индексации ТЗ — проверьте пути к файлам"
SUMMARY = {True: "СООТВЕТСТВУЕТ", False: "НЕ СООТВЕТСТВУЕТ", None: "НЕЛЬЗЯ ОПРЕДЕЛИТЬ"}
#: What a prompt is made of; a caller's own may have the same three places.
PROMPT = "Сравни элементы чертежа с требованиями ТЗ и ответь одним JSON с полями elements и compliance.\n\nЧертёж {drawing_id}:\n{text}\n\nТЗ:\n{chunks}"
TEXT_CHARS = 3000


def sheet_id(base: Column, page: Column) -> Column:
    return F.concat(base, F.lit(SHEET), page.cast("string"))


def with_markdown(pages: DataFrame, markdown: DataFrame) -> DataFrame:
    """pages with the Markdown of a page (doc_id, page_number, text) as pdf_text where there is one."""
    found = markdown.select("doc_id", "page_number", F.coalesce("text", F.lit("")).alias("_markdown"))
    return pages.join(found, ["doc_id", "page_number"], "left").withColumn("pdf_text", F.coalesce("_markdown", "pdf_text")).drop("_markdown")


def page_inputs(pages: DataFrame, ocr: DataFrame, captions: DataFrame) -> DataFrame:
    """pages with ocr_text and ocr_engine (of ocr: text, engine) and caption (of captions); null where there is none."""
    key = ["doc_id", "page_number"]
    return pages.join(ocr.select(*key, F.col("text").alias("ocr_text"), F.col("engine").alias("ocr_engine")), key, "left").join(captions.select(*key, "caption"), key, "left")


def index_chunks(spec: DataFrame, rule_set: dict, rules_source: str = "rules.json", size: int = chunk.SIZE, overlap: int = chunk.OVERLAP) -> DataFrame:
    """id (source and number), source, chunk_id, text of the chunks of spec (source, text) and of the rules as sentences.

    Raises ValueError where there is nothing to index.
    """
    texts = spec.select(F.col("source").cast("string").alias("source"), "text")
    if rule_set:
        texts = texts.unionByName(spec.sparkSession.createDataFrame([(rules_source, chunk.rules_text(rule_set))], "source string, text string"))
    made = chunk.chunked(texts, "source", size, overlap)
    if made.isEmpty():
        raise ValueError(NO_TEXTS)
    return made.select(F.concat("source", F.format_string("#%06d", "chunk_id")).alias("id"), "source", "chunk_id", "text")


def drawing_chunks(sheets: DataFrame) -> DataFrame:
    """drawing_id, page_number (1 where it is null), chunk_id, text: what a drawing adds to its index; blank texts add nothing.

    Embedded and written with append, each drawing is one more append, and nothing is read again.
    """
    some = sheets.where(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")) != "")
    return some.select("drawing_id", F.coalesce("page_number", F.lit(1)).alias("page_number"), F.posexplode(chunk.chunks_of(F.col("text"))).alias("chunk_id", "text"))


def hits_with_texts(hits: DataFrame, index: DataFrame) -> DataFrame:
    """hits (query_id, rank, id, score) with source and text of the chunk."""
    return hits.join(index.select("id", "source", "text"), "id").select("query_id", "rank", "id", "source", "text", "score")


#: A sheet's hits in its row.
CHUNKS = "array<struct<rank:int,source:string,text:string,score:double>>"


def nested_hits(hits: DataFrame) -> DataFrame:
    """query_id and chunks: its hits (rank, source, text, score) as one array, by rank."""
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source", "text", "score"))).cast(CHUNKS).alias("chunks"))


def with_chunks(sheets: DataFrame, hits: DataFrame, key: str = "drawing_id") -> DataFrame:
    """sheets with chunks, those of the hits whose query_id is the sheet's key; an empty array where there is none."""
    joined = sheets.join(nested_hits(hits).withColumnRenamed("query_id", key), key, "left")
    return joined.withColumn("chunks", F.coalesce("chunks", F.array().cast(CHUNKS)))


def prompt(template: str = PROMPT) -> Column:
    """The prompt of a sheet (drawing_id, text, chunks)."""
    filled, blocks = F.lit(template), F.when(F.size("chunks") > 0, reports.prompt_lines(F.col("chunks"))).otherwise(reports.NO_CHUNKS)
    # texts go in last, so that places named in them stay as they are
    for place, value in (("drawing_id", F.col("drawing_id").cast("string")), ("chunks", blocks), ("text", F.substring("text", 1, TEXT_CHARS))):
        filled = F.replace(filled, F.lit("{" + place + "}"), value)
    return filled


def prompts(sheets: DataFrame, hits: DataFrame, template: str = PROMPT) -> DataFrame:
    """drawing_id, prompt of each sheet (drawing_id, text); hits: query_id, rank, source, text, score."""
    return with_chunks(sheets, hits).select("drawing_id", prompt(template).alias("prompt"))


def answered(sheets: DataFrame, asked: bool = True, model: str = "mistral") -> DataFrame:
    """sheets with what their replies (raw) say, and llm_used; the gate's report where there is no reply.

    asked is False where no model is to be called. A null reply is a service that did not answer.
    """
    said = (NO_ANSWER if asked else NOT_CALLED).format(model=model)
    own = tuple(sheets.columns)
    got = replies.parsed(sheets, own) if asked else replies.parsed(sheets.withColumn("raw", F.lit(None).cast("string")), own)
    silent = F.col("raw").isNull() if asked else F.lit(True)
    fixed = {"elements": F.array(), "standard": F.lit(None), "is_compliant": F.lit(None), "issues": F.array(), "citations": F.array(), "missing_info": F.array(F.lit(said)), "overall_confidence": F.lit("low")}
    return got.withColumns({c: F.when(silent, v.cast(got.schema[c].dataType)).otherwise(F.col(c)) for c, v in fixed.items()} | {"llm_used": ~silent})


def judged_sheets(sheets: DataFrame, rule_set: dict, asked: bool = True, model: str = "mistral", more: tuple[str, ...] = ()) -> DataFrame:
    """A nested report of each sheet, and the columns in more, made in its row: replies, mentions, rules and verdict need no join or shuffle.

    sheets: drawing_id, text, pdf_path, page_number, total_pages, raw_ocr_text, llava_caption, chunks, raw (if asked).
    """
    said = answered(sheets, asked, model)
    elements, found = reports.final_elements(F.col("elements"), F.col("text"), rule_set)
    whole = said.withColumns({"_found": F.size(found) > 0 if rule_set else found, "elements": elements})
    judged = rules.judged(whole.withColumn("heuristic", ~F.col("llm_used") | F.col("_found")), rule_set)
    made = judged.withColumns({"compliance": F.struct("standard", "is_compliant", "issues", "missing_info", "citations"), "tz_chunks_used": F.transform("chunks", lambda c: c["text"])})
    return made.select(*report_columns(), *more)


def sheet_reports(sheets: DataFrame, hits: DataFrame, raw: DataFrame | None, rule_set: dict, model: str = "mistral") -> DataFrame:
    """judged_sheets() with hits (as hits_with_texts gives them) and replies (raw: drawing_id, raw; None: not asked) as tables.

    Hits and replies are joined by drawing_id, and by pdf_path too where a table has it; sheets are never merged.
    """
    key = ["pdf_path", "drawing_id"] if raw is not None and "pdf_path" in raw.columns else ["drawing_id"]
    held = with_chunks(sheets, hits)
    held = held if raw is None else held.drop("raw").join(raw.select(*key, "raw"), key, "left")
    return judged_sheets(held, rule_set, raw is not None, model)


def report_columns() -> list[str]:
    """A report's columns, in their order."""
    return [c.split(" ")[0] for c in _fields(REPORT)]


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def summary_line() -> Column:
    """One line on a report."""
    c = F.col("compliance.is_compliant")
    status = F.when(c, SUMMARY[True]).when(~c, SUMMARY[False]).otherwise(SUMMARY[None])
    return F.concat(F.lit("Чертёж "), F.col("drawing_id").cast("string"), F.lit(": "), status, F.lit(" | Элементов: "), F.size("elements").cast("string"), F.lit(" | Расхождений: "), F.size("compliance.issues").cast("string"), F.lit(" | Не определено: "), F.size("compliance.missing_info").cast("string"))


def summary(report: DataFrame) -> DataFrame:
    """drawing_id, summary: one line on each report."""
    return report.select("drawing_id", summary_line().alias("summary"))


def _verdicts() -> list[Column]:
    c = F.col("compliance.is_compliant")

    def ids(of: Column, name: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(of, F.struct("_order", "drawing_id")))), lambda x: x["drawing_id"]).alias(name)

    return [ids(c, "compliant"), ids(~c, "non_compliant"), ids(c.isNull(), "undetermined")]


def batch_reports(report: DataFrame, base: str, model: str = "mistral", reachable: bool = False, available: bool = False, pdfs: DataFrame | None = None) -> DataFrame:
    """One row for each PDF: its sheets' reports by page and their ids by verdict. report has base beside its own columns.

    A row is as large as its PDF; sources.pieces writes reports of PDFs of any size. pdfs (pdf_path and base): those without
    a page have a row too, of no drawings.
    """
    own = F.struct(*report_columns())
    drawings = F.transform(F.sort_array(F.collect_list(F.struct("_order", own.alias("r")))), lambda x: x["r"]).alias("drawings")
    about = {"ollama_reachable": F.lit(reachable), "text_llm_model": F.lit(model), "text_llm_available": F.lit(available)}
    made = report.withColumn("_order", F.col("page_number")).groupBy("pdf_path", F.col(base).alias("base_drawing_id")).agg(F.count("*").alias("total_drawings"), drawings, *_verdicts())
    if pdfs is not None:
        made = pdfs.select("pdf_path", F.col(base).alias("base_drawing_id")).distinct().join(made, ["pdf_path", "base_drawing_id"], "left")
        lists = ("drawings", "compliant", "non_compliant", "undetermined")
        made = made.withColumns({"total_drawings": F.coalesce("total_drawings", F.lit(0)), **{c: F.coalesce(c, F.array().cast(made.schema[c].dataType)) for c in lists}})
    return made.select("pdf_path", "base_drawing_id", "total_drawings", *[v.alias(k) for k, v in about.items()], "drawings", "compliant", "non_compliant", "undetermined")


def existing(boundaries: DataFrame, files: DataFrame) -> DataFrame:
    """Projects (stem) of which there is a file (path, named as the stem)."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return boundaries.join(files.select(stem.alias("stem")), "stem", "left_semi")


def album_reports(boundaries: DataFrame, files: DataFrame, report: DataFrame, projects_dir: str, report_path: Column | None = None) -> DataFrame:
    """One row for each album: its projects with their reports, and their stems by verdict.

    boundaries: doc_id, start_page, end_page, stem; files: path; report: as sheet_reports gives them, drawing_id being
    the stem (of the album, where there is such a column). Projects without a file are left out of all but split_boundaries.
    """
    own_album = {"album": "doc_id"} if "album" in report.columns else {}
    on = ["stem", *own_album.values()]
    held = existing(boundaries, files).join(report.withColumnsRenamed({"drawing_id": "stem", **own_album}), on).withColumn("drawing_id", F.col("stem"))
    own = F.struct(*report_columns())
    project = F.struct("drawing_id", "pdf_path", F.struct(F.col("start_page").alias("start"), F.col("end_page").alias("end")).alias("album_pages"), own.alias("report"))
    each = held.withColumn("_order", F.col("start_page")).groupBy("doc_id").agg(*_verdicts(), F.transform(F.sort_array(F.collect_list(F.struct("_order", project.alias("p")))), lambda x: x["p"]).alias("projects"))
    split = boundaries.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_page", "end_page", "stem"))).alias("split_boundaries"))
    path = F.concat(F.lit(f"{projects_dir}/"), F.col("doc_id").cast("string"), F.lit("_pipeline_report.json")) if report_path is None else report_path
    none = {c: F.array().cast(each.schema[c].dataType) for c in ("compliant", "non_compliant", "undetermined", "projects")}
    joined = split.join(each, "doc_id", "left").withColumns({c: F.coalesce(c, e) for c, e in none.items()})
    return joined.select(F.col("doc_id").alias("source_album"), F.lit(projects_dir).alias("projects_dir"), "split_boundaries", "compliant", "non_compliant", "undetermined", "projects", path.alias("pipeline_report_path"))
