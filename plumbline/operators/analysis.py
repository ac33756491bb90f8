"""From pages to reports in one call, stage by stage.

Each stage is written once to a folder that executors share and read from there: sheets with their fused texts, the embedded
index, hits, replies. A run with the folder of an earlier one goes on after the last stage that was finished. Reports are
made in the rows of the last stage, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import project_signature
from plumbline.operators import chunk, reports, search, segment, sheets
from plumbline.sources.shared import Stages

#: How pages make sheets: all of a drawing's one, or each of them.
DRAWING, PAGE = "drawing", "page"
#: Rows with an embedding made of their text.
Embed = Callable[[DataFrame], DataFrame]


def sheets_of(pages: DataFrame, by: str = DRAWING, more: tuple[str, ...] = ()) -> DataFrame:
    """sheet (a key of its own), base, drawing_id, pdf_path, page_number, total_pages, text, raw_ocr_text, llava_caption, and
    the columns in more, which are the same in all pages of a drawing.

    pages: pdf_path, drawing_id, page_number, pdf_text, ocr_text, ocr_engine, caption. Drawings of one name in different
    PDFs are different. By page, each page is a sheet that is named after it.
    """
    key, of = ["pdf_path", "drawing_id"], list(more)
    if by == PAGE:
        total = F.count("*").over(Window.partitionBy(*key))
        named = pages.withColumns({"total_pages": total.cast("int"), "base": F.col("drawing_id")}).withColumn("drawing_id", sheets.sheet_id(F.col("base").cast("string"), F.col("page_number")))
        made = reports.fused(named, *key, "page_number", "total_pages", "base", *of)
    elif by == DRAWING:
        fused = reports.fused(pages, *key, *of, sizes=True)
        made = fused.withColumns({"page_number": F.lit(None).cast("int"), "base": F.col("drawing_id")})
    else:
        raise ValueError(f"by must be {DRAWING} or {PAGE}")
    return made.withColumn("sheet", F.to_json(F.array(F.col("pdf_path").cast("string"), F.col("drawing_id").cast("string"))))


def staged_sheets(stages: Stages, pages: DataFrame, spec: DataFrame, rule_set: dict, embed: Embed, by: str = DRAWING, top_k: int = search.TOP, size: int = chunk.SIZE, blank: str = reports.SHEET_QUERY, more: tuple[str, ...] = ()) -> DataFrame:
    """Sheets with chunks, their hits in the index of spec (source, text) and the rules."""
    made = stages.stage("sheets", lambda: sheets_of(pages, by, more))
    index = stages.stage("index", lambda: embed(sheets.index_chunks(spec, rule_set, size=size)))

    def hits() -> DataFrame:
        asked = embed(made.select(F.col("sheet").alias("query_id"), reports.query_text(F.col("text"), blank).alias("text")))
        best = search.search(index.select("id", "embedding"), asked.select("query_id", "embedding"), top_k)
        return sheets.nested_hits(sheets.hits_with_texts(best, index))

    found = stages.stage("hits", hits).withColumnRenamed("query_id", "sheet")
    return made.join(found, "sheet", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(sheets.CHUNKS)))


def analyze(pages: DataFrame, spec: DataFrame, rule_set: dict, embed: Embed, ask: Callable[[DataFrame], DataFrame] | None = None, by: str = DRAWING, top_k: int = search.TOP, folder: str | None = None, size: int = chunk.SIZE, model: str = "mistral", template: str = sheets.PROMPT, more: tuple[str, ...] = ()) -> DataFrame:
    """A report of each sheet of pages (as sheets_of takes them), with base and the columns in more beside it.

    embed adds an embedding of text; ask adds raw, the reply of a language model or null, to sheets with a prompt; without it
    no model is called. folder: where stages are written, and found again; by default one of this application.
    """
    stages = Stages(pages.sparkSession, folder)
    held = staged_sheets(stages, pages, spec, rule_set, embed, by, top_k, size, more=more)
    if ask is not None:
        held = stages.stage("replies", lambda: ask(held.withColumn("prompt", sheets.prompt(template))))
    return sheets.judged_sheets(held, rule_set, ask is not None, model, ("base", *more))


def pages_of_projects(pages: DataFrame, text: str = "pdf_text", title: Callable[[Column], Column] = project_signature) -> tuple[DataFrame, DataFrame]:
    """(boundaries: doc_id, start_page, end_page, signature, stem; pages with the stem of their project as drawing_id).

    pages: doc_id (the album), page_number and a text in which titles are looked for. Pages before the first title belong
    to no project.
    """
    signed = pages.withColumn("signature", title(F.col(text)))
    bounds = segment.named_projects(segment.project_boundaries(signed))
    return bounds, segment.pages_of_projects(pages, bounds).withColumnRenamed("stem", "drawing_id")


def analyze_albums(pages: DataFrame, spec: DataFrame, rule_set: dict, embed: Embed, ask: Callable[[DataFrame], DataFrame] | None = None, projects_dir: str = "projects", files: DataFrame | None = None, folder: str | None = None, title: Callable[[Column], Column] = project_signature, **options) -> DataFrame:
    """One row for each album (doc_id): its projects by title, each analysed as a drawing, with their reports and verdicts.

    files (path): the projects' files; projects without one are left out of the verdicts. None: all are there.
    """
    stages = Stages(pages.sparkSession, folder)
    bounds = stages.stage("boundaries", lambda: pages_of_projects(pages, title=title)[0])
    held = segment.pages_of_projects(pages, bounds).withColumnRenamed("stem", "drawing_id")
    path = F.concat(F.lit(f"{projects_dir}/"), "drawing_id", F.lit(".pdf"))
    own = held.withColumns({"pdf_path": path, "album": F.col("doc_id")})
    found = analyze(own, spec, rule_set, embed, ask, DRAWING, folder=f"{stages.folder}/projects", more=("album",), **options)
    listing = bounds.select(F.concat(F.lit(f"{projects_dir}/"), "stem", F.lit(".pdf")).alias("path")).distinct() if files is None else files
    return sheets.album_reports(bounds, listing, found, projects_dir)
