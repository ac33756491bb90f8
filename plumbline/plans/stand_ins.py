"""Registered queries of sources, sinks and services, over the driver's tables and with deterministic stand-ins.

What is written goes to the folder that executors share and is read from there; a stand-in for a service or an engine is a
plug-in like any other, and fails or says nothing where its input says so.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import analysis, reports, sheets
from plumbline.plans import catalogue as c
from plumbline.plans.oracle import BY_ASKED
from plumbline.sources import files, named, paged, services
from plumbline.sources.shared import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _digits():
    """An engine that reads digits alone, and fails where there are none."""

    def engine(image: bytes) -> str:
        found = "".join(x if x.isascii() and x.isdigit() else " " for x in image.decode())
        if not found.strip():
            raise ValueError("nothing to read")
        return found

    return engine


def _all():
    return lambda image: image.decode()


def ocr_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images: a first engine that reads digits alone, and a second where that was too little."""
    images = c.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("image"))
    best = reports.best_ocr(files.read_by_two(images, _digits, _all))
    return best.select("doc_id", "engine", "confidence", "char_count", F.md5(F.regexp_replace("text", " +", " ").cast("binary")).alias("text_md5"))


def _captioner():
    """A model of images that is away for what begins with a capital T, and says nothing of short ones."""

    def model(image: bytes) -> str:
        text = image.decode()
        if text.startswith("T"):
            raise ConnectionError("away")
        return "" if len(text) < 60 else f" {text[:40]} "

    return model


def captioned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as images, what a model says of them, and which captions count."""
    pages = c.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page_number"), F.encode("text", "UTF-8").alias("image"), F.lit(None).cast("string").alias("pdf_text"), F.lit(None).cast("string").alias("ocr_text"), F.lit(None).cast("string").alias("ocr_engine"))
    return reports.page_parts(services.captions(pages, _captioner, at_once=8)).select("conv_id", "page_number", "caption", F.size("parts").alias("n_parts"))


def _model():
    """A language model whose answer is decided by the prompt's length: an element, none, no JSON, or it fails."""
    said = {1: '{"elements": [{"name": "b", "material": "keit"}], "compliance": {"is_compliant": null}}', 2: '{"elements": [], "compliance": {"is_compliant": true}}', 3: "sorry"}

    def model(prompt: str) -> str:
        return said[len(prompt) % 4]  # a KeyError is the service's own

    return model


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.analyze(c._talks(spark, sf_dir), c._items(spark, sf_dir), c.TALK_RULES, c._embedded, services.language_model(_model, at_once=8), top_k=3, size=1_000_000, template="{text}")


def asked_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as drawings, from prompts through a service to their reports."""
    return _asked(spark, sf_dir).select("drawing_id", *c._numbers(), sheets.summary_line().alias("summary"))


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reports, written as one file each and read again."""
    folder = _folder(spark, "reports")
    named.write_reports(_asked(spark, sf_dir), folder)
    return files.reports(spark, folder).select("drawing_id", *c._numbers(), sheets.summary_line().alias("summary"))


class Lines:
    """A file whose pages are parted by form feeds."""

    def __init__(self, content: bytes) -> None:
        self.texts = content.decode().split("\f")
        self.pages = len(self.texts)

    def page(self, number: int, wanted: set[str]) -> dict:
        text = self.texts[number - 1]
        made = {"pdf_text": lambda: text.strip(), "image": text.encode, "has_drawings": lambda: len(text) % 2 == 0}
        return {k: made[k]() for k in wanted}


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation written as a file, its turns as pages, and read through the page source in shares."""
    folder = _folder(spark, "albums")
    turns = c.table(spark, sf_dir, "conversations")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    albums = turns.groupBy("conv_id").agg(F.encode(F.array_join(texts, "\f"), "UTF-8").alias("content"))
    named.write_files(albums.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("name"), "content"), folder)
    pages = paged.read_pages(spark, folder, Lines, "doc_id string, page_number int, total_pages int, pdf_text string, has_drawings boolean", share_bytes=1000)
    return pages.select("doc_id", "page_number", "total_pages", F.md5(F.col("pdf_text").cast("binary")).alias("text_md5"), "has_drawings")


def appended_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents, appended to an index in two parts, one of them twice."""
    folder = _folder(spark, "index")
    d = c.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("drawing_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"), F.lit(None).cast("int").alias("page_number"), "lang")
    kinds = "drawing_id long, page_number int, chunk_id int, text string"
    english = sheets.drawing_chunks(d.where("lang = 'en'"))
    for part in (english, sheets.drawing_chunks(d.where("lang <> 'en' or lang is null")), english):
        files.append_chunks(part, folder)
    return files.chunk_index(spark, folder, kinds).select(F.col("drawing_id").alias("source"), "chunk_id", "text")


def _letters():
    """A model of texts: how many of some letters they have."""
    return lambda texts: [[float(t.lower().count(x)) for x in c.LETTERS] for t in texts]


def embedded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items with the vectors of a model that each task loads once."""
    items = c.table(spark, sf_dir, "benchmark").select("item_id", "text")
    return files.embedded(items, _letters).select("item_id", *[F.get("embedding", k).cast("double").alias(f"n_{x}") for k, x in enumerate(c.LETTERS)])


QUERIES = {f.__name__: f for f in (ocr_engines, captioned_pages, asked_reports, report_files, page_files, appended_chunks, embedded_items)}
ORACLE_SQL = {
    "ocr_engines": r"""with d as (
  select doc_id, regexp_replace(text, '[^0-9]', ' ', 'g') as a, text as b from documents
), f as (select doc_id, b, case when trim(a) = '' then '' else a end as a from d
), n as (
  select *, len(regexp_extract_all(a, '[0-9]')) as n1, len(regexp_extract_all(b, '[а-яёА-ЯЁa-zA-Z0-9]')) as n2 from f
), e as (select *, n1 < 50 and n2 > n1 as swap from n), g as (select *, case when swap then n2 else n1 end as n from e)
select doc_id, case when swap then 'easyocr' when n1 > 0 then 'tesseract' else 'none' end as engine, case when n >= 200 then 'high' when n >= 50 then 'medium' else 'low' end as confidence, n as char_count,
  md5(regexp_replace(case when swap then b when n1 > 0 then a else '' end, ' +', ' ', 'g')) as text_md5 from g""",
    "captioned_pages": """select conv_id, turn as page_number, case when starts_with(text, 'T') then '[ОШИБКА: ConnectionError: away]' when length(text) < 60 then '[LLaVA вернул пустой ответ — нельзя подтвердить содержимое чертежа]' else trim(left(text, 40)) end as caption,
  (not starts_with(text, 'T'))::int as n_parts from conversations""",
    "asked_reports": BY_ASKED,
    "report_files": BY_ASKED,
    "page_files": """select 'c' || conv_id as doc_id, row_number() over (partition by conv_id order by turn) as page_number, count(*) over (partition by conv_id) as total_pages, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) as text_md5, length(text) % 2 = 0 as has_drawings from conversations""",
    "appended_chunks": c.ORACLE_SQL["chunks"],
    "embedded_items": "select item_id, " + ", ".join(f"(length(text) - length(replace(lower(text), '{x}', '')))::double as n_{x}" for x in c.LETTERS) + " from benchmark",
}
