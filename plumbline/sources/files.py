"""Readers and writers: rules, specifications, pages, vector chunks and reports.

Paths go to Spark's readers, so any store that Spark knows will do. What PDFs, OCR, captions and language models give comes
from plug-ins: functions that mapInPandas takes. Their libraries and services are no part of this package.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import meaningful_chars
from plumbline.sources.shared import status

#: Bytes of the rows that a plug-in has at a time.
SLICE_BYTES = 2_000_000
PAGE = "doc_id string, page_number int, pdf_text string, image bytes, has_drawings boolean".replace("bytes", "binary")
REPORT = (
    "drawing_id string, pdf_path string, page_number int, total_pages int, llm_used boolean, "
    "elements array<struct<item_id:string,name:string,element_type:string,size:string,material:string,designation:string,note:string,source:string,confidence:string,raw_text_fragment:string>>, "
    "compliance struct<standard:string,is_compliant:boolean,issues:array<struct<field:string,actual_value:string,expected:string,message:string,tz_reference:string>>,missing_info:array<string>,citations:array<string>>, "
    "raw_ocr_text string, llava_caption string, tz_chunks_used array<string>, overall_confidence string"
)


def load_rules(spark: SparkSession, path: str) -> dict:
    """The rules file; an empty dict if it is missing or no JSON. A rules file is configuration, one small text."""
    try:
        found = spark.read.text(path, wholetext=True).first()
        return json.loads(found[0]) if found else {}
    except (PySparkException, json.JSONDecodeError):
        return {}


def specification(spark: SparkSession, path: str) -> DataFrame:
    """source, text: each file of path as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))


def reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path, multiLine=True)


def pdf_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path and content of the files whose names match. Spark raises an error for a missing path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")


def drawing_files(spark: SparkSession, folder: str, glob: str = "drawing_*.pdf") -> DataFrame:
    """path and content of a folder's drawings, ordered by path."""
    store, where = status(spark, folder)
    if not store.exists(where) or not store.getFileStatus(where).isDirectory():
        raise NotADirectoryError(folder)
    return pdf_files(spark, folder, glob).orderBy("path")


def pages(files: DataFrame, reader: Callable[[str, bytes], Iterator[dict]]) -> DataFrame:
    """One row for each page that the plug-in reader finds in a file (page_number, pdf_text, image, has_drawings)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [{"doc_id": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], **page} for page in reader(path, content)]
                yield pd.DataFrame(rows, columns=["doc_id", "page_number", "pdf_text", "image", "has_drawings"])

    return files.mapInPandas(run, PAGE)


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of batches that have so many bytes at most, or one row."""
    for batch in batches:
        waiting = [batch] if batch.num_rows else []
        while waiting:
            part = waiting.pop()
            if part.nbytes <= most or part.num_rows == 1:
                yield part
            else:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]


def _with(rows: DataFrame, into: str, kind: str, arrow: pa.DataType, start: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """rows with one column more, made slice by slice: a task holds what Spark hands it at once and little beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = start()
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made(part), arrow)], names=[*part.schema.names, into])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{into}` {kind}")


def embedded(chunks: DataFrame, embed: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """chunks with embedding, made of text by a plug-in model that each task loads once."""

    def start() -> Callable[[pa.RecordBatch], list]:
        model = embed()
        return lambda part: list(model(part.column("text").to_pylist()))

    return _with(chunks, "embedding", "array<float>", pa.list_(pa.float32()), start)


def read(rows: DataFrame, engine: Callable[[], Callable[[bytes], str]], into: str, image: str = "image") -> DataFrame:
    """rows with a struct of text and ok that an OCR engine reads from an image; a failure is an empty text, not ok."""

    def start() -> Callable[[pa.RecordBatch], list]:
        ocr = engine()

        def one(content: pa.Scalar) -> dict:
            try:
                return {"text": ocr(content.as_py()), "ok": True} if content.is_valid else {"text": "", "ok": False}
            except Exception:  # whatever the plug-in raises
                return {"text": "", "ok": False}

        return lambda part: [one(x) for x in part.column(image)]

    return _with(rows, into, "struct<text:string,ok:boolean>", pa.struct([("text", pa.string()), ("ok", pa.bool_())]), start)


def read_by_two(rows: DataFrame, first: Callable, second: Callable, forced: bool = False, least: int = 50) -> DataFrame:
    """rows with tess_text and easy_text: what the first engine reads, and the second where the first has too little."""
    once = read(rows, first, "_first").withColumn("tess_text", F.col("_first.text")).drop("_first")
    weak = F.lit(forced) | (meaningful_chars(F.col("tess_text")) < least)
    # one way for all rows: the second engine is asked nothing where it is not wanted
    again = read(once.withColumn("_wanted", F.when(weak, F.col("image"))), second, "_second", "_wanted")
    return again.withColumn("easy_text", F.when(weak, F.col("_second.text"))).drop("_second", "_wanted")


def page_images(pages: DataFrame, base: str, render_all: bool = True) -> DataFrame:
    """name and content of the pages' images: all, or those with drawings or hardly any text."""
    wanted = F.lit(render_all) | F.col("has_drawings") | (F.length("pdf_text") < 30)
    return pages.where(wanted & F.col("image").isNotNull()).select(F.concat(F.col(base).cast("string"), F.format_string("_page_%03d.png", "page_number")).alias("name"), F.col("image").alias("content"))


def cut_files(albums: DataFrame, files: DataFrame, cutter: Callable[[bytes, list[int]], bytes]) -> DataFrame:
    """name and content of each output file. albums: doc_id, content; files: doc_id, stem, pages; cutter makes the bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [cutter(c, list(p)) for c, p in zip(pdf["content"], pdf["pages"], strict=True)]
            yield pd.DataFrame({"name": pdf["stem"] + ".pdf", "content": made})

    return files.select("doc_id", "stem", "pages").join(albums, "doc_id").mapInPandas(run, "name string, content binary")


def chunk_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The chunks of an index; none, where it is not there."""
    store, where = status(spark, path)
    return spark.read.schema(schema).parquet(path) if store.exists(where) else spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_chunks(chunks: DataFrame, path: str, append: bool = False) -> None:
    chunks.write.mode("append" if append else "overwrite").parquet(path)


def append_chunks(chunks: DataFrame, path: str, key: tuple[str, ...] = ("drawing_id", "page_number", "chunk_id")) -> None:
    """Appends the chunks whose key the index does not have yet, each once: an append that is repeated leaves one copy."""
    fresh = chunks.dropDuplicates(list(key))
    there = chunk_index(chunks.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema))
    fresh.join(there.select(*key), list(key), "left_anti").select(*chunks.columns).write.mode("append").parquet(path)
