"""A sink for files that have names of their own: bytes or texts, each row one file.

A task writes to a side folder of its attempt; when all have ended, files are renamed to their names, and an attempt that
failed, was repeated or belongs to a job that ended early leaves nothing behind.
"""

from __future__ import annotations

import contextlib
import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from plumbline.operators.names import free_names
from plumbline.sources.shared import qualified, status

FORMAT = "plumbline_named"


@dataclass
class Attempt(WriterCommitMessage):
    side: str
    names: list[str]


class NamedWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.job, self.indent = options["path"], options["job"], int(options.get("indent", "0"))

    def _store(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder)
        return store, base, f"{base}/_attempts-{self.job}"

    def write(self, rows: Iterator[Row]) -> Attempt:
        task = TaskContext.get()
        store, _, attempts = self._store()
        side, names = f"{attempts}/{task.partitionId()}-{task.taskAttemptId()}", []
        # not the folders above: a task that is late, after the job was given up, makes nothing
        store.create_dir(side, recursive=False)
        for k, (name, content) in enumerate(rows):
            if self.indent:
                content = json.dumps(json.loads(content), ensure_ascii=False, indent=self.indent)
            with store.open_output_stream(f"{side}/{k}") as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content))
            names.append(name)
        return Attempt(side, names)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, base, attempts = self._store()

        def move(given: tuple[str, str]) -> None:
            source, name = given
            target = f"{base}/{name}"
            store.create_dir(posixpath.dirname(target), recursive=True)
            store.move(source, target)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, [(f"{m.side}/{k}", name) for m in messages if m for k, name in enumerate(m.names)]))
        self._clear(store, attempts)

    def abort(self, messages: list[Attempt | None]) -> None:
        store, _, attempts = self._store()
        self._clear(store, attempts)

    def _clear(self, store, attempts: str) -> None:
        from pyarrow import fs

        for _ in range(20):
            if store.get_file_info(attempts).type == fs.FileType.NotFound:
                return
            with contextlib.suppress(OSError):  # a task that still writes
                store.delete_dir(attempts)
            time.sleep(0.1)


class NamedFiles(DataSource):
    """Columns name and content (bytes or text); option indent: content is JSON that is set out so."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        return NamedWriter(dict(self.options))


def _save(files: DataFrame, folder: str, indent: int = 0) -> None:
    spark = files.sparkSession
    store, _ = status(spark, folder)
    job = uuid.uuid4().hex
    store.mkdirs(status(spark, f"{folder}/_attempts-{job}")[1])
    spark.dataSource.register(NamedFiles)
    files.select("name", "content").write.format(FORMAT).option("path", qualified(spark, folder)).option("job", job).option("indent", str(indent)).mode("append").save()


def write_files(files: DataFrame, folder: str, overwrite: bool = True, order: str | None = None) -> None:
    """Writes each content under its name. Rows of one name: with overwrite the last by order stays, and so do files that are
    there and not named; without, each gets the first free of name, name_1, name_2 and so on, and nothing is replaced.

    order: a column that comes once; by default rows are in the order of their names and contents.
    """
    rows = files.select("name", "content", (F.col(order) if order else F.struct("name", F.md5(F.col("content").cast("binary")), F.monotonically_increasing_id())).alias("_order"))
    if overwrite:
        last = F.row_number().over(Window.partitionBy("name").orderBy(F.col("_order").desc()))
        return _save(rows.withColumn("_last", last).where("_last = 1"), folder)
    store, where = status(files.sparkSession, folder)
    names = [s.getPath().getName() for s in store.listStatus(where) if s.isFile()] if store.exists(where) else []
    there = files.sparkSession.createDataFrame([(n,) for n in names], "file string")
    # names are made free apart from their endings
    stem, ending = F.regexp_replace("name", r"\.[^./]*$", ""), F.regexp_extract("name", r"(\.[^./]*)$", 1)
    taken = there.select(F.regexp_replace("file", r"\.[^./]*$", "").alias("name"), F.regexp_extract("file", r"(\.[^./]*)$", 1).alias("_ending"))
    named = free_names(rows.withColumns({"_stem": stem, "_ending": ending}).drop("name"), "_stem", "_order", taken, ("_ending",))
    return _save(named.withColumn("name", F.concat("_stem", "_ending")), folder)


def _json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _stem_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def write_reports(reports: DataFrame, folder: str, indent: int = 2) -> None:
    """One indented file for each report: {PDF}_{drawing_id}_report.json."""
    from plumbline.operators.sheets import report_columns

    name = F.concat(_stem_of(F.col("pdf_path")), F.lit("_"), F.col("drawing_id").cast("string"), F.lit("_report.json"))
    _save(reports.select(name.alias("name"), _json(report_columns()).alias("content")), folder, indent)


def write_batches(batches: DataFrame, folder: str, indent: int = 2) -> None:
    """One indented file for each PDF: {PDF}_{base}_batch_report.json."""
    name = F.concat(_stem_of(F.col("pdf_path")), F.lit("_"), F.col("base_drawing_id").cast("string"), F.lit("_batch_report.json"))
    _save(batches.select(name.alias("name"), _json(batches.columns).alias("content")), folder, indent)


def write_albums(albums: DataFrame, folder: str, indent: int = 2) -> None:
    """One indented file for each album, named as its pipeline_report_path ends."""
    _save(albums.select(F.element_at(F.split("pipeline_report_path", "/"), -1).alias("name"), _json(albums.columns).alias("content")), folder, indent)


def write_page_texts(pages: DataFrame, folder: str, base: str = "drawing_id", indent: int = 2) -> None:
    """One indented file for each page: {base}_page_{number}.json with its number, text, image's path and has_drawings."""
    name = F.concat(F.col(base).cast("string"), F.format_string("_page_%03d.json", "page_number"))
    _save(pages.select(name.alias("name"), _json(["page_number", "pdf_text", "image_path", "has_drawings"]).alias("content")), folder, indent)
