"""A data source of pages: files that a plug-in parser opens, read as ranges of pages.

A file is divided by its size, before anything of it is read: each task opens the file, asks how many pages there are and
takes its share of them, so that a large file has many tasks and the driver reads names and sizes alone. Where there are
many shares, a task has several that follow each other, and opens a file once for all that it has of it.
"""

from __future__ import annotations

import math
import posixpath
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from plumbline.sources.shared import qualified

PAGE = "doc_id string, pdf_path string, page_number int, total_pages int, pdf_text string, image binary, has_drawings boolean"
#: Bytes of a file that a share has.
SHARE_BYTES = 4_000_000
#: Shares that have a task each; more are dealt to that many tasks, or to one for each TASK_BYTES, if those are more.
FEW = 256
#: Bytes of a task's shares, a file counting as FILE_BYTES at least.
TASK_BYTES, FILE_BYTES = 64_000_000, 16_000


class Document(Protocol):
    """What a parser makes of a file: its number of pages, and of a page (from 1) the wanted ones of pdf_text, image and
    has_drawings."""

    pages: int

    def page(self, number: int, wanted: set[str]) -> dict: ...


class Shares(InputPartition):
    """(file, first share, end, shares of the file) of what a task reads."""

    def __init__(self, parts: list[tuple[str, int, int, int]]) -> None:
        self.parts = parts


def dealt(files: list[tuple[str, int]], share_bytes: int) -> list[Shares]:
    """Shares of files (path, bytes) by task: consecutive ones, of about the same cost."""
    shares = [max(1, -(-size // share_bytes)) for _, size in files]
    cost = [max(size, FILE_BYTES) / n for (_, size), n in zip(files, shares, strict=True)]
    whole, total = sum(c * n for c, n in zip(cost, shares, strict=True)), sum(shares)
    tasks = min(total, max(FEW, math.ceil(whole / TASK_BYTES)))
    made: list[Shares] = []
    if tasks == total:
        return [Shares([(path, k, k + 1, n)]) for (path, _), n in zip(files, shares, strict=True) for k in range(n)]
    now, filled = [], 0.0
    for (path, _), n, c in zip(files, shares, cost, strict=True):
        k = 0
        while k < n:
            # as many as there is room for, one at least
            room = max(1, math.floor((whole / tasks - filled) / c + 0.5))
            end = min(n, k + room)
            now.append((path, k, end, n))
            filled += (end - k) * c
            k = end
            if filled + c / 2 >= whole / tasks:
                made.append(Shares(now))
                now, filled = [], 0.0
    return made + [Shares(now)] if now else made


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType, parser: Callable[[bytes], Document]) -> None:
        self.uri, self.ending = options["path"], options.get("ending", ".pdf")
        self.share_bytes = int(options.get("share_bytes", SHARE_BYTES))
        self.columns, self.parser = schema.names, parser

    def partitions(self) -> list[Shares]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.uri)
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(base)) if f.is_file and f.path.endswith(self.ending)]
        return dealt(sorted((f.path, f.size) for f in files), self.share_bytes)

    def read(self, partition: Shares | None) -> Iterator[tuple]:
        if partition is None:
            return
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.uri)
        wanted = set(self.columns) & {"pdf_text", "image", "has_drawings"}
        for path, first, end, shares in partition.parts:
            with store.open_input_stream(path) as file:
                document = self.parser(file.read())
            n, doc_id = document.pages, posixpath.basename(path).rsplit(".", 1)[0]
            about = {"doc_id": doc_id, "pdf_path": path, "total_pages": n}
            for k in range(n * first // shares, n * end // shares):
                row = about | {"page_number": k + 1} | (document.page(k + 1, wanted) if wanted else {})
                yield tuple(row.get(c) for c in self.columns)


def pages_source(parser: Callable[[bytes], Document], name: str = "plumbline_pages") -> type[DataSource]:
    """A data source of that name, to be registered; its schema may be any of the columns of PAGE, and no others are made."""

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGE

        def reader(self, schema: StructType) -> PageReader:
            return PageReader(dict(self.options), schema, parser)

    return Pages


def read_pages(spark: SparkSession, path: str, parser: Callable[[bytes], Document], columns: str = PAGE, share_bytes: int = SHARE_BYTES, ending: str = ".pdf"):
    """Pages of a file, or of a folder's files with that ending, in the given columns."""
    source = pages_source(parser)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).schema(columns).option("share_bytes", str(share_bytes)).option("ending", ending).load(qualified(spark, path))
