"""Calls of services from tasks: several at a time, with a time limit and further tries, and errors as a column.

A service is a plug-in: start() is called once in each task and gives a function of one value. A call that hangs is given up
at its limit; its thread ends with the task's process.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds that a language model and a model of images have.
ANSWER_SECONDS, CAPTION_SECONDS = 180.0, 120.0
TIMED_OUT = "timed out"
#: What stands for a caption that failed (such texts are dropped from a sheet) or was empty (they are not).
CAPTION_ERROR, CAPTION_EMPTY = "[ОШИБКА: {error}]", "[LLaVA вернул пустой ответ — нельзя подтвердить содержимое чертежа]"


def call_all(values: list, service: Callable, at_once: int, seconds: float, tries: int) -> list[tuple[object, str | None]]:
    """(answer, error) of each of values, in their order; null values are not asked. No more than at_once calls run, but
    for those that were given up."""
    found: list[tuple[object, str | None]] = [(None, None)] * len(values)
    waiting = [(i, 1) for i, v in enumerate(values) if v is not None][::-1]
    running: dict[tuple[int, int], float] = {}
    ended: queue.Queue = queue.Queue()

    def call(i: int, turn: int) -> None:
        try:
            ended.put((i, turn, service(values[i]), None))
        except Exception as e:  # whatever the plug-in raises
            ended.put((i, turn, None, f"{type(e).__name__}: {e}"))

    def settle(i: int, turn: int, answer: object, error: str | None) -> None:
        if error is not None and turn < tries:
            waiting.append((i, turn + 1))
        else:
            found[i] = answer, error

    while waiting or running:
        while waiting and len(running) < at_once:
            i, turn = waiting.pop()
            running[i, turn] = time.monotonic() + seconds
            threading.Thread(target=call, args=(i, turn), daemon=True).start()
        try:
            i, turn, answer, error = ended.get(timeout=max(0.0, min(running.values()) - time.monotonic()))
            if running.pop((i, turn), None) is not None:
                settle(i, turn, answer, error)
        except queue.Empty:
            for i, turn in [k for k, limit in running.items() if limit <= time.monotonic()]:
                del running[i, turn]
                settle(i, turn, None, TIMED_OUT)
    return found


def asked(rows: DataFrame, start: Callable[[], Callable], column: str, into: str, at_once: int = 4, seconds: float = ANSWER_SECONDS, tries: int = 1) -> DataFrame:
    """rows with the service's text for a column (into; null where there is none) and the error (into_error), row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service = start()
        for batch in batches:
            found = call_all(batch.column(column).to_pylist(), service, at_once, seconds, tries)
            made = [pa.array([None if x[k] is None else str(x[k]) for x in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, into, f"{into}_error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{into}` string, `{into}_error` string")


def language_model(start: Callable[[], Callable[[str], str]], **limits) -> Callable[[DataFrame], DataFrame]:
    """From prompts to replies (raw), for analysis.analyze: what hangs, fails or gives nothing is a null reply."""

    def ask(sheets: DataFrame) -> DataFrame:
        return asked(sheets, start, "prompt", "raw", **limits).withColumn("raw", F.nullif("raw", F.lit("")))

    return ask


def captions(pages: DataFrame, start: Callable[[], Callable[[bytes], str]], image: str = "image", **limits) -> DataFrame:
    """pages with the caption of their image: errors and empty answers are texts that say so; no image, no caption."""
    limits = {"seconds": CAPTION_SECONDS} | limits
    said = asked(pages, start, image, "caption", **limits)
    text: Column = F.trim("caption")
    error = F.replace(F.lit(CAPTION_ERROR), F.lit("{error}"), F.col("caption_error"))
    made = F.when(F.col("caption_error").isNotNull(), error).when(F.col(image).isNull(), F.lit(None)).when(F.coalesce(text, F.lit("")) == "", CAPTION_EMPTY).otherwise(text)
    return said.withColumn("caption", made).drop("caption_error")
