"""Suffix-array dedup: bytes under strings of ``LENGTH`` bytes that start more than once in the corpus.

Suffixes are compared to a depth of LENGTH bytes, so what counts of one that starts at p is the window [p, p + LENGTH).
A table of all suffixes would be LENGTH times the corpus. It is thinned, without loss, and what is left is decided by
sorted suffixes whose bytes are compared.

* Each window has an anchor, the place of the least hash among the short strings in it (leftmost of the least). The choice
  depends on the window's bytes alone, so equal windows have equal short strings at their anchors. Windows whose
  anchor's string occurs once are unique and need no suffix.
* The windows of one anchor are consecutive. One suffix stands for all of them: it starts at the first and is compared to
  the depth where the last ends. Suffixes that are equal to that depth have only repeated windows.
* Of anchors with a suffix that no other equals, and of one suffix of each kind as a partner, turns of ``TURN`` windows
  are looked at in the same way: those whose common bytes occur once are unique, for others there is a suffix each.
* What is left, mostly around the ends of repeated passages, has a suffix for each window.

A suffix table is cut into ranges by splitters that are sampled from it, and each range is sorted by multikey quicksort:
by two words of leading bytes, then, where these tie, by a fingerprint of all bytes, then, where that ties, by the bytes
themselves. The fingerprint only splits suffixes with a common beginning over ranges; suffixes count as equal where their
bytes are. A key that fills several ranges is dealt out over them by turns, and the first and last kind of each range are
compared across the boundaries.

Texts are written once, in blocks of about ``BLOCK_BYTES``, to a table that is bucketed by block; a place is (block and row,
offset). Later steps bring places to their block, so text is never shuffled but for the bytes of suffixes. Short strings
and turns that a sample shows to be hot occur again for certain; they are not brought together to be counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import kept_table, table, written

LENGTH = 200
#: Bytes of the short strings; a window of 200 bytes has 169 of them.
SHORT = 32
#: Windows of a turn.
TURN = 8
#: Bytes of texts that a block holds, at least one text.
BLOCK_BYTES = 1_000_000
#: A short string, or the bytes that a turn's windows share, is hot if it stands so often in a sample of that share; at most
#: so many are taken as hot.
HOT_SHARE, HOT, MOST_HOT = 1 / 64, 100, 10_000
#: Suffixes of a range that the splitters aim at, and sampled suffixes for each range.
RANGE_ROWS, SAMPLES = 60_000, 100
#: Splitters that one task takes from the sorted sample.
SORTED_SPLITTERS = 1_000
#: Bytes of texts that are hashed together.
TOGETHER = 1 << 18

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_power: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class Prefixes:
    """Polynomial hashes, modulo 2^64, of any stretch of a run of bytes."""

    def __init__(self, data: np.ndarray, base: int) -> None:
        n = len(data) + 1
        if base not in _power or len(_power[base][0]) < n:
            size = max(n, TOGETHER + 1)
            inverse = pow(base, -1, 2**64)
            _power[base] = tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)])) for b in (base, inverse))
        self.back = _power[base][1]
        self.sums = np.zeros(n, _U)
        np.cumsum((data.astype(_U) + _U(1)) * _power[base][0][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


def anchor_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, short: int) -> tuple[np.ndarray, ...]:
    """(hash at the anchor, anchor, first window, last window) for each anchor of the texts data[start:end]."""
    n = len(data)
    none = (np.zeros(0, _U), *[np.zeros(0, np.int64)] * 3)
    if n < length:
        return none
    marks = np.zeros(n + 2, np.int32)
    long = ends - starts >= length
    np.add.at(marks, starts[long], 1)
    np.add.at(marks, ends[long] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(marks)[:n] > 0)
    if not len(windows):
        return none
    hashes = _short_hashes(data, short)
    least = (hashes & _U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=_U)
    width, have = length - short + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    at = (least[windows] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return hashes[at[new]], at[new], windows[new], windows[last]


def _short_hashes(data: np.ndarray, short: int) -> np.ndarray:
    p = Prefixes(data, _BASES[0])
    return _mixed((p.sums[short:] - p.sums[:-short]) * p.back[: len(data) - short + 1])


def _runs(batch: pa.RecordBatch, column: str = "body") -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts, ends) of stretches of a batch's texts."""
    col = batch.column(column)
    wide = pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and off[-1] else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(off, off[row] + TOGETHER, side="right")) - 1)
        yield row, end, data[off[row] : off[end]], off[row:end] - off[row], off[row + 1 : end + 1] - off[row]
        row = end


def blocked(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with block, id (block and row) and body (the text's bytes); a table bucketed by block."""
    spark = docs.sparkSession
    docs = docs.withColumn("body", F.coalesce(text, F.lit("")).cast("binary"))

    @F.pandas_udf("block long, id long")
    def place(sizes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        block, size, row = TaskContext.get().partitionId() << 20, 0, 0
        for some in sizes:
            blocks, ids = [], []
            for n in some.tolist():
                if row and (size + n > block_bytes or row == 1 << 20):
                    block, size, row = block + 1, 0, 0
                blocks.append(block), ids.append((block << 20) + row)
                size, row = size + n, row + 1
            yield pd.DataFrame({"block": blocks, "id": ids}, dtype="int64")

    # only the sizes go to Python
    placed = docs.withColumn("at", place(F.octet_length("body"))).select("at.block", "at.id", *docs.columns)
    return kept_table(placed, "texts", "block", int(spark.conf.get("spark.sql.shuffle.partitions")))


def _with_places(texts: DataFrame, places: DataFrame, columns: list[str], run: Callable, schema: str) -> DataFrame:
    """run(texts of a block, its places) over all blocks of texts. places: id and others."""
    keyed = places.withColumn("block", F.shiftright("id", 20))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left.combine_chunks(), right.combine_chunks())

    return texts.select("block", "id", *columns).groupBy("block").cogroup(keyed.groupBy("block")).applyInArrow(both, schema)


def _hot_shorts(texts: DataFrame, length: int, short: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, starts, ends in _runs(batch):
                found, n = np.unique(anchor_runs(data, starts, ends, length, short)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["short", "n"])

    counted = texts.select("body").sample(HOT_SHARE, seed=1).mapInArrow(run, "short long, n long").groupBy("short").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= HOT).orderBy(F.col("n").desc(), "short").limit(MOST_HOT).collect()
    return np.sort(np.array([r["short"] for r in top], np.int64))


def _anchors(texts: DataFrame, length: int, short: int) -> DataFrame:
    """part (short hash), id, first, windows, offset, hot, asked of each anchor."""
    hot = texts.sparkSession.sparkContext.broadcast(_hot_shorts(texts, length, short))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for row, _, data, starts, ends in _runs(batch):
                found, at, first, last = anchor_runs(data, starts, ends, length, short)
                doc, part = np.searchsorted(ends, first, side="right"), found.view(np.int64)
                made = [part, ids[row + doc], (first - starts[doc]).astype(np.int32), (last - first + 1).astype(np.int32), (at - first).astype(np.int32), np.isin(part, hot.value)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, made)), names=["part", "id", "first", "windows", "offset", "hot"])

    return texts.select("id", "body").mapInArrow(run, "part long, id long, first int, windows int, offset int, hot boolean").withColumn("asked", F.lit(True))


def _together(rows: DataFrame) -> DataFrame:
    """The rows whose part another row has too, where one of them is asked; hot ones without being counted."""
    spread = F.when(F.col("hot"), F.xxhash64("id", "first")).otherwise(F.lit(0).cast("long"))
    group = Window.partitionBy("part", "spread")
    seen = rows.withColumn("spread", spread).withColumn("n", F.count("*").over(group)).withColumn("any", F.max("asked").over(group))
    return written(seen.where("hot or (n > 1 and any)").select(*PLACE), "together")


#: Columns of a row of windows: the first and how many, and the anchor's distance from the first.
PLACE = ("part", "id", "first", "windows", "offset", "hot", "asked")
_PLACE_KINDS = "part long, id long, first int, windows int, offset int, hot boolean, asked boolean"


def _gathered(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts that right has places in, and of each place: its text's start and end there, its row in right."""
    ids, wanted = left.column("id").to_numpy(), right.column("id").to_numpy()
    order = np.argsort(ids)
    doc = order[np.searchsorted(ids, wanted, sorter=order)]
    used, back = np.unique(doc, return_inverse=True)
    bodies = [x.as_buffer() for x in left.column("body").take(pa.array(used))]
    size = np.array([b.size for b in bodies], np.int64)
    data = np.concatenate([np.frombuffer(b, np.uint8) for b in bodies]) if bodies else np.zeros(0, np.uint8)
    end = np.cumsum(size)
    return data, (end - size)[back], end[back], np.arange(len(wanted))


def _hot_parts(turns: DataFrame) -> DataFrame:
    """part of at most MOST_HOT hot ones."""
    counted = turns.sample(HOT_SHARE, seed=1).groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= HOT)
    return counted.orderBy(F.col("n").desc(), "part").limit(MOST_HOT).select("part", F.lit(True).alias("often"))


def _turns(texts: DataFrame, left: DataFrame, length: int) -> DataFrame:
    """Of each anchor in left its turns, by distance from the anchor; part is a hash of the bytes that the turn's windows share."""

    def run(some: pa.Table, places: pa.Table) -> pa.Table:
        data, start, _, _ = _gathered(some, places)
        first, windows, offset = (places.column(c).to_numpy().astype(np.int64) for c in ("first", "windows", "offset"))
        at = first + offset + start
        # distances from the anchor: offset down to offset - windows + 1
        low, high = (offset - windows + 1) // TURN, offset // TURN
        n = high - low + 1
        of = np.repeat(np.arange(len(n)), n)
        turn = low[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near, far = TURN * turn, TURN * turn + TURN - 1
        top, bottom = np.minimum(far, offset[of]), np.maximum(near, (offset - windows + 1)[of])
        hashes = [Prefixes(data, b).of(at[of] - near, at[of] - far + length) for b in _BASES]
        made = {
            "part": _mixed(hashes[0] + hashes[1] * _U(3) + turn.astype(_U) * _U(_BASES[1])).view(np.int64), "id": places.column("id").to_numpy()[of], "first": (at[of] - start[of] - top).astype(np.int32),
            "windows": (top - bottom + 1).astype(np.int32), "offset": top.astype(np.int32), "hot": np.zeros(len(of), bool), "asked": places.column("asked").to_numpy()[of],
        }
        return pa.table({k: pa.array(made[k]) for k in PLACE})

    return _with_places(texts, left, ["body"], run, _PLACE_KINDS)


def _suffixes(texts: DataFrame, places: DataFrame, length: int, splitters: np.ndarray) -> DataFrame:
    """range, p1 and p2 (leading bytes as ordered longs), fp, body, and the columns of places: the suffix of each row."""

    def run(some: pa.Table, places: pa.Table) -> pa.Table:
        data, start, _, _ = _gathered(some, places)
        at = places.column("first").to_numpy().astype(np.int64) + start
        size = places.column("windows").to_numpy().astype(np.int64) - 1 + length
        p1, p2 = (_word(data, at + k) for k in (0, 8))
        fp = Prefixes(data, _BASES[0]).of(at, at + size).view(np.int64)
        end = np.cumsum(size)
        body = data[np.repeat(at - end + size, size) + np.arange(size.sum())]
        offsets = np.concatenate([[0], end]).astype(np.int32)
        own = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        return pa.table({"range": pa.array(_ranges(p1, p2, fp, splitters)), "p1": pa.array(p1), "p2": pa.array(p2), "fp": pa.array(fp), "body": own, **{c: places.column(c) for c in PLACE}})

    return _with_places(texts, places, ["body"], run, f"range int, p1 long, p2 long, fp long, body binary, {_PLACE_KINDS}")


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as longs in the order of the bytes. A short depth reads zeros behind the end."""
    word, padded = np.zeros(len(at), _U), np.concatenate([data, np.zeros(16, np.uint8)])
    for i in range(8):
        word = (word << _U(8)) | padded[at + i].astype(_U)
    return (word ^ _U(2**63)).view(np.int64)


def _sort_bytes(p1: np.ndarray, p2: np.ndarray, fp: np.ndarray) -> np.ndarray:
    words = np.stack([x.view(_U) ^ _U(2**63) for x in (p1, p2, fp)], axis=1).astype(">u8")
    # a last byte, as numpy drops zeros at the end of bytes
    return np.ascontiguousarray(np.concatenate([words.view(np.uint8), np.ones((len(words), 1), np.uint8)], axis=1)).view("S25").ravel()


def _ranges(p1: np.ndarray, p2: np.ndarray, fp: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    x = _sort_bytes(p1, p2, fp)
    low, high = np.searchsorted(splitters, x, side="left"), np.searchsorted(splitters, x, side="right")
    # a key that is a splitter may stand in each of the ranges that meet there
    return (low + np.arange(len(x)) % (high - low + 1)).astype(np.int32)


def _splitters(texts: DataFrame, places: DataFrame, length: int, range_rows: int) -> np.ndarray:
    """Splitters that cut the suffixes of places into even ranges, from about SAMPLES suffixes for each, chosen by hash.

    The sample is sorted by Spark, and every so many-th of its suffixes is a splitter; only those come to the driver.
    """
    n, none = places.count(), np.zeros(0, "S25")
    ranges = max(1, -(-n // range_rows))
    if ranges == 1:
        return none
    share = max(1, n // (SAMPLES * ranges))
    every = max(1, n // share // ranges)
    some = F.pmod(F.xxhash64("id", "first", F.lit("sample")), F.lit(share)) == 0
    key = ["p1", "p2", "fp"]

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(np.arange((every - 1 - seen) % every, batch.num_rows, every)))
            seen += batch.num_rows

    drawn = written(_suffixes(texts, places.where(some), length, none).select(*key), "drawn")
    ordered = drawn.repartitionByRange(-(-ranges // SORTED_SPLITTERS), *key).sortWithinPartitions(*key)
    found = ordered.mapInArrow(picked, "p1 long, p2 long, fp long").toArrow()
    return np.sort(_sort_bytes(*(found.column(c).to_numpy() for c in key)))


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their columns, by multikey quicksort: rows that tie on a column, and only those, are sorted by the
    next, tied group by tied group."""
    order = np.argsort(columns[0])
    group = np.cumsum(np.concatenate([[0], np.diff(columns[0][order]) != 0])) if len(order) else order
    open_ = np.arange(len(order))
    for column in columns[1:]:
        g = group[open_]
        same = g[1:] == g[:-1]
        tied = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(g) else np.zeros(0, bool)
        open_ = open_[tied]
        if not len(open_):
            break
        g, c = group[open_], column[order[open_]]
        place = np.lexsort((c, g))
        order[open_], g, c = order[open_][place], g[place], c[place]
        group[open_] = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]))
    return order


def _alike(data: np.ndarray, start: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether the strings one and two (rows of start and size) have the same bytes."""
    even = size[one] == size[two]
    pairs = np.flatnonzero(even)
    for at in range(0, len(pairs), 4096):
        some = pairs[at : at + 4096]
        n = size[one[some]]
        begin = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(begin, n)
        same = data[np.repeat(start[one[some]], n) + step] == data[np.repeat(start[two[some]], n) + step]
        even[some] = np.minimum.reduceat(same, begin)
    return even


def sorted_kinds(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(order of a range's suffixes, whether each is another kind than the one before): kinds are strings of equal bytes."""
    body = part.column("body").combine_chunks()
    body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
    offset = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    data, start, size = np.frombuffer(body.buffers()[2], np.uint8), offset[:-1], np.diff(offset)
    keys = [part.column(c).to_numpy() for c in ("p1", "p2", "fp")]
    order = multikey_order(keys)
    tied = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        tied &= k[order][1:] == k[order][:-1]
    new = np.ones(len(order), bool)
    at = np.flatnonzero(tied)
    new[at + 1] = ~_alike(data, start, size, order[at], order[at + 1])
    for i in np.flatnonzero(new[1:] & tied) + 1:  # different bytes under one key: sort the key's rows by their bytes
        low = i - 1
        while low and tied[low - 1]:
            low -= 1
        high = i
        while high < len(tied) and tied[high]:
            high += 1
        rows = sorted(order[low : high + 1].tolist(), key=lambda r: body[r].as_py())
        order[low : high + 1] = rows
        new[low + 1 : high + 1] = [body[x].as_py() != body[y].as_py() for x, y in zip(rows, rows[1:], strict=False)]
    return order, new


def decided(texts: DataFrame, places: DataFrame, length: int, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(asked rows of places whose suffix another row has too, one row of each kind of suffix).

    The second, in the columns of PLACE, is asked where it was and no other row has its suffix.
    """
    splitters = _splitters(texts, places, length, range_rows)

    def search(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        order, new = sorted_kinds(part)
        head = np.flatnonzero(new)
        n = np.diff(np.concatenate([head, [len(order)]]))
        several = np.repeat(n > 1, n)
        edge = np.zeros(len(order), bool)
        edge[[0, head[-1]]] = True
        asked = part.column("asked").to_numpy()[order]
        rows = np.flatnonzero(new | (several & asked))
        out = part.take(pa.array(order[rows]))
        body = pa.array(np.where(edge[rows], 0, None), pa.int64())
        kept = pc.if_else(body.is_valid(), out.column("body").combine_chunks(), pa.scalar(None, pa.binary()))
        made = {"range": out.column("range"), "body": kept, **{c: out.column(c) for c in PLACE}, "several": pa.array(several[rows]), "head": pa.array(new[rows]), "edge": pa.array(edge[rows])}
        return pa.table(made)

    kinds = f"range int, body binary, {_PLACE_KINDS}, several boolean, head boolean, edge boolean"
    found = written(_suffixes(texts, places, length, splitters).groupBy("range").applyInArrow(search, kinds), "decided")
    # at most two kinds of each range, by their bytes
    edges = found.where("edge")
    across = edges.groupBy("body").agg(F.count_distinct("range").alias("ranges"), F.min(F.struct("id", "first")).alias("one")).where("ranges > 1").select("body", "one")
    edges = edges.join(across, "body", "left")
    both = found.where("asked and several").select(*PLACE).unionByName(edges.where("asked and not several and one is not null").select(*PLACE))
    inner = found.where("head and not edge").withColumn("asked", F.col("asked") & ~F.col("several"))
    outer = edges.where((F.col("one").isNull()) | (F.col("one") == F.struct("id", "first"))).withColumn("asked", F.col("asked") & ~F.col("several") & F.col("one").isNull())
    return both, inner.select(*PLACE).unionByName(outer.select(*PLACE))


def repeated_stretches(texts: DataFrame, length: int = LENGTH, short: int = SHORT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """id, start, end of stretches that cover just the repeated bytes of the blocked texts; they may overlap."""
    by_anchor, left = decided(texts, _together(_anchors(texts, length, short)), length, range_rows)
    turns = written(_turns(texts, _together(left), length), "turns")
    turns = turns.join(F.broadcast(_hot_parts(turns)), "part", "left").withColumn("hot", F.col("often").isNotNull()).select(*PLACE)
    by_turn, left = decided(texts, _together(turns), length, range_rows)
    single = _together(left).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("windows") - 1))).withColumns({"first": F.col("first") + F.col("k"), "windows": F.lit(1)}).select(*PLACE)
    by_window, _ = decided(texts, single, length, range_rows)
    runs = by_anchor.unionByName(by_turn).unionByName(by_window)
    return runs.select("id", F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + length).alias("end"))


def cut(body: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Bytes removed, maximal runs removed, what is left, and what is left without parts of characters."""
    marks = np.zeros(len(body) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    gone = np.cumsum(marks)[:-1] > 0
    data = np.frombuffer(body, np.uint8)
    head = (data & 0xC0) != 0x80
    of = np.cumsum(head) - 1
    broken = np.bincount(of[gone], minlength=int(of[-1]) + 1)[of] > 0 if len(data) and of[0] == 0 else gone
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), runs, data[~gone].tobytes(), data[~(gone | broken)].tobytes()


def cut_texts(docs: DataFrame, columns: list[str], text: str, length: int = LENGTH, short: int = SHORT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """columns of docs, n_bytes, n_removed, n_spans, kept_sha256 and kept_text of each row.

    kept_text leaves out a character of which a byte is removed. No column may be named as one of the new ones.
    """
    texts = blocked(docs.select(*dict.fromkeys([*columns, text])), text)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(some: pa.Table, parts: pa.Table) -> pa.Table:
        order = np.argsort(parts.column("id").to_numpy(), kind="stable")
        ids, starts, ends = (parts.column(c).to_numpy()[order] for c in ("id", "start", "end"))
        low, high = (np.searchsorted(ids, some.column("id").to_numpy(), side=x) for x in ("left", "right"))
        made = []
        for body, a, z in zip(some.column("body"), low.tolist(), high.tolist(), strict=True):
            body = body.as_py()
            n, runs, left, whole = cut(body, starts[a:z], ends[a:z]) if z > a else (0, 0, body, body)
            made.append((len(body), n, runs, hashlib.sha256(left).hexdigest(), whole.decode(errors="ignore")))
        new = zip(*made, strict=True) if made else [()] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.Table.from_arrays([*[some.column(c) for c in columns], *[pa.array(x, t) for x, t in zip(new, types, strict=True)]], names=[*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    stretches = repeated_stretches(texts, length, short, range_rows)
    carried = "".join(f"`{c}` {kinds[c]}, " for c in columns)
    return _with_places(texts, stretches, ["body", *columns], run, carried + "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def repeat_report(docs: DataFrame, length: int = LENGTH, short: int = SHORT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs.

    Null texts count as empty. Texts below length bytes lose nothing; long ones are taken whole. An empty table gives an
    empty result. A row repeated as it is counts as another
    document: its text, if long enough, goes wholly from both. Only doc_id and text are read.
    """
    return cut_texts(docs.select("doc_id", "text"), ["doc_id"], "text", length, short, range_rows).drop("kept_text")


def drop_repeats(docs: DataFrame, length: int = LENGTH, short: int = SHORT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs with what is left of each text, whole characters only; rows of which no word is left go.

    Columns stay as they are, n_chars is counted anew. Rows that lose nothing stay, those with a null
    or empty text included. Repeated rows lose all of their text, if it has length bytes, and go. Texts are taken whole, however
    long. An empty table gives an empty result. Names of columns cannot clash.
    """
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    found = cut_texts(docs.select(*[F.col(c).alias(n) for c, n in names.items()]), list(names.values()), names["text"], length, short, range_rows)
    left = found.where(r"n_removed = 0 or kept_text rlike '[^\\x20\\x09-\\x0D]'")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(names["text"]))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return left.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))
