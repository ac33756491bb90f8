"""Documents as blocks over distinct strings, and what is made once for each distinct string of the corpus.

A block is one row for about ``BLOCK_BYTES`` of texts: columns of its documents, its distinct strings (chunks, pre-tokens),
and documents in terms of positions among them; blocks are written once, bucketed, and are not shuffled. Their distinct
strings are, twice and packed: by a hash, so that each is looked up in one task once for all, however many blocks have it;
and back to their block.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import kept_table

BLOCK_BYTES = 16_000_000
#: Strings of all blocks that a share is to have.
SHARE_STRINGS = 500_000
_FOUND = "to long, n int, values int, places binary, lengths binary, flat binary, other array<int>, texts array<string>"


_ZSTD = pa.Codec("zstd", compression_level=3)


def shrunk(x: np.ndarray) -> bytes:
    """Numbers as bytes: their lowest bytes first, then the next ones and so on, as each kind packs better by itself."""
    planes = np.ascontiguousarray(x, np.int32).view(np.uint8).reshape(-1, 4).T
    return _ZSTD.compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def grown(x: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    planes = np.frombuffer(pa.decompress(x, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def by_frequency(line: np.ndarray, strings: list[str]) -> tuple[np.ndarray, list[str]]:
    """Positions among strings, and the strings, so numbered that frequent ones have small numbers."""
    order = np.argsort(-np.bincount(line, minlength=len(strings)), kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    return number[line], [strings[i] for i in order.tolist()]


def gathered(flat: np.ndarray, lengths: np.ndarray, rows: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """The stretches of flat (of the given lengths) in the order of rows. begin: of the stretches, where a caller has them."""
    begin, n = np.cumsum(lengths) - lengths if begin is None else begin, lengths[rows]
    return flat[np.repeat(begin[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def numbering() -> dict:
    """Numbers strings as they come, from 0."""
    return defaultdict(count().__next__)


def as_rows(docs: DataFrame, columns: tuple[str, ...], start: Callable[[], object], kinds: dict[str, str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks, written: block, an array of each of columns, and what start() makes of a block's texts.

    start gives an object with add(text) and row(), a dict of Arrow arrays of one value each, of the given kinds.
    """
    own = {c: docs.schema[c].dataType.simpleString() for c in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seq, size, made, held = TaskContext.get().partitionId() << 24, 0, 0, start(), []

        def record() -> pa.RecordBatch:
            kept = [pa.concat_arrays([b.column(c) for b in held]) for c in columns]
            arrays = {"block": pa.array([here + seq], pa.int64()), **{c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for c, x in zip(columns, kept, strict=True)}, **made.row()}
            return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

        for batch in batches:
            first = 0
            for i, text in enumerate(batch.column("text")):
                said = text.as_py()
                made.add(said)
                size += len(said)
                if size >= block_bytes:
                    held.append(batch.slice(first, i + 1 - first))
                    yield record()
                    seq, size, made, held, first = seq + 1, 0, start(), [], i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield record()

    schema = ", ".join(["block long", *[f"`{c}` array<{t}>" for c, t in own.items()], *[f"`{c}` {t}" for c, t in kinds.items()]])
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept_table(docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, schema), "blocks", "block", buckets)


def _bytes(strings: list[str]) -> tuple[bytes, np.ndarray]:
    """The strings' bytes in one, compressed, and their sizes."""
    raw = [x.encode() for x in strings]
    return _ZSTD.compress(b"".join(raw), asbytes=True), np.array([len(x) for x in raw], np.int64)


def _strings(data: bytes, sizes: np.ndarray) -> list[str]:
    end = np.cumsum(sizes).tolist()
    whole = pa.decompress(data, end[-1], "zstd", asbytes=True) if end[-1] else b""
    return [whole[a:z].decode() for a, z in zip([0, *end], end, strict=False)]


def _dealt(blocks: DataFrame, strings: str, shares: int) -> DataFrame:
    """share, block, n and, packed, the places and bytes of a block's strings that have the share by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, said in zip(batch.column("block").to_pylist(), batch.column(strings).to_pylist(), strict=True):
                share = np.fromiter((zlib.crc32(x.encode()) % shares for x in said), np.int64, len(said))
                # strings beside their like, as they pack better; a share is in the order of its strings
                order = np.array(sorted(range(len(said)), key=said.__getitem__), np.int64)
                order = order[np.argsort(share[order], kind="stable")]
                for some in np.split(order, np.flatnonzero(np.diff(share[order])) + 1) if len(order) else []:
                    data, sizes = _bytes([said[i] for i in some.tolist()])
                    made = {"share": [int(share[some[0]])], "block": [block], "n": [len(some)], "places": [shrunk(some)], "sizes": [shrunk(sizes)], "data": [data]}
                    yield pa.RecordBatch.from_pydict(made, schema=_DEALT)

    return blocks.select("block", strings).mapInArrow(run, "share int, block long, n int, places binary, sizes binary, data binary")


def looked_up(blocks: DataFrame, strings: str, make: Callable[[], Callable[[list[str]], tuple[list[list[int]], list[str | None]]]], share_strings: int = SHARE_STRINGS) -> DataFrame:
    """What make() gives of the distinct strings, packed for their blocks (to).

    make() is called once in each task and gives a function of a list of strings: numbers of each, and a text or none.
    Strings are dealt to shares of about share_strings by their hash; a share is in one task, which looks each string up
    the first time that a block has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, now, known = make(), None, {}
        for batch in batches:
            for share, block, n, places, sizes, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if share != now:
                    now, known = share, {}
                said = _strings(data, grown(sizes, n))
                fresh = [x for x in said if x not in known]
                if fresh:
                    known.update(zip(fresh, zip(*of(fresh), strict=True), strict=True))
                yield _found_row(block, grown(places, n), places, [known[x] for x in said])

    return _shared(blocks, strings, share_strings).mapInArrow(run, _FOUND)


def _shared(blocks: DataFrame, strings: str, share_strings: int) -> DataFrame:
    """_dealt, each share in one task, its rows together."""
    total = blocks.agg(F.sum(F.size(strings))).first()[0] or 0
    shares = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // share_strings))
    return _dealt(blocks, strings, shares).repartition(shares, "share").sortWithinPartitions("share")


def looked_up_by(blocks: DataFrame, strings: str, make: Callable[[Column], Column], share_strings: int = SHARE_STRINGS, row_strings: int = 2_000) -> DataFrame:
    """As looked_up, with a Column in place of a Python function.

    make() gives, of an array of distinct strings, an array of struct<numbers:array<int>,said:string>, in their order.
    """
    packed = ["block", "n", "places", "sizes", "data"]

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows as they are (without words), and, among them, the words that come for the first time in a share."""
        now, known, fresh = None, set(), []

        def words() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"share": [now], **{c: [None] for c in packed}, "words": [fresh]}, schema=_WORDS)

        for batch in batches:
            for i, (share, n, sizes, data) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("share", "n", "sizes", "data")], strict=True)):
                if share != now:
                    if fresh:
                        yield words()
                    now, known, fresh = share, set(), []
                for x in _strings(data, grown(sizes, n)):
                    if x not in known:
                        known.add(x)
                        fresh.append(x)
                        if len(fresh) == row_strings:
                            yield words()
                            fresh = []
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column(c) for c in ("share", *packed)] + [pa.nulls(1, pa.list_(pa.string()))], schema=_WORDS)
        if fresh:
            yield words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a share wait until its last words are there; a projection leaves a partition's rows in their order."""
        now, held, known = None, [], {}

        def rows() -> Iterator[pa.RecordBatch]:
            for r in held:
                yield _found_row(r["block"], grown(r["places"], r["n"]), r["places"], [known[x] for x in _strings(r["data"], grown(r["sizes"], r["n"]))])

        for batch in batches:
            for i, r in enumerate(batch.select(["share", *packed]).to_pylist()):
                if r["share"] != now:
                    yield from rows()
                    now, held, known = r["share"], [], {}
                words = batch.column("words")[i]
                if not words.is_valid:
                    held.append(r)
                    continue
                made = batch.column("made")[i].values
                numbers = made.field("numbers")
                end, flat = (numbers.offsets.to_numpy() - numbers.offsets[0].as_py()).tolist(), numbers.flatten().to_numpy().tolist()
                known.update(zip(words.values.to_pylist(), zip([flat[a:z] for a, z in zip(end, end[1:], strict=False)], made.field("said").to_pylist(), strict=True), strict=True))
        yield from rows()

    kinds = "share int, block long, n int, places binary, sizes binary, data binary, words array<string>"
    words = _shared(blocks, strings, share_strings).mapInArrow(distinct, kinds)
    return words.withColumn("made", F.when(F.col("words").isNotNull(), make(F.col("words")))).mapInArrow(run, _FOUND)


def _found_row(block: int, place: np.ndarray, places: bytes, found: list[tuple[list[int], str | None]]) -> pa.RecordBatch:
    flat = np.array([i for numbers, _ in found for i in numbers], np.int64)
    other = [(int(p), text) for p, (_, text) in zip(place, found, strict=True) if text is not None]
    made = {"to": [block], "n": [len(found)], "values": [len(flat)], "places": [places], "lengths": [shrunk(np.array([len(x) for x, _ in found]))], "flat": [shrunk(flat)], "other": [[p for p, _ in other]], "texts": [[t for _, t in other]]}
    return pa.RecordBatch.from_pydict(made, schema=_ARROW)


_DEALT = pa.schema([("share", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("places", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
_WORDS = pa.schema([("share", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("places", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("words", pa.list_(pa.string()))])
_ARROW = pa.schema([("to", pa.int64()), ("n", pa.int32()), ("values", pa.int32()), ("places", pa.binary()), ("lengths", pa.binary()), ("flat", pa.binary()), ("other", pa.list_(pa.int32())), ("texts", pa.list_(pa.string()))])


def joined_back(blocks: DataFrame, columns: list[str], found: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(a block's values by column, lengths and numbers of its strings in their order, texts by position) over all blocks."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        row, rows = left.combine_chunks(), right.to_pylist()
        lists = [[grown(r[c], r[k]) for r in rows] for c, k in (("places", "n"), ("lengths", "n"), ("flat", "values"))]
        place, lengths, flat = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in lists)
        order = np.argsort(place)
        texts = {p: t for r in rows for p, t in zip(r["other"], r["texts"], strict=True)}
        return run({c: row.column(c).chunk(0) for c in columns}, lengths[order], gathered(flat, lengths, order), texts)

    return blocks.select("block", *columns).groupBy("block").cogroup(found.groupBy("to")).applyInArrow(both, schema)
