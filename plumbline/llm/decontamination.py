r"""Benchmark decontamination through suffix arrays of the training texts.

Documents stay where they were read; each run of documents that a task takes at a time is one shard. Its words become
numbers (0 for those that no benchmark item has), its suffixes are sorted, and every suffix of the benchmark, cut to its
window, is searched by bisection. The places found mark the document's words; places that continue each other in
document and item are joined to the longest verbatim matches. Nothing is shuffled and a hot item costs what its places
cost.

The benchmark goes to the tasks in blocks of about ``BLOCK_WORDS`` words, one broadcast each. A task makes the index of each
block once and keeps it, so that no more than ``KEPT`` blocks are searched in one pass over the documents. A larger
benchmark has further passes, whose hits are written and joined by row; its size is not limited. Suffixes that could not hold the shortest window, as one of its words is in no item, are left out of the array.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, UPPER, map_texts, table, written

WINDOW = 10
#: Words of the benchmark in a block, about.
BLOCK_WORDS = 250_000
#: Documents that make a shard.
SHARD_ROWS = 2000
#: Bytes: A-Z to a-z; words are 0-9, a-z and all of a character outside ASCII; the rest to spaces.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def sorted_suffixes(line: np.ndarray, starts: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """starts in the order of their first depth words. Several words are packed into a key; ties go on to the next."""
    step = max(1, 62 // bits)
    padded = np.concatenate([line.astype(np.int64), np.zeros(depth + step + 1, np.int64)])

    def key(at: np.ndarray, off: int) -> np.ndarray:
        k = np.zeros(len(at), np.int64)
        for i in range(step):
            k = (k << bits) | padded[np.minimum(at + off + i, len(padded) - 1)]
        return k

    keys = key(starts, 0)
    place = np.argsort(keys, kind="stable")
    order, keys = starts[place], keys[place]
    group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) if len(keys) else keys
    off = step
    open_ = np.arange(len(order))
    while off < depth and len(open_):
        g = group[open_]
        tied = np.zeros(len(g), bool)
        same = g[1:] == g[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        open_ = open_[tied]
        if not len(open_):
            break
        g, k = group[open_], key(order[open_], off)
        place = np.lexsort((k, g))
        order[open_], g, k = order[open_][place], g[place], k[place]
        group[open_] = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]) | (k[1:] != k[:-1])]))
        off += step
    return order


class TestIndex:
    """The distinct windows of a block of benchmark items, and where each stands."""

    __test__ = False

    def __init__(self, items: list[tuple], window: int) -> None:
        self.items = items
        lists = [words(t) for _, t in items]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for ws in lists for w in ws}))}
        self.bits = max(1, len(self.ids).bit_length())
        by: dict[tuple, list] = {}
        for k, ws in enumerate(lists):
            nums = [self.ids[w] for w in ws]
            for at in range(max(1, len(nums) - window + 1) if nums else 0):
                by.setdefault(tuple(nums[at : at + window]), []).append((k, at))
        self.size = np.array([len(w) for w in by], np.int64)
        self.rows = np.zeros((len(by), window), np.int64)
        for i, w in enumerate(by):
            self.rows[i, : len(w)] = w
        self.first = np.concatenate([[0], np.cumsum([len(v) for v in by.values()])]).astype(np.int64)
        self.stands = np.array([x for v in by.values() for x in v], np.int64).reshape(-1, 2)

    def places(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in line) of each occurrence. line: word numbers, 0 between documents."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.size) or not len(line):
            return none
        least, window = int(self.size.min()), self.rows.shape[1]
        gone = np.concatenate([[0], np.cumsum(line == 0)])
        starts = np.arange(max(0, len(line) - least + 1))
        starts = starts[gone[starts + least] == gone[starts]]
        if not len(starts):
            return none
        suffixes = sorted_suffixes(line, starts, window, self.bits)
        padded = np.concatenate([line, np.zeros(window, np.int64)])

        def bisect(after: bool) -> np.ndarray:
            low, high = np.zeros(len(self.size), np.int64), np.full(len(self.size), len(suffixes))
            while (going := low < high).any():
                mid = (low + high) // 2
                at = suffixes[np.minimum(mid, len(suffixes) - 1)]
                less, even = np.zeros(len(low), bool), np.ones(len(low), bool)
                for i in range(window):
                    a, b, on = padded[at + i], self.rows[:, i], even & (i < self.size)
                    less |= on & (a < b)
                    even &= ~on | (a == b)
                right = (less | even if after else less) & going
                low, high = np.where(right, mid + 1, low), np.where(going & ~right, mid, high)
            return low

        low = bisect(after=False)
        n = bisect(after=True) - low
        found = np.repeat(np.arange(len(n)), n)
        return found, suffixes[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]


def _search(lists: list[list[bytes]], index: TestIndex) -> tuple[list[np.ndarray], list[list[tuple]]]:
    """Of each document: the words that are hit (a mask), and its longest matches (item, start, words, item_start)."""
    get, line, begins = index.ids.get, [], []
    for ws in lists:
        begins.append(len(line))
        line += [get(w, 0) for w in ws]
        line.append(0)
    nums = np.array(line, np.int64)
    window, at = index.places(nums)
    marks = np.zeros(len(nums) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + index.size[window], -1)
    hit = np.cumsum(marks)[:-1] > 0
    masks = [hit[b : b + len(ws)] for b, ws in zip(begins, lists, strict=True)]
    n = index.first[window + 1] - index.first[window]
    place = np.repeat(index.first[window], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, inside = index.stands[place].T if len(place) else (place, place)
    at, length = np.repeat(at, n), np.repeat(index.size[window], n)
    order = np.lexsort((at, at - inside, item))
    item, inside, at, length = item[order], inside[order], at[order], length[order]
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (at[1:] - inside[1:] != at[:-1] - inside[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(at)]])[: len(heads)] - 1
    doc = np.searchsorted(np.array(begins), at[heads], side="right") - 1 if len(heads) else heads
    runs: list[list[tuple]] = [[] for _ in lists]
    for d, a, z in zip(doc.tolist(), heads.tolist(), tails.tolist(), strict=True):
        runs[d].append((index.items[item[a]][0], int(at[a]) - begins[d], int(at[z] + length[z] - at[a]), int(inside[a])))
    return masks, runs


def _block_rows(benchmark: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(block, items: item_id as text, and text) and the number of blocks; each has about that many words at most, or one item.

    Spark deals items to blocks by hash and writes a block as one row, so the driver holds one at a time.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    # a word has a byte and a separator at least
    total = items.agg(F.sum(F.floor(F.octet_length("text") / 2) + 1)).first()[0] or 0
    blocks = max(1, -(-int(total) // most))
    dealt = items.groupBy(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_set(F.struct("item", "text"))).alias("items"))
    return dealt, blocks


def _passes(benchmark: DataFrame, most: int) -> Iterator[list]:
    """Broadcasts of (item, text) lists, KEPT of them at a time."""
    context = benchmark.sparkSession.sparkContext
    dealt, blocks = _block_rows(benchmark, most)
    if blocks > KEPT:
        dealt = written(dealt, "benchmark-blocks")
    held = []
    for row in dealt.orderBy("block").toLocalIterator():
        held.append(context.broadcast([tuple(x) for x in row["items"]]))
        if len(held) == KEPT:
            yield held
            held = []
    yield held


#: Blocks that are searched in one pass; a task keeps their indexes.
KEPT = 4
_MATCHES = "array<struct<item_id:string,start:long,words:long,item_start:long>>"
_KINDS = {"n_words": "long", "n_hit": "long", "matches": _MATCHES, "spans": "array<struct<start:long,stop:long>>"}


def _searched(docs: DataFrame, blocks: list, window: int, columns: tuple[str, ...], shard_rows: int) -> DataFrame:
    """The columns, n_words, n_hit, matches, and spans: the stretches of words that are hit, for these blocks."""

    def start():
        kept: dict[int, TestIndex] = {}

        def index(k: int) -> TestIndex:
            if k not in kept:
                kept[k] = TestIndex(blocks[k].value, window)
            return kept[k]

        def make(texts: list) -> list[list]:
            lists = [words(t) for t in texts]
            masks, runs = [np.zeros(len(ws), bool) for ws in lists], [[] for _ in lists]
            for b in range(len(blocks)):
                for k, (mask, run) in enumerate(zip(*_search(lists, index(b)), strict=True)):
                    masks[k] |= mask
                    runs[k] += run
            as_rows = [[dict(zip(("item_id", "start", "words", "item_start"), r, strict=True)) for r in run] for run in runs]
            return [[len(ws) for ws in lists], [int(m.sum()) for m in masks], as_rows, [_spans(m) for m in masks]]

        return make

    return map_texts(docs, start, _KINDS, columns, rows=shard_rows)


def _spans(mask: np.ndarray) -> list[dict[str, int]]:
    ends = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [{"start": a, "stop": z} for a, z in zip(ends[::2].tolist(), ends[1::2].tolist(), strict=True)]


def _covered(spans: Column) -> Column:
    """How many words lie in any of the spans."""
    state = lambda stop, n: F.struct(stop.alias("stop"), n.alias("n"))
    more = lambda now, s: F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(now["stop"], s["start"]))
    zero = F.lit(0).cast("long")
    return F.aggregate(F.sort_array(spans), state(zero, zero), lambda now, s: state(F.greatest(now["stop"], s["stop"]), now["n"] + more(now, s)), lambda now: now["n"])


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, columns: tuple[str, ...] = ("doc_id",), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The given columns, n_words, n_hit and matches of each row of docs.

    A match is a longest verbatim run: item_id, start (word of the document), words, item_start. Null texts and texts
    without words have none. Items without words match nothing; repeated items count once in item lists; an item whose
    item_id is null marks words but stands in no list. Rows of docs are independent, so repeated ones are treated alike.
    Empty tables give no rows, or rows without hits. Texts are taken whole, however long. Other columns are not read.
    """
    passes = _passes(benchmark, block_words)
    first, second = next(passes), next(passes, None)
    if not second:
        return _searched(docs, first, window, columns, shard_rows).drop("spans")
    spark = docs.sparkSession
    # rows have a number that outlives a pass
    names = {c: f"_own{i}" for i, c in enumerate(columns)}
    own = written(docs.select(*[F.col(c).alias(n) for c, n in names.items()], "text", F.monotonically_increasing_id().alias("_row")), "decontamination")
    whole = written(_searched(own, first, window, ("_row", *names.values()), shard_rows), "hits")
    found = whole.where("n_hit > 0").select("_row", "matches", "spans")
    for blocks in itertools.chain([second], passes):
        if blocks:
            more = _searched(own, blocks, window, ("_row",), shard_rows).where("n_hit > 0").select("_row", "matches", "spans")
            found = found.unionByName(written(more, "hits"))
        for b in blocks:
            b.unpersist()
    merged = found.groupBy("_row").agg(F.flatten(F.collect_list("matches")).alias("_matches"), F.flatten(F.collect_list("spans")).alias("_spans"))
    joined = whole.drop("matches", "spans").join(merged, "_row", "left")
    empty = F.array().cast(_MATCHES)
    return joined.select(*[F.col(n).alias(c) for c, n in names.items()], "n_words", F.coalesce(_covered(F.col("_spans")), F.lit(0).cast("long")).alias("n_hit"), F.coalesce("_matches", empty).alias("matches"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, columns as they are.

    Null and empty texts stay, and repeated rows stay or go together; texts are taken whole, however long. An empty table of
    documents gives an empty result, an empty benchmark all documents. Names of columns cannot clash.
    """
    names = {c: "text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)}
    found = verbatim_matches(docs.select(*[F.col(c).alias(n) for c, n in names.items()]), benchmark, window, columns=tuple(names.values()))
    return found.where("n_hit = 0").select(*[F.col(n).alias(c) for c, n in names.items()])


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs."""
    items = F.array_sort(F.array_distinct(F.filter("matches.item_id", lambda x: x.isNotNull())))
    return (
        verbatim_matches(docs, benchmark, window)
        .withColumn("items", items)
        .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = rf"""
with d as (
  select row_number() over () as n, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
  select row_number() over () as k, item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), windows as (
  select distinct item, least(len(ws), {WINDOW}) as size, array_to_string(ws[i : i + least(len(ws), {WINDOW}) - 1], ' ') as w
  from b, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) as r(i) where len(ws) > 0
), places as (
  select n, i, s.size, array_to_string(ws[i : i + s.size - 1], ' ') as w from d, (select distinct size from windows) as s, unnest(range(1, len(ws) - s.size + 2)) as r(i) where len(ws) >= s.size
), found as (
  select n, i, places.size, item from places join windows on places.size = windows.size and places.w = windows.w
), hit as (
  select n, count(distinct i + j) as n_hit from found, range(0, {WINDOW}) as r(j) where j < size group by n
), named as (
  select n, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from found group by n
)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (n) left join named using (n)
"""
