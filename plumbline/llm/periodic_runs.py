"""Maximal runs of periodic words, by suffix trees.

A run is a stretch of words with smallest period q that is at least twice as long as q and can't be made longer. Each run
ends with a branching tandem repeat: two equal halves that end where the period breaks. In a suffix tree the halves of such
a repeat are leaves of the inner node whose depth is a half's length, q words apart and below different children; a
traversal that looks at all leaves of a node but those of its greatest child, for the partner to the left and to the right,
finds all of them in n log n steps (Stoye and Gusfield). A repeat is then rotated to the left as far as the period goes;
repeats of the same run merge, as do those whose half is itself a repetition.

Documents are independent: no row is shuffled. Each task takes runs of documents at a time, and the suffix trees of a run
of documents are made together: words of different documents are different numbers, so the trees are parts of one
suffix array (by prefix doubling), whose intervals of common prefixes are the inner nodes. Only stretches that are covered
by repeated windows of WINDOW words come in, as no run of LEAST words or more lies elsewhere.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.blocks import numbering
from plumbline.llm.common import id_and_text, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run's least number of words.
LEAST = 12
#: A run of LEAST words or more is covered by windows of so many words that come again in it: half of LEAST.
WINDOW = 6
#: Words of documents whose trees are made together; a document is never cut.
BATCH_WORDS = 400_000


def covered(numbers: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words lie in a window of WINDOW words that comes again in its document, as far as hashes can tell.

    Windows of equal words have equal hashes, so that none is left out.
    """
    n = len(numbers)
    if n < 2 * WINDOW:
        return np.zeros(n, bool)
    own = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    own ^= own >> np.uint64(29)
    count = n - WINDOW + 1
    key = np.zeros(count, np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + own[k : k + count]
    key ^= key >> np.uint64(32)
    key = key * np.uint64(0x94D049BB133111EB) + doc[:count].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    whole = doc[:count] == doc[WINDOW - 1 :]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(count, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    again &= whole
    ends = np.zeros(n + 1, np.int64)
    ends[:count] += again
    ends[WINDOW : WINDOW + count] -= again
    return np.cumsum(ends)[:n] > 0


def _suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of text, each suffix's rank, and the common prefix of each with the one before it in order.

    text's last number must come once. Ranks of twice as many numbers are made of two ranks until all differ.
    """
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank], 1
    while rank.max() + 1 < n:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    common = np.zeros(n, np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        of = ranks[k]
        fine = (left < n) & (right < n)
        fine[fine] = of[left[fine]] == of[right[fine]]
        step = 1 << k
        common[1:][fine] += step
        left[fine] += step
        right[fine] += step
    return order, rank, common


def _nearest(common: np.ndarray, strict: bool, before: bool) -> np.ndarray:
    """For each place the nearest one before (after) it with a less (or, not strict, equal) value; places jump over what
    their neighbours have jumped over. The first place and a place behind the last are less than all."""
    values = np.concatenate([common, [-1]]) if not before else np.concatenate([[-1], common])
    at = np.arange(len(common)) + (1 if before else 0)
    step = -1 if before else 1
    near = np.arange(len(values)) + step
    end = 0 if before else len(values) - 1
    near[end] = end
    open_ = at[at != end]
    while len(open_):
        ahead = values[near[open_]]
        on = ahead >= values[open_] if strict else ahead > values[open_]
        open_ = open_[on]
        near[open_] = near[near[open_]]
    return near[at] - (1 if before else 0)


def branching_repeats(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each branching tandem repeat of text begins, and the length of its half."""
    n = len(text)
    order, rank, common = _suffixes(text)
    # an inner node is the widest interval of suffixes with a common prefix; boundaries of its children are the places with just that
    inner = np.flatnonzero(common > 0)
    if not len(inner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = _nearest(common, True, True)[inner]
    last = _nearest(common, True, False)[inner]
    child_end = _nearest(common, False, False)[inner]
    depth = common[inner]
    # children: one to the right of each boundary, and one to the left of a node's first boundary
    _, node = np.unique(first * (n + 1) + depth, return_inverse=True)
    by_node = np.argsort(node, kind="stable")
    lead = by_node[np.concatenate([[True], np.diff(node[by_node]) != 0])]
    begin = np.concatenate([inner, first[lead]])
    end = np.concatenate([child_end, inner[lead]])
    of, low, high, deep = (np.concatenate([x, x[lead]]) for x in (node, first, last, depth))
    size = end - begin
    # a node's children, the greatest last; all but that are looked at
    sorted_ = np.lexsort((size, of))
    small = sorted_[np.concatenate([np.diff(of[sorted_]) == 0, [False]])]
    count = size[small]
    place = np.repeat(begin[small] - np.cumsum(count) + count, count) + np.arange(count.sum())
    leaf, low, high, deep = order[place], *(np.repeat(x[small], count) for x in (low, high, deep))
    found = []
    for start in (leaf, leaf - deep):
        other = start + deep if start is leaf else start
        fine = (start >= 0) & (other < n) & (start + 2 * deep < n)
        begun, half, partner = start[fine], deep[fine], other[fine]
        inside = (rank[partner] >= low[fine]) & (rank[partner] < high[fine])
        begun, half = begun[inside], half[inside]
        branches = text[begun + half] != text[begun + 2 * half]
        found.append((begun[branches], half[branches]))
    return np.concatenate([b for b, _ in found]), np.concatenate([h for _, h in found])


def _rotated(text: np.ndarray, begin: int, half: int) -> int:
    """Where the stretch of period half that begins at begin or before it begins."""
    step = 64
    while begin > 0:
        low = max(0, begin - step)
        differs = np.flatnonzero(text[low:begin] != text[low + half : begin + half])
        if len(differs):
            return low + int(differs[-1]) + 1
        begin, step = low, 2 * step
    return 0


def maximal_runs(text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of text that have at least so many words, in that order.

    text's last number must come once.
    """
    begin, half = branching_repeats(text)
    # a short half needs words of the same period before it
    for k in range(1, least - 1):
        short = 2 * half + k <= least
        fine = ~short | (begin >= k)
        fine[short & fine] = text[(begin - k)[short & fine]] == text[(begin - k + half)[short & fine]]
        begin, half = begin[fine], half[fine]
    stop = begin + 2 * half
    order = np.lexsort((half, stop))
    runs, here = [], (-1, [])
    for b, h, e in zip(begin[order].tolist(), half[order].tolist(), stop[order].tolist(), strict=True):
        if e != here[0]:
            here = (e, [])
        # repeats that end together: one whose half is a repetition, or that is found twice, lies in the run of a shorter half
        if any(h % q == 0 and b >= s for q, s in here[1]):
            continue
        start = _rotated(text, b, h)
        here[1].append((h, start))
        runs.append((start, e - start, h))
    return sorted(runs)


def _runs_of(numbers: np.ndarray, sizes: list[int], least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each of the documents that follow each other in numbers."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = covered(numbers, doc)
    if not inside.any():
        return runs
    place = np.flatnonzero(inside)
    apart = np.concatenate([[True], (np.diff(place) > 1) | (np.diff(doc[place]) > 0)])
    piece = np.cumsum(apart) - 1
    starts = np.flatnonzero(apart)
    # stretches one after the other, with a number of its own behind each; numbers of different documents differ
    values = doc[place].astype(np.int64) * (int(numbers.max()) + 1) + numbers[place]
    text = np.empty(len(place) + len(starts), np.int64)
    at = np.arange(len(place)) + piece
    text[at] = values
    behind = np.append(starts[1:], len(place)) + np.arange(len(starts))
    text[behind] = int(values.max()) + 1 + np.arange(len(starts))
    first = np.concatenate([[0], np.cumsum(sizes)])
    of_text = np.zeros(len(text), np.int64)
    of_text[at] = place
    for start, length, period in maximal_runs(text, least):
        word = int(of_text[start])
        runs[int(doc[word])].append((word - int(first[doc[word]]), length, period))
    return [sorted(r) for r in runs]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """words without those that a run has behind its first period."""
    if not runs:
        return words
    ends = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        ends[start + period] += 1
        ends[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(ends)[:-1] == 0).tolist()]


def words_of(text: str) -> list[str]:
    return WORD.findall(text)


_KINDS = {"n_words": "long", "runs": "array<struct<start:long,length:long,period:long>>", "collapsed": "string"}
_ARROW = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]


def _mapped(docs: DataFrame, change, make, kinds: dict[str, str], arrow: list[pa.DataType], least: int, batch_words: int) -> DataFrame:
    """doc_id and what make(words, runs) gives of each document; change(doc_id, words) are the words that count."""
    own = id_and_text(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, number, numbers = [], [], numbering(), []

        def rows() -> pa.RecordBatch:
            found = _runs_of(np.concatenate(numbers) if numbers else np.zeros(0, np.int64), [len(x) for x in numbers], least)
            made = list(zip(*[make(w, r) for w, r in zip(texts, found, strict=True)], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(x, t) for x, t in zip(made, arrow, strict=True)]], names=["doc_id", *kinds])

        held = 0
        for batch in batches:
            kind = batch.column("doc_id").type
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = change(i, words_of(text.as_py()))
                ids.append(i), texts.append(words)
                numbers.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                held += len(words) + 1
                if held >= batch_words:
                    yield rows()
                    ids, texts, number, numbers, held = [], [], numbering(), [], 0
        if ids:
            yield rows()

    schema = ", ".join([f"doc_id {own.schema['doc_id'].dataType.simpleString()}", *[f"{c} {t}" for c, t in kinds.items()]])
    return own.select("doc_id", "text").mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, least: int = LEAST, batch_words: int = BATCH_WORDS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start) and collapsed (the text's words without those that a run
    repeats, joined by spaces) of each row of docs.

    Runs have at least `least` words (12 or more). Null texts count as empty: no words, no runs, an empty text. Rows are
    independent: repeated rows and repeated or null doc_ids come out as they are. Texts are taken whole, however long; a
    batch has one at least. An empty table gives an empty result. Only doc_id and text are read.
    """
    if least < 2 * WINDOW:
        raise ValueError(f"least must be at least {2 * WINDOW}")
    make = lambda words, runs: (len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], " ".join(collapsed(words, runs)))
    return _mapped(docs, lambda _, words: words, make, _KINDS, _ARROW, least, batch_words)


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """words of one in ten documents made periodic from some place on, by the crc32 of the doc_id (null: of no bytes)."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def run_digests(docs: DataFrame, least: int = LEAST, batch_words: int = BATCH_WORDS) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; nulls where there is none), and digests of
    all runs and of the collapsed text, of documents as planted() changes them; cases as periodic_runs has them."""

    def make(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        said = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(runs, key=lambda r: (r[0], r[2])))
        return len(runs), s, n, q, None if s is None else 1000 * n // q, _sha256(said), _sha256(" ".join(collapsed(words, runs)))

    kinds = {c: "long" for c in ("n_runs", "start", "length", "period", "exponent_milli")} | {"runs_sha256": "string", "collapsed_sha256": "string"}
    return _mapped(docs, planted, make, kinds, [pa.int64()] * 5 + [pa.string()] * 2, least, batch_words)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))
