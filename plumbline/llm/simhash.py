r"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint has 64 bits; bit i is 1 if over half of a text's shingle hashes have it. Fingerprints within ``BITS``
differing bits are linked, and a document's component is all that its links reach.

Only distinct fingerprints are compared. Two of them within 2 bits agree wholly on one of three blocks of their bits, so
each fingerprint stands in three tables, in each with another block turned to the front. A table is sorted by Gray rank
(the place of the fingerprint in the reflected Gray code), which keeps equal leading bits together and neighbours near.
Sampled splitters cut it into shards. Over the shards stands the top of the index: of each the bits that all of its
fingerprints share, as mask and pattern. A fingerprint whose block runs over several shards visits those later ones
whose shared bits differ from it in few enough places. Within a shard the index goes on: groups of ``FAN`` consecutive
entries, groups of groups and so on, each with the shared bits that its parent does not have; a search carries the
differences met so far down and leaves out whole groups once they are over the limit.

A shard returns no pairs but, for each fingerprint linked there, the least one linked to it; components are found from
those. A fingerprint has at most 2080 others within 2 bits, so hot groups cost in proportion to their distinct
fingerprints, and a group of equal texts is one fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import id_and_text, map_texts, table, text_key, written
from plumbline.llm.components import components

BITS = 2
SHINGLE = 3
SEED = 42
#: Consecutive entries, or groups, under one node of the index.
FAN = 16
#: Table entries of a shard that the splitters aim at, and sampled entries for each splitter.
SHARD_ENTRIES, SAMPLES = 100_000, 30
#: Searches that go down the index together, and pairs of a search and a node that they may have; beyond that they are
#: divided.
TOGETHER, FRONTIER = 20_000, 4_000_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned; zero for a text without words. A-Z are lower-cased; words are what stands between ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts, n = np.concatenate([[0], ends[:-1] + 1]), max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):  # bounded memory for long texts
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, *more: str, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the columns in more and fp (a signed long with the fingerprint's bits) of each row."""
    signed = lambda u: u - 2**64 if u >= 2**63 else u
    return map_texts(docs, lambda: lambda texts: [[signed(fingerprint(t, shingle)) for t in texts]], {"fp": "long"}, ("doc_id", *more))


def blocks(limit: int) -> list[tuple[int, int]]:
    """(first bit, bits) of limit + 1 blocks of the 64 bits; two fingerprints within limit agree on one of them."""
    edge = [64 * i // (limit + 1) for i in range(limit + 2)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def turned(fp: np.ndarray, first: int) -> np.ndarray:
    """The fingerprints with the given bit (0: the highest) turned to the front."""
    return fp if not first else (fp << np.uint64(first)) | (fp >> np.uint64(64 - first))


def gray_rank(x: np.ndarray) -> np.ndarray:
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


class GrayIndex:
    """Fingerprints in Gray order under nodes of shared bits. Those that are searched for must agree on lead bits."""

    def __init__(self, fps: np.ndarray, lead: int, limit: int) -> None:
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps, self.limit = fps[self.order], limit
        self.lead = np.uint64((2**lead - 1) << (64 - lead))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # first to last: top to bottom
        shared, pattern = np.full(len(fps), 2**64 - 1, np.uint64), self.fps
        while len(pattern) > FAN:
            at = np.arange(0, len(pattern), FAN)
            same = np.bitwise_and.reduceat(shared, at) & ~(np.bitwise_or.reduceat(pattern, at) ^ np.bitwise_and.reduceat(pattern, at))
            # a bit that a member doesn't share may look alike in the patterns; the and of the masks leaves it out
            own = shared & ~np.repeat(same, FAN)[: len(shared)]
            self.levels.insert(0, (own, pattern))
            shared, pattern = same, pattern[at]
        self.levels.insert(0, (shared, pattern))

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry in the order given) of all pairs within the limit that agree on the leading bits."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(queries), TOGETHER):
            part = queries[at : at + TOGETHER]
            n = len(self.levels[0][0])
            start = np.repeat(np.arange(len(part)), n), np.tile(np.arange(n), len(part)), np.zeros(len(part) * n, np.uint8)
            found += [(q + at, self.order[node]) for q, node in self._down(part, 0, *start)]
        q, e = (np.concatenate(x) for x in zip(*found, strict=True))
        return q, e

    def _down(self, queries: np.ndarray, level: int, q: np.ndarray, node: np.ndarray, diff: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, place) of what is found under pairs of a query and a node of a level; diff: differences met above."""
        mask, pattern = self.levels[level]
        x = (queries[q] ^ pattern[node]) & mask[node]
        diff = diff + np.bitwise_count(x)
        stays = (diff <= self.limit) & (x & self.lead == 0)
        q, node, diff = q[stays], node[stays], diff[stays]
        if level + 1 == len(self.levels):
            yield q, node
            return
        for at in range(0, len(q), FRONTIER // FAN):
            some = slice(at, at + FRONTIER // FAN)
            below = (node[some, None] * FAN + np.arange(FAN)).ravel()
            inside = below < len(self.levels[level + 1][0])
            yield from self._down(queries, level + 1, np.repeat(q[some], FAN)[inside], below[inside], np.repeat(diff[some], FAN)[inside])


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the numbers 0 to n - 1 that each reaches over links a, b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(distinct: DataFrame, limit: int = BITS, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """a, b: fingerprints (fp of distinct, each once) joined to another one within limit bits, enough for components."""
    spark = distinct.sparkSession
    parts = blocks(limit)
    n = distinct.count()
    shards = max(1, -(-n // shard_entries))
    rate = min(1.0, SAMPLES * shards / max(n, 1))
    sample = np.array([r["fp"] for r in distinct.sample(rate, seed=SEED).collect()], np.int64).view(np.uint64)
    cuts = []
    for first, _ in parts:
        ranks = np.sort(gray_rank(turned(sample, first)))
        cuts.append(np.unique(ranks[len(ranks) * np.arange(1, shards) // shards]) if len(ranks) else ranks)
    starts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])

    def own_shards(fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for t, (first, _) in enumerate(parts):
            x = turned(fp, first)
            yield t, x, np.searchsorted(cuts[t], gray_rank(x), side="right") + starts[t]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for _, x, shard in own_shards(fp):
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(x.view(np.int64))], names=["shard", "x"])

    # one row for each shard: what all in it share
    top = distinct.mapInArrow(place, "shard int, x long").groupBy("shard").agg(F.expr("bit_and(x)").alias("all"), F.expr("bit_or(x)").alias("any")).collect()
    shared, pattern = np.zeros(starts[-1], np.uint64), np.zeros(starts[-1], np.uint64)
    for r in top:
        every, some = np.array([r["all"], r["any"]], np.int64).view(np.uint64)
        shared[r["shard"]], pattern[r["shard"]] = ~(every ^ some), every

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for t, x, shard in own_shards(fp):
                tail = np.uint64(2 ** (64 - parts[t][1]) - 1)
                rank = gray_rank(x)
                to = np.searchsorted(cuts[t], rank | tail, side="right") + starts[t]
                # the leading bits of ranks and fingerprints correspond, so a block is one run of ranks
                rows, shards_of, visits = [np.arange(len(x))], [shard], [np.zeros(len(x), bool)]
                for step in range(1, int((to - shard).max(initial=0)) + 1):
                    r = np.flatnonzero(to - shard >= step)
                    s = shard[r] + step
                    near = np.bitwise_count((x[r] ^ pattern[s]) & shared[s]) <= limit
                    rows.append(r[near]), shards_of.append(s[near]), visits.append(np.ones(near.sum(), bool))
                at, s, v = map(np.concatenate, (rows, shards_of, visits))
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(fp[at].view(np.int64)), pa.array(v)], names=["shard", "fp", "visits"])

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first, width = parts[int(np.searchsorted(starts, key[0], side="right")) - 1]
        fp = np.concatenate([pdf.loc[~pdf["visits"], "fp"].to_numpy(), pdf.loc[pdf["visits"], "fp"].to_numpy()])
        x, here = turned(fp.view(np.uint64), first), int((~pdf["visits"]).sum())
        if not here:
            return pd.DataFrame({"a": fp[:0], "b": fp[:0]})
        q, e = GrayIndex(x[:here], width, limit).within(x)
        q, e = q[q > e], e[q > e]
        label = least_linked(len(fp), q, e)
        moved = label != np.arange(len(fp))
        return pd.DataFrame({"a": fp[moved], "b": fp[label[moved]]})

    return distinct.mapInArrow(deal, "shard int, fp long, visits boolean").groupBy("shard").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, limit: int = BITS, shingle: int = SHINGLE, with_key: bool = False) -> DataFrame:
    """doc_id, fp and component_id of each row of docs, and key (of the text) where asked for.

    component_id is the smallest doc_id that links reach, its own included; null doc_ids count only where there is no
    other. Null texts count as empty; all texts without words have fingerprint zero, which links like any other.
    Repeated rows are each returned, long texts hashed whole. An empty table gives an empty result. Only doc_id and text
    are read.
    """
    own = id_and_text(docs).withColumn("key", text_key(F.col("text"))) if with_key else id_and_text(docs)
    fps = written(fingerprints(own, *["key"] * with_key, shingle=shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), limit)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(best, "root").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame, limit: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that with the component's doc_id; columns as they are.

    Where a doc_id has several texts in a component, the one with the smallest key stays; of equal rows one. Null, empty and
    wordless texts are alike, and one of them stays; texts are taken whole, however long. An empty table gives an empty
    result. Names of columns cannot clash.
    """
    found = near_duplicates(docs, limit, shingle, with_key=True).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = found.groupBy("component_id").agg(F.min(F.struct("key")).alias("least"), F.count("*").alias("rows")).select(F.col("component_id").alias("stay_id"), F.col("least.key").alias("stay_key"), "rows")
    stay = written(stay, "representatives")
    keyed = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col("doc_id").alias("own_id"), text_key(F.coalesce("text", F.lit(""))).alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_key") == F.col("stay_key"))
    single = keyed.join(stay.where("rows = 1"), same, "left_semi")
    several = keyed.join(stay.where("rows > 1"), same, "left_semi").dropDuplicates(["own_id", "own_key"])
    return single.unionByName(several).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
