"""Sharding: minimax contiguous partition of ordered atomic groups.

A group is all rows of one text; its size is the UTF-8 bytes plus 8 of each of its rows. Groups are ordered by a hash of
the text, and each shard takes a contiguous run of them. The smallest capacity for which greedy filling needs no more
than the wanted number of shards is found by binary search, and the cuts are those that the greedy filling makes.

The driver never sees the groups. It sees sums over aligned ranges of hashes, a bounded number of them at a time:
with only some group boundaries known, greedy filling over those gives a capacity that suffices, and greedy filling
that may cut anywhere inside a range of several groups gives one that is needed. Ranges in which the two disagree about
a cut are summed again, more finely, until both capacities are the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import id_and_text, table, written

SHARDS = 24
#: Ranges that the driver asks for at first, and into how many it has each unsettled range divided: powers of two.
FIRST_BITS, MORE_BITS = 12, 5
#: Shares of a shard that get their slots apart: so many at least, and one for so many rows of the table.
SLOT_SHARES, SHARE_ROWS = 64, 1_000_000


def _cuts(ends: np.ndarray, whole: np.ndarray, capacity: int, shards: int, loose: bool) -> list[int] | None:
    """Where greedy filling ends each shard, in bytes; None if the shards don't suffice.

    ends: known boundaries, ascending; whole[i]: no boundary is hidden before ends[i]. loose: cut anywhere within
    ranges that may hide boundaries.
    """
    at, found = 0, []
    for _ in range(shards):
        if at >= ends[-1]:
            found.append(int(ends[-1]))
            continue
        i = int(np.searchsorted(ends, at + capacity, side="right"))
        to = int(ends[i - 1]) if i else 0
        if loose and i < len(ends) and not whole[i]:
            to = at + capacity
        if to <= at:
            return None
        found.append(to)
        at = to
    return found if at >= ends[-1] else None


def _least(ends: np.ndarray, whole: np.ndarray, low: int, shards: int, loose: bool) -> int:
    """Smallest capacity, low at least, with which greedy filling makes do."""
    high = max(low, int(ends[-1]))
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _cuts(ends, whole, mid, shards, loose) is not None else (mid + 1, high)
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """groups: spot (a long, each value one group), bytes. The last spot of each shard but the last, ascending.

    An empty table has its cuts at the lowest spot. A shard that gets nothing ends where the one before ends.
    """
    spots = groups.select((F.col("spot").bitwiseXOR(F.lit(-(2**63)))).alias("u"), "bytes")  # unsigned order

    def summed(bits: int, within: list[int], coarse: int) -> list:
        inside = spots if not coarse else spots.where(F.shiftrightunsigned("u", 64 - coarse).isin(within))
        return [
            (r["u"], r["n"], r["bytes"], r["most"])
            for r in inside.groupBy(F.shiftrightunsigned("u", 64 - bits).alias("u")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("most")).collect()
        ]

    # a known range: first spot (unsigned, 64 bits) -> width in bits, groups, bytes
    known = {u << (64 - FIRST_BITS): (FIRST_BITS, n, b, m) for u, n, b, m in summed(FIRST_BITS, [], 0)}
    if not known:
        return [-(2**63)] * (shards - 1)
    low = max(m for _, _, _, m in known.values())
    while True:
        order = sorted(known)
        ends = np.cumsum([known[u][2] for u in order])
        whole = np.array([known[u][1] == 1 for u in order])
        low = _least(ends, whole, low, shards, loose=True)
        high = _least(ends, whole, low, shards, loose=False)
        if low == high:
            cuts = _cuts(ends, whole, high, shards, loose=False)
            last = [order[int(np.searchsorted(ends, c))] for c in cuts[:-1]]
            # the cut is after the whole range: its greatest spot
            return [(u + (1 << (64 - known[u][0])) - 1) - 2**63 for u in last]
        near = set()
        for c in (low, high):
            for loose in (True, False):
                for to in _cuts(ends, whole, c, shards, loose) or []:
                    near |= {min(int(np.searchsorted(ends, to)) + k, len(order) - 1) for k in (0, 1)}
        for a, b in zip(_cuts(ends, whole, low, shards, True), _cuts(ends, whole, high, shards, False), strict=True):
            near |= set(range(int(np.searchsorted(ends, min(a, b))), min(int(np.searchsorted(ends, max(a, b))) + 1, len(order))))
        split = {order[i]: known[order[i]][0] for i in sorted(near) if not whole[i]}
        for bits in set(split.values()):
            finer, coarse = min(64, bits + MORE_BITS), [u for u, b in split.items() if b == bits]
            for u in coarse:
                known.pop(u)
            for u, n, b, m in summed(finer, [u >> (64 - bits) for u in coarse], bits):
                known[u % 2**64 << (64 - finer)] = (finer, n, b, m)


def shard_of(spot: Column, cuts: list[int]) -> Column:
    return sum(((spot > F.lit(c)).cast("int") for c in cuts), F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, shares: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row: law ``bytes``, sizes near equal.

    Rows with equal texts are one group and stay together; so do texts with the same 64-bit hash. Null texts count as
    empty. slot numbers the rows of a shard from 0 without gaps, by share (a hash of doc_id and text), then doc_id;
    repeated rows each get one. Null doc_ids are rows like others. More shards than groups leave shards empty. Texts are
    taken whole, however long: of one that is larger than a shard should be, the shard is that large. An empty table gives an
    empty result. Other columns are not read.
    """
    shares = shares or max(SLOT_SHARES, docs.count() // SHARE_ROWS)
    rows = written(
        id_and_text(docs).select(
            "doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("spot"), F.pmod(F.xxhash64("text", "doc_id"), F.lit(shares)).cast("int").alias("share")
        ),
        "shard-rows",
    )
    groups = written(rows.groupBy("spot").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = rows.withColumn("shard", shard_of(F.col("spot"), minimax_cuts(groups, shards)))
    # at most shards * shares rows of 24 bytes
    before = placed.groupBy("shard", "share").count().withColumn("first", F.sum("count").over(Window.partitionBy("shard").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)))
    starts = before.select("shard", "share", F.coalesce("first", F.lit(0)).alias("first"))
    slot = F.row_number().over(Window.partitionBy("shard", "share").orderBy("doc_id", "spot"))
    return placed.join(F.broadcast(starts), ["shard", "share"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + slot - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
