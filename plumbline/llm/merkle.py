"""Merkle manifest of a table: a tree of digests for each group of rows, and one over the groups' roots.

Rows of a group are leaves, in order; every FANOUT nodes that follow each other become their digest until one is left.
Leaves get their digest where they are read, so that texts are not shuffled; a range partition puts digests in order. Large
blocks of leaves (a power of FANOUT) are then reduced in tasks, and what is left of groups of several blocks makes the upper
tree: the driver builds it and broadcasts each block's path from there to the root. Executors finish the proofs, block by
block, and fold them row by row. Where more than about MOST_TOP nodes are left, they are leaves of the same reduction again,
and their paths are joined; the tree over the groups is made in the same way, so that rows and groups may be many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table, written

FANOUT = 3
#: Levels of the tree below a block's root: at least so many, and more on large tables, up to what a task can hold.
LEAST_LEVELS, MOST_LEVELS = 5, 9
#: Blocks up to which the upper tree is the driver's: 150 bytes and a path of some kilobytes each.
MOST_TOP = FANOUT**8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_SIBLINGS = "array<struct<before:array<string>,after:array<string>>>"
_STEP = pa.struct([("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])


def digest(values: list[Column]) -> Column:
    """SHA-256 (hex) of values: - for a null, else the number of bytes, a colon and the value."""
    said = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said]), 256)


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], most: int | None = None) -> list[list[str]]:
    """nodes, and the levels above them: exactly `most`, or until one node is left."""
    levels = [nodes]
    while (len(levels) <= most) if most is not None else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([_hash(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def _path(levels: list[list[str]], at: int) -> list[dict[str, list[str]]]:
    """The siblings of a node of the lowest level, and of the nodes above it."""
    found = []
    for nodes in levels[:-1]:
        first = at // FANOUT * FANOUT
        found.append({"before": nodes[first:at], "after": nodes[at + 1 : first + FANOUT]})
        at //= FANOUT
    return found


def _in_order(items: DataFrame) -> DataFrame:
    """items (group, key, leaf, rest) with at: their places in their group by key, then leaf, from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for g in batch.column("group").to_pylist():
                group, at = (group, at + 1) if g == group else (g, 0)
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "at"])

    order = ["group", "key", "leaf", "tie"]
    dealt = items.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    placed = written(dealt.mapInArrow(run, f"{kinds}, part int, at long"), "placed")
    # only the first group of a partition has rows in partitions before it: no more rows than partitions
    before = F.sum("n").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begun = placed.groupBy("group", "part").agg(F.count("*").alias("n")).withColumn("before", before).where("before > 0").select(F.col("group").alias("_group"), F.col("part").alias("_part"), "before")
    both = placed.join(F.broadcast(begun), F.col("group").eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part")), "left")
    return both.withColumn("at", F.col("at") + F.coalesce("before", F.lit(0))).drop("_group", "_part", "before", "part")


def _blocks(items: DataFrame, levels: int) -> DataFrame:
    """One row for each block of FANOUT ** levels leaves of a group, written: group, block, digest, and arrays of its leaves'
    key, leaf and rest."""
    size = FANOUT**levels
    own = ("key", "leaf", "rest")

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        block, n = rows.column("block")[0].as_py(), rows.num_rows
        top = _levels(rows.column("leaf").to_pylist(), _fixed(block, n, size, levels))[-1][0]
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows.column(c).combine_chunks()) for c in own]
        return pa.Table.from_arrays([rows.column("group").slice(0, 1), pa.array([block], pa.int64()), pa.array([top]), *lists], names=["group", "block", "digest", *own])

    kind = {f.name: f.dataType.simpleString() for f in items.schema}
    schema = f"group {kind['group']}, block long, digest string, key array<{kind['key']}>, leaf array<string>, rest array<string>"
    return written(items.withColumn("block", F.floor(F.col("at") / size).cast("long")).groupBy("group", "block").applyInArrow(pack, schema), "blocks")


def _fixed(block: int, n: int, size: int, levels: int) -> int | None:
    """Levels of a block: all, but for a short first one, which is its group's only one and ends where one node is left."""
    return None if block == 0 and n < size else levels


def _paths(blocks: DataFrame, least_levels: int, most_levels: int, most_top: int) -> DataFrame:
    """_group, _block, path to the root of the group, and that root, of groups of several blocks.

    Up to twice most_top blocks: by the driver, broadcast. More: by the reduction that made them.
    """
    spark, kind = blocks.sparkSession, blocks.schema["group"].dataType.simpleString()
    many = blocks.where("block > 0").select(F.col("group").alias("_many")).distinct()
    several = blocks.join(many, F.col("group").eqNullSafe(F.col("_many")), "left_semi").select("group", "block", "digest")
    if several.count() > 2 * most_top:
        above = several.select("group", F.col("block").alias("key"), F.col("digest").alias("leaf"), F.lit(None).cast("string").alias("rest"))
        rows, _ = trees(above, least_levels, most_levels, most_top)
        return rows.select(F.col("group").alias("_group"), F.col("key").alias("_block"), F.col("siblings").alias("path"), "top")
    made = []
    for r in several.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("block", "digest"))).alias("blocks")).collect():
        levels = _levels([b["digest"] for b in r["blocks"]])
        made += [(r["group"], k, [(s["before"], s["after"]) for s in _path(levels, k)], levels[-1][0]) for k in range(len(levels[0]))]
    return F.broadcast(spark.createDataFrame(made, f"_group {kind}, _block long, path {_SIBLINGS}, top string"))


def trees(items: DataFrame, least_levels: int = LEAST_LEVELS, most_levels: int = MOST_LEVELS, most_top: int = MOST_TOP) -> tuple[DataFrame, DataFrame]:
    """(group, key, leaf, rest, siblings, top) of each of items (group, key, leaf, rest), and (group, top) of each group."""
    n, levels = items.count(), least_levels
    while n > most_top * FANOUT**levels and levels < most_levels:
        levels += 1
    size = FANOUT**levels
    blocks = _blocks(_in_order(items), levels)
    joined = blocks.join(_paths(blocks, least_levels, most_levels, most_top), F.col("group").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block")), "left").withColumns({"top": F.coalesce("top", "digest"), "path": F.coalesce("path", F.array().cast(_SIBLINGS))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                leaves, path = row.column("leaf")[0].as_py(), row.column("path")[0].as_py()
                n = len(leaves)
                below = _levels(leaves, _fixed(row.column("block")[0].as_py(), n, size, levels))
                siblings = pa.array([_path(below, k) + path for k in range(n)], pa.list_(_STEP))
                same = [row.column(c).take(pa.array(np.zeros(n, np.int64))) for c in ("group", "top")]
                yield pa.RecordBatch.from_arrays([same[0], *[row.column(c)[0].values for c in ("key", "leaf", "rest")], siblings, same[1]], names=["group", "key", "leaf", "rest", "siblings", "top"])

    kind = {f.name: f.dataType.simpleString() for f in items.schema}
    rows = joined.select("group", "block", "key", "leaf", "rest", "path", "top").mapInArrow(run, f"group {kind['group']}, key {kind['key']}, leaf string, rest string, siblings {_SIBLINGS}, top string")
    return rows, joined.where("block = 0").select("group", "top")


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings come to."""
    joined = lambda x: F.array_join(x, "")
    return F.aggregate(siblings, leaf, lambda h, s: F.sha2(F.concat(joined(s["before"]), h, joined(s["after"])), 256))


def manifest(docs: DataFrame, changed: Column | None = None, columns: tuple[str, ...] = COLUMNS, group: str = "source", key: str = "doc_id", least_levels: int = LEAST_LEVELS, most_levels: int = MOST_LEVELS, most_top: int = MOST_TOP) -> DataFrame:
    """doc_id (key), leaf, changed_leaf, subroot, root and siblings (from the leaf's level to the root's) of each row of docs.

    leaf is the digest of columns, subroot the root of the row's group, root that over the groups in the order of their
    values, null first. changed: what stands for the text in changed_leaf, to hold a changed table against the manifest.
    Null values count as they are, apart from empty ones; a null group is one. Texts are read whole, however long. Rows with
    equal keys follow each other by leaf, and equal rows in any order, as they have equal leaves. An empty table gives an
    empty result. Other columns are not read; no name can clash.
    """
    values = [F.col(c) for c in columns]
    other = [changed if c == "text" and changed is not None else F.col(c) for c in columns]
    leaves = docs.select(F.col(group).cast("string").alias("group"), F.col(key).alias("key"), digest(values).alias("leaf"), digest(other).alias("rest"))
    rows, groups = trees(written(leaves, "leaves"), least_levels, most_levels, most_top)
    tops = groups.select(F.lit(0).alias("group"), F.col("group").alias("key"), F.col("top").alias("leaf"), F.lit(None).cast("string").alias("rest"))
    over, _ = trees(tops, least_levels, most_levels, most_top)
    over = over.select(F.col("key").alias("_key"), F.col("siblings").alias("_over"), F.col("top").alias("root"))
    # groups within the bound are broadcast; more of them are joined by their value
    over = F.broadcast(over) if tops.count() <= most_top else over
    joined = rows.join(over, F.col("group").eqNullSafe(F.col("_key")))
    return joined.select(F.col("key").alias(key), "leaf", F.col("rest").alias("changed_leaf"), F.col("top").alias("subroot"), "root", F.concat("siblings", "_over").alias("siblings"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    m = manifest(table(spark, sf_dir, "documents"), tampered)
    said = F.array_join(F.flatten(F.transform("siblings", lambda s: F.concat(s["before"], s["after"]))), "")
    whole = m.select("doc_id", "leaf", "subroot", "root", F.sha2(said, 256).alias("proof_sha256"), folded(F.col("changed_leaf"), F.col("siblings")).alias("folded_root"))
    return whole.withColumn("verified", F.col("folded_root") == F.col("root"))
