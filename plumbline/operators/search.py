"""Exact top-k by inner product: blocks of queries meet blocks of chunks.

Queries are dealt to blocks by their id and so are chunks; each pair of blocks meets in one task as a matrix product, which
keeps the k best chunks of each query. Those of all blocks are merged by query. Each side is copied once for each block
of the other, so what is shuffled falls with the size of blocks, and the plan is the same for any number of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 5
#: Numbers of a block of queries and of a block of chunks, and scores that a task holds at a time; 8 bytes each.
BLOCK_VALUES, CHUNK_VALUES, SCORES = 4_000_000, 16_000_000, 2_000_000
#: Numbers that make a block of chunks worth a task of its own while there are fewer blocks than partitions.
LEAST_VALUES = 50_000


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """v with a length of 1; a vector of zeros stays. v and its length are computed once."""
    once = lambda value, of: F.aggregate(F.array(value), F.lit(None).cast("array<double>"), lambda _, x: of(x))
    scaled = lambda u, norm: F.transform(u, lambda x: F.when(norm > 0, x / norm).otherwise(x))
    return once(v.cast("array<double>"), lambda u: once(F.sqrt(inner_product(u, u)), lambda norm: scaled(u, norm)))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the k greatest finite scores of each row; between equal ones, the first places."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k, None]
        row, place = np.nonzero((scores >= least) & np.isfinite(scores))
    else:
        row, place = np.nonzero(np.isfinite(scores))
    order = np.lexsort((place, -scores[row, place], row))
    row, place = row[order], place[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], place[kept]


def _sized(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows that have an embedding, and how many numbers those have."""
    held = vectors.where("embedding is not null")
    n, width = held.agg(F.count("*"), F.max(F.size("embedding"))).first()
    return held, n * (width or 0)


def search(chunks: DataFrame, queries: DataFrame, k: int = TOP, leave_self: bool = False, block_values: int = BLOCK_VALUES, chunk_values: int = CHUNK_VALUES) -> DataFrame:
    """query_id, rank, id, score of the k chunks nearest to each query; ties by id.

    chunks: id, embedding; queries: query_id, embedding, a stated set against all chunks. Ids are numbers or texts and come
    once. Rows without an embedding are left out. Vectors have one length. Every chunk is scored against every query.
    """
    (held, values), (asked, asked_values) = _sized(chunks), _sized(queries)
    partitions = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = max(1, -(-asked_values // block_values))
    columns = max(1, -(-values // chunk_values), min(partitions, -(-values // LEAST_VALUES)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select("query_id", "embedding", own("query_id", rows).alias("row"), every(columns).alias("column"))
    right = held.select("id", "embedding", own("id", columns).alias("column"), every(rows).alias("row"))
    query_kind, id_kind = left.schema["query_id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()

    def run(some: pa.Table, block: pa.Table) -> pa.Table:
        block = block.sort_by("id")
        ids, query_ids = block.column("id").combine_chunks(), some.column("query_id").combine_chunks()
        found = []
        if some.num_rows and block.num_rows:
            vectors, matrix = _matrix(block.column("embedding")).T, _matrix(some.column("embedding"))
            for at in range(0, len(query_ids), max(1, SCORES // len(ids))):
                part = query_ids.slice(at, max(1, SCORES // len(ids)))
                scores = matrix[at : at + len(part)] @ vectors
                if leave_self:
                    itself = pc.index_in(part, value_set=ids)
                    same = np.flatnonzero(itself.is_valid().to_numpy(zero_copy_only=False))
                    scores[same, itself.drop_null().to_numpy()] = -np.inf
                row, place = _best(scores, k)
                found.append(pa.table({"query_id": part.take(pa.array(row)), "id": ids.take(pa.array(place)), "score": scores[row, place]}))
        return pa.concat_tables(found) if found else pa.table({"query_id": query_ids.slice(0, 0), "id": ids.slice(0, 0), "score": pa.array([], pa.float64())})

    best = left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(run, f"query_id {query_kind}, id {id_kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
