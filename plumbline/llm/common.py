"""What the training-data operators share: input shape and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z only; Spark's lower() would also fold other scripts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_folder: dict[str, str] = {}


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and the named columns; whatever else the table has cannot clash."""
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"), *more)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a whole text: half of its SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one in local mode."""
    app = spark.sparkContext.applicationId
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_folder.setdefault(app, tempfile.mkdtemp(prefix="plumbline-"))
    return f"{base.rstrip('/')}/{app}"


def written(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """df, written to the shared folder and read back: a lineage cut that outlives lost executors. parts: columns of folders."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: list[str] = []


def kept_table(df: DataFrame, name: str, key: str, buckets: int, *parts: str) -> DataFrame:
    """df, written to the shared folder as a table that is bucketed by key, and read back. parts: columns of folders."""
    full = f"plumbline_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession)}/{full}"
    df.write.partitionBy(*parts).bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(full)
    _kept.append(full)
    return df.sparkSession.table(full)


def drop_written(spark: SparkSession) -> None:
    """Drops what written() and kept_table() left in this session; results not read yet can't be read afterwards."""
    while _kept:
        spark.sql(f"drop table if exists {_kept.pop()}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch that a task takes at a time.
ROWS = 500
_ARROW = {"long": "int64", "int": "int32", "string": "string", "boolean": "bool", "double": "float64", "binary": "binary"}


def map_texts(docs: DataFrame, start: Callable[[], Callable[[list], list]], schema: dict[str, str], columns: tuple[str, ...] = ("doc_id",), text: str = "text", rows: int = ROWS) -> DataFrame:
    """The given columns of docs, as they are, and those that Python makes of the texts, partition by partition.

    start() is called once in each task and returns what makes the columns of schema from a list of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = [pa.array(x, kinds[c]) for c, x in zip(schema, make(part.column(text).to_pylist()), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *made], names=[*columns, *schema])

    kinds = {c: arrow_type(t) for c, t in schema.items()}
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(run, ", ".join([*kept, *[f"`{c}` {t}" for c, t in schema.items()]]))


def arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("array<struct<"):
        return pa.list_(pa.struct([(n, arrow_type(t)) for n, t in (x.split(":") for x in kind[13:-2].split(","))]))
    return pa.list_(arrow_type(kind[6:-1])) if kind.startswith("array<") else getattr(pa, _ARROW[kind].replace("bool", "bool_"))()
