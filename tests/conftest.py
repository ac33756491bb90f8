import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ["PYSPARK_PYTHON"] = sys.executable
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return int(value) if isinstance(value, int) and not isinstance(value, bool) else value


def rows_of(frame, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in frame), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Holds a query against SQL over the same tables: names of columns, and rows in any order."""

    def hold(query, sql, sf_dir=SMALL):
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        wanted = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
        df = query(spark, sf_dir)
        assert sorted(df.columns) == sorted(names)
        assert rows_of(df.collect(), sorted(names)) == rows_of(wanted, sorted(names))

    return hold
