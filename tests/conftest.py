"""A local session and the driver's tables in DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def normal(rows, columns):
    """Rows as a sorted list of tuples in order of column names, with floats rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(float(v), 5) if isinstance(v, float) else int(v) if hasattr(v, "as_integer_ratio") and not isinstance(v, (bool, float)) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, sf_dir):
    def check(query, sql):
        df = query(spark, sf_dir)
        got = normal([tuple(r) for r in df.collect()], df.columns)
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        want = normal(cursor.fetchall(), names)
        assert sorted(df.columns) == sorted(names)
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert a == b

    return check
