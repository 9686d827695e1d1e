import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(names, values):
    """Rows as sorted tuples in the order of the sorted names; values as text so that nulls sort."""
    order = [names.index(n) for n in sorted(names)]
    return sorted(tuple(repr(v[i]) for i in order) for v in values)


@pytest.fixture(scope="session")
def compare(spark, duck):
    def check(query, sql):
        df = query(spark, SF)
        found = duck.sql(sql)
        assert sorted(df.columns) == sorted(found.columns)
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        assert got == rows(found.columns, found.fetchall())

    return check
