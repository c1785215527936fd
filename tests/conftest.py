import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    connection = duckdb.connect()
    for name in sorted(os.listdir(sf)):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return connection


def plain(value):
    """A value in a form that both engines share."""
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame.select(*[f"`{c}`" for c in columns]).collect())


def rows_of_sql(connection, sql):
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(plain(r[k]) for k in order) for r in result.fetchall())
