"""One small Spark session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import math
import os
import sys
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_plain, value)) + "]"
    return str(value)


def rows_of(columns, rows) -> Counter:
    """The rows as a multiset, columns in the order of their names."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def duck_rows(sql: str, data: str = DATA):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 2")
    for t in TABLES:
        if Path(f"{data}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    return columns, got.fetchall()


def assert_same(frame, sql: str, data: str = DATA):
    """The query's rows and column names are those of the SQL."""
    columns, wanted = duck_rows(sql, data)
    assert sorted(frame.columns) == sorted(columns)
    have, want = rows_of(frame.columns, frame.collect()), rows_of(columns, wanted)
    assert have == want, f"only here: {list((have - want).items())[:3]}; only there: {list((want - have).items())[:3]}"
    return len(wanted)
