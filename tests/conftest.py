"""Shared fixtures: one local session, and the queries' comparison with their SQL twins."""

from __future__ import annotations

import math
import os
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


def plain(v):
    """A value as it is compared: floats rounded, rows and arrays as tuples."""
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def differences(df, sql: str, sf_dir: str, views: dict | None = None) -> list:
    """Rows that only one of a query and its SQL twin has."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir) if sf_dir else ():
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    for name, pdf in (views or {}).items():
        con.register(name, pdf)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    got = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    want = Counter(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in rel.fetchall())
    return [*(("spark", x) for x in got - want), *(("sql", x) for x in want - got)]
