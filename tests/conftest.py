import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql.types import IntegralType

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in DATA.iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck):
    """Checks that a query and its SQL give the same rows."""

    def rows(frame):
        frame = frame[sorted(frame.columns)].astype(object)
        return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))

    def check(query, sql, folder=str(DATA)):
        found = query(spark, folder)
        got, want = found.toPandas(), duck.sql(sql).df()
        # pandas turns whole numbers among nulls into floats; both sides have them as Int64
        for name in [f.name for f in found.schema if isinstance(f.dataType, IntegralType)]:
            got[name], want[name] = got[name].astype("Int64"), want[name].astype("Int64")
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return check
