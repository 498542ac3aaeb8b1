import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def agree(spark, sf):
    """Whether a query and its SQL give the same rows over the smallest tables."""
    import duckdb

    def compare(query, sql):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for path in Path(sf).iterdir():
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
        found = query(spark, sf)
        names = sorted(found.columns)
        result = con.execute(sql)
        order = [d[0] for d in result.description]
        assert sorted(order) == names
        wanted = [tuple(row[order.index(n)] for n in names) for row in result.fetchall()]
        rows = [tuple(r) for r in found.select(names).collect()]
        assert sorted(map(repr, rows)) == sorted(map(repr, wanted))
        return rows

    return compare
