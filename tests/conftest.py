"""One Spark session for all tests, and the driver's tables in DuckDB."""

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, str(ROOT))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    tmp = tempfile.mkdtemp()
    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": f"{tmp}/warehouse", "spark.checkpoint.dir": f"file://{tmp}/shared"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sql():
    """A function that runs DuckDB SQL over the driver's tables: sorted rows by sorted column names."""
    import duckdb

    for t in TABLES:
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")

    def run(text):
        rel = duckdb.sql(text)
        return in_order(rel.columns, rel.fetchall())

    return run


def in_order(columns, rows):
    """Columns by name, rows sorted, floats rounded: comparable."""
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda x: round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return [columns[k] for k in at], sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


@pytest.fixture(scope="session")
def rows_of():
    return lambda df: in_order(df.columns, [tuple(r) for r in df.collect()])
