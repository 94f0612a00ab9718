"""Every registered grid query against its SQL."""

import pytest

from cellgrove.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sql, rows_of):
    assert rows_of(QUERIES[name](spark, DATA)) == sql(ORACLE_SQL[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["outside_cells", "enclosed_filled", "beside_empty", "components_26", "grown_layers", "inherited_ids"])
def test_empty_table_gives_no_cells(name, spark, tmp_path):
    spark.read.parquet(f"{DATA}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_strips_lie_side_by_side(spark, tmp_path):
    """Cells of orders beyond one strip stay apart from those of the first."""
    from cellgrove.plans import derived

    far = derived.ORDERS * derived.ACROSS
    rows = [(1.0, 3, 0, 1), (1.0, 3, far, 1), (50.0, 19, far + derived.ORDERS, 2)]
    spark.createDataFrame(rows, "l_quantity double, l_suppkey long, l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, derived.cells(spark, str(tmp_path)).collect())) == [(0, 3, 0), (0, 23, 0), (9, 39, 1)]
