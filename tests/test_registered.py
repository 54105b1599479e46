"""Every registered query against its check SQL on the smallest tables."""
import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_check_has_a_query():
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    note, ok, _ = check.compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert ok, note


PLAIN = [n for n in QUERIES if n[0] in "DEGHIM" or n.startswith(("J13", "J1_", "A17"))]


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_no_nested_loop_or_cartesian(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_the_columns_it_needs(spark):
    from ledgerwell.domain import Domain
    from ledgerwell.operators import score
    df = score.ven_breakdown(Domain.of(spark, SF).reorder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert sorted(c.split(":")[0] for c in read.split(",")) == ["needs_reorder", "ven_class"]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "remaining_qty" in df.columns
