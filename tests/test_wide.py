import pytest

from ledgerwell.sources.wide import WideRead, read_columns


@pytest.fixture
def wide(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(5).selectExpr(*[f"id + {i} AS c{i}" for i in range(9)], "id AS `a.b`").write.parquet(path)
    return path


def test_scan_reads_the_declared_columns(spark, wide):
    df = read_columns(spark, wide, ["c3", "a.b"])
    assert df.columns == ["c3", "a.b"] and sorted(r[0] for r in df.collect()) == [3, 4, 5, 6, 7]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c3:bigint,a.b:bigint>" in plan


@pytest.mark.parametrize("columns", [None, [], ["*"], ["c1", "*"], ["c1", "none"], ["c1", "c1"],
                                     [f"c{i}" for i in range(9)] + ["a.b"]])
def test_wide_reads_are_refused(spark, wide, columns):
    with pytest.raises(WideRead):
        read_columns(spark, wide, columns)


def test_narrow_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "narrow")
    spark.range(0).selectExpr("id AS a", "id AS b").write.parquet(path)
    assert read_columns(spark, path).columns == ["a", "b"]
    assert read_columns(spark, path, ["b"]).collect() == []
