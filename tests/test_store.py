"""The stored ledger: what it reads, what it shuffles, and stock in place against stock by cells."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerwell import domain
from ledgerwell.domain import Domain, buckets_for
from ledgerwell.operators import stock
from ledgerwell.operators.plan import training_set
from ledgerwell.plans.ordered import range_cell
from ledgerwell.sources import store as st
from ledgerwell.sources.store import LedgerStore, published
from tests.test_stock import ledger

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def events(spark, n=400, hot=False, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pair = ("F0", "M0") if hot and i % 3 else (f"F{rng.randrange(5)}", f"M{rng.randrange(4)}")
        kind = rng.choice(["received", "received", "dispensed", "expired", "lost", "dispatched", "count"])
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(90))
        rows.append((f"E{rng.randrange(10**6):06d}-{i}", *pair, kind, rng.randrange(1, 30), day, rng.choice([None, day + dt.timedelta(days=rng.randrange(5))])))
    return ledger(spark, rows).withColumn("resource_type", F.lit("medicine"))


def bag(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("period", ["day", "month"])
def test_types_and_days_are_partition_filters(spark, tmp_path, period):
    s = LedgerStore(spark, str(tmp_path / "l"), buckets=4, period=period)
    both = events(spark).unionByName(events(spark, 50, seed=4).withColumn("resource_type", F.lit("bed")))
    s.append(both)
    few = s.read("bed", days=("2024-01-10", "2024-02-03"))
    assert "PartitionFilters: [" in plan(few) and "event_period" in plan(few).split("PartitionFilters: [")[1].split("]")[0]
    want = both.filter("resource_type = 'bed'").filter(F.to_date("event_ts").between("2024-01-10", "2024-02-03"))
    assert bag(few.select(sorted(few.columns))) == bag(want.select(sorted(want.columns)))
    assert len(few.inputFiles()) < len(s.read("bed").inputFiles()) < len(s.read().inputFiles())
    last = s.last_day("bed")
    assert last.first()[0] == both.filter("resource_type = 'bed'").agg(F.max(F.to_date("event_ts"))).first()[0]
    assert s.read("nothing").count() == 0 and s.last_day("nothing").first()[0] is None


def test_stock_is_shuffle_free_in_buckets(spark, tmp_path):
    s = LedgerStore(spark, str(tmp_path / "l"), buckets=4, period="month")
    led = events(spark)
    s.append(led)
    rows = s.read("medicine")
    for df in (stock.consumed(rows), stock.current_stock(rows, F.lit(dt.date(2024, 4, 1)), colocated=True)):
        assert "Exchange" not in plan(df) and plan(df).count("FileScan") == 1
    assert bag(stock.consumed(rows)) == bag(stock.consumed(led))
    assert bag(stock.current_stock(rows, colocated=True)) == bag(stock.current_stock(led))


@pytest.mark.parametrize("hot", [False, True])
def test_stock_in_place_and_by_cells(spark, hot):
    led = events(spark, 600, hot)
    assert bag(stock.current_stock(led, colocated=True)) == bag(stock.current_stock(led))


def test_rows_come_later_and_in_another_session(spark, tmp_path):
    s = LedgerStore(spark, str(tmp_path / "l"), buckets=4, period="month")
    first, more = events(spark), events(spark, 100, seed=9)
    s.append(first)
    before = s.last_day("medicine").first()[0]
    s.append(more.select(*reversed(more.columns)))
    spark.sql(f"DROP TABLE {s.table}")                                     # a catalog that does not know it
    again = LedgerStore(spark, str(tmp_path / "l"), buckets=4, period="month")
    rows = again.read("medicine")
    assert rows.count() == 500 and "Exchange" not in plan(stock.consumed(rows))
    assert bag(stock.current_stock(rows, colocated=again.is_even())) == bag(stock.current_stock(first.unionByName(more)))
    assert again.last_day("medicine").first()[0] >= before


def test_a_hot_pair_is_read_without_buckets(spark, tmp_path, monkeypatch):
    s = LedgerStore(spark, str(tmp_path / "l"), buckets=16, period="month")
    led = events(spark, 2000, hot=True)
    s.append(led)
    monkeypatch.setattr(st, "SMALL", 0)
    monkeypatch.setattr(st, "UNEVEN", 2)
    assert not s.is_even()
    rows = s.read("medicine")
    assert "Bucketed: true" not in plan(rows) and "PartitionFilters: [" in plan(rows)
    assert bag(stock.current_stock(rows, colocated=s.is_even())) == bag(stock.current_stock(led))


def test_only_whole_tables_are_opened(spark, tmp_path):
    path, calls = str(tmp_path / "l"), []

    def rows():
        calls.append(1)
        return events(spark)
    for _ in range(2):
        s = published(LedgerStore(spark, path, 4, "month"), rows)
        assert s.read().count() == 400
    assert len(calls) == 1 and [p.name for p in tmp_path.iterdir()] == ["l"]


def test_registered_stock_reads_the_store(spark):
    d = Domain.of(spark, SF)
    for df in (stock.consumed(d.ledger), d.live_stock):
        text = plan(df)
        assert "PartitionFilters: [" in text and "resource_type" in text
    assert "Exchange" not in plan(stock.consumed(d.ledger))
    assert "Exchange" not in plan(stock.current_stock(d.ledger, F.lit(dt.date(2024, 4, 1)), colocated=True))


@pytest.mark.parametrize("ids", ["E{:06d}", "{:032x}", "https://host/very/long/prefix/{:09d}"])
def test_ranges_of_ids_are_even(spark, ids):
    df = spark.createDataFrame([(ids.format(i * i),) for i in range(20_000)] + [(None,)], "id string")
    sizes = [r["count"] for r in df.groupBy(range_cell(df, "id").alias("c")).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 20_000 / 64
    ordered = df.filter("id IS NOT NULL").withColumn("c", range_cell(df, "id")).orderBy("id").collect()
    assert [r.c for r in ordered] == sorted(r.c for r in ordered)


def test_ranges_of_few_values(spark):
    one = spark.createDataFrame([("a",)] * 5 + [("b",)], "id string")
    assert {(r.id, r.c) for r in one.withColumn("c", range_cell(one, "id")).collect()} <= {("a", 0), ("a", 1), ("b", 1), ("b", 2)}
    assert one.limit(0).withColumn("c", range_cell(one.limit(0), "id")).collect() == []


def test_buckets_grow_with_the_rows():
    assert [buckets_for(n) for n in (0, 600_000, 36_000_000, 216_000_000)] == [8, 8, 90, 540]


def test_stored_ledger_of_a_larger_table_has_more_buckets(spark, tmp_path, monkeypatch):
    rows = [(i, i % 7, i % 5, 1 + i % 7, 5.0, 10.0, 0.0, 0.0, "NRA"[i % 3], "O", dt.datetime(1995, 1, 1 + i % 28)) for i in range(300)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"Brand#1{i}") for i in range(7)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(domain, "ROWS_PER_BUCKET", 20)
    d = Domain(spark, str(tmp_path))
    assert d.store.buckets == 15 and d.ledger.count() == 300 and "Exchange" not in plan(stock.consumed(d.ledger))
    assert len(d.store.bucket_bytes()) > 8 and d.store.bucket_bytes() is d.store.bucket_bytes()


def test_training_set_reads_the_ledger_once(spark, tmp_path):
    s = LedgerStore(spark, str(tmp_path / "l"), buckets=4, period="month")
    s.append(events(spark))
    fac = spark.createDataFrame([(f"F{i}", True) for i in range(5)], "facility_id string, is_forecast_facility boolean")
    df = training_set(s.read("medicine"), fac, 5)
    assert plan(df).count("FileScan parquet") == 1
    led = [r for r in s.read("medicine").collect()]
    days = {}
    for r in led:
        days.setdefault((r.facility_id, r.item_id), {}).setdefault(r.event_ts.date(), []).append(r)
    want = sorted((*k, day, sum(r.quantity for r in rs if r.event_type == "dispensed")) for k, by in days.items() if len(by) >= 5
                  for day, rs in by.items() if any(r.event_type == "dispensed" for r in rs))
    assert want and sorted(map(tuple, df.collect())) == want
