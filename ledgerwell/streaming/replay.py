"""Registered stream queries: the given tables arrive in two instalments.

Between the instalments the stream is stopped and started again from its checkpoint, so
state and sinks are exercised across a restart.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import Domain
from ..operators import stock
from ..operators.stock import PAIR
from ..plans.snapshot import application_folder, snapshot
from . import ledger as live


def _folder(d: Domain, name: str) -> str:
    """A folder for one replay, gone with the application's other written tables."""
    return f"{application_folder(d.spark)}/streams/{name}-{uuid.uuid4().hex[:12]}"


def instalments(df: DataFrame, at: str) -> list[DataFrame]:
    """Rows up to the middle of the covered time, and the rest."""
    mid = df.agg(F.timestamp_seconds((F.unix_timestamp(F.min(at).cast("timestamp"))
                                      + F.unix_timestamp(F.max(at).cast("timestamp"))) / 2)
                 .cast("timestamp_ntz").alias("m")).scalar()
    return [df.filter(F.col(at) <= mid), df.filter(F.col(at) > mid)]


def arrive(d: Domain, df: DataFrame, at: str, name: str, start) -> str:
    base = _folder(d, name)
    schema = df.schema
    for part in instalments(df, at):
        part.write.mode("append").parquet(f"{base}/in")
        start(live.stream_of(d.spark, f"{base}/in", schema), f"{base}/checkpoint", f"{base}/out")
    return f"{base}/out"


def captures_to_ledger(d: Domain, which: str) -> DataFrame:
    out = arrive(d, d.replies, "event_ts", "k1",
                 lambda s, ck, to: live.ingest_captures(s, d.items, to, ck))
    return d.spark.read.parquet(f"{out}/{which}").drop("batch")


def movements(d: Domain) -> DataFrame:
    rows = d.requests.filter("step IN ('dispatched', 'received')").select(
        F.concat_ws(":", "recommendation_id", "step").alias("event_id"), F.col("ts").cast("timestamp").alias("event_ts"))

    seen = live.seen_keys(d.spark, _folder(d, "k2-keys"), "event_id")

    def start(s, ck, to):
        live.run_available(live.movements_once(s, "60 days").select("event_id"), ck,
                           lambda b, i: live.write_new(b, to, i, "event_id", seen))
    return d.spark.read.parquet(arrive(d, rows, "event_ts", "k2", start)).drop("batch")


def overdraws(d: Domain) -> DataFrame:
    rows = d.gate.filter("route = 'events'").select("event_id", "facility_id", "item_id", "event_type",
                                                    "quantity", "seq", "event_ts", "resource_type")
    opening = snapshot(stock.ledger_balance(d.ledger), "k3-opening")
    kept = live.balances(d.spark, _folder(d, "k3-balances"))

    def start(s, ck, to):
        live.run_available(s, ck, lambda b, i: live.hold_overdraws(b, i, opening, kept, to))
    return d.spark.read.parquet(arrive(d, rows, "event_ts", "k3", start)).drop("batch", "resource_type")


def transfers(d: Domain) -> DataFrame:
    kept = live.transfer_states(d.spark, _folder(d, "k4-states"))

    def start(s, ck, to):
        live.run_available(s, ck, lambda b, i: live.advance_transfers(b, i, kept, to))
    return d.spark.read.parquet(arrive(d, d.requests, "ts", "k4", start)).drop("batch")


def _timed(d: Domain) -> DataFrame:
    return d.captures.select("facility_id", "resource_type", "event_type", F.col("event_ts").cast("timestamp").alias("event_ts"))


def rolling(d: Domain) -> DataFrame:
    def start(s, ck, to):
        live.run_available(live.rolling_reports(s), ck, live.keep_latest(to), "update")
    out = arrive(d, _timed(d), "event_ts", "k5", start)
    rows = live.latest(d.spark, out, ["window_start", "resource_type"], "reports")
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def periods(d: Domain) -> DataFrame:
    def start(s, ck, to):
        live.run_available(live.reporting_periods(s, "2 days"), ck, live.keep_latest(to), "update")
    out = arrive(d, _timed(d), "event_ts", "k6", start)
    rows = live.latest(d.spark, out, ["window_start", "facility_id"], "reports")
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def positions(d: Domain) -> DataFrame:
    rows = d.ledger.select("event_id", "facility_id", "item_id", "event_type", "quantity", "event_ts", "expiry_date")
    books, kept = _folder(d, "k7-ledger"), live.live_cells(d.spark, _folder(d, "k7-cells"))

    def start(s, ck, to):
        live.refresh_positions(s, books, kept, to, ck, d.baseline, d.facilities, d.items)
    arrive(d, rows, "event_ts", "k7", start)
    return live.live_lines(kept, d.baseline, d.facilities, d.items).select(*PAIR, "on_hand", "days_of_cover", "needs_reorder", "status")


def alerts(d: Domain) -> DataFrame:
    """What the batches wrote: the last line of every pair that was touched."""
    rows = d.ledger.select("event_id", "facility_id", "item_id", "event_type", "quantity", "event_ts", "expiry_date")
    books, kept = _folder(d, "k7-ledger"), live.live_cells(d.spark, _folder(d, "k7-cells"))

    def start(s, ck, to):
        live.refresh_positions(s, books, kept, to, ck, d.baseline, d.facilities, d.items)
    out = d.spark.read.parquet(arrive(d, rows, "event_ts", "k7", start))
    row = F.struct("on_hand", "days_of_cover", "needs_reorder", "status")
    return out.groupBy(*PAIR).agg(F.max_by(row, "batch").alias("r")).select(*PAIR, "r.*")
