"""Stock position from the ledger."""
from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import nvl0, ratio, rnd
from ..plans.ordered import add_running, range_cell
from ..schema import CONSUMING_TYPES

PAIR = ["facility_id", "item_id"]
LAST_DAY = datetime.date(9999, 12, 31)


def event_day() -> Column:
    return F.to_date("event_ts")


def as_of_date(ledger: DataFrame, resource_type: str | None = None) -> DataFrame:
    """The ledger's own last day (of one resource type, when named)."""
    if resource_type:
        ledger = ledger.filter(F.col("resource_type") == resource_type)
    return ledger.agg(F.max(event_day()).alias("today"))


def _units(kind: str) -> Column:
    return F.sum(F.when(F.col("event_type") == kind, F.col("quantity")).otherwise(0))


def consumed(ledger: DataFrame) -> DataFrame:
    return (ledger.filter(F.col("event_type").isin(*CONSUMING_TYPES))
            .groupBy(*PAIR).agg(
                _units("dispensed").alias("total_dispensed"),
                _units("expired").alias("total_expired"),
                _units("dispatched").alias("total_dispatched"),
                F.sum("quantity").alias("total_consumed")))


def lot() -> Column:
    """Order of receipts on the shelf: by expiry, undated ones last."""
    return F.coalesce("expiry_date", F.lit(LAST_DAY))


def position_cells(ledger: DataFrame, part: Column | None = None) -> DataFrame:
    """(pair, lot, part, received, consumed, last_day) in one pass: receipts by expiry and range of
    ids, all other rows of a pair in one without a lot."""
    received = F.col("event_type") == "received"
    used = F.when(F.col("event_type").isin(*CONSUMING_TYPES), F.col("quantity"))
    part = F.lit(0) if part is None else part
    return (ledger.groupBy(*PAIR, F.when(received, lot()).alias("lot"), F.when(received, part).alias("part"))
            .agg(F.sum(F.when(received, F.col("quantity"))).alias("received"), F.sum(used).alias("consumed"),
                 F.max(event_day()).alias("last_day")))


def add_cells(cells: DataFrame, more: DataFrame) -> DataFrame:
    """Two sets of cells as one: what ``position_cells`` gives for all their events."""
    return cells.unionByName(more).groupBy(*PAIR, "lot", "part").agg(
        F.sum("received").alias("received"), F.sum("consumed").alias("consumed"), F.max("last_day").alias("last_day"))


def on_hand(cells: DataFrame, today: Column) -> DataFrame:
    """(pair, on_hand, soonest_expiry, days_to_soonest_expiry) of the pairs with stock, from cells."""
    left = F.least(F.col("received"), F.col("upto") - F.col("total_consumed"))
    soonest = F.min(F.when(F.col("lot") < F.lit(LAST_DAY), F.col("lot")))
    return cells_on_shelf(cells).groupBy(*PAIR).agg(
        F.sum(left).alias("on_hand"), soonest.alias("soonest_expiry"), F.datediff(soonest, F.max(today)).alias("days_to_soonest_expiry"))


def cells_on_shelf(cells: DataFrame) -> DataFrame:
    """Cells of receipts that consumption, first expiry first out, has not used up: what the pair
    received in earlier cells (``before``) and consumed in all."""
    pair = Window.partitionBy(*PAIR)
    order = pair.orderBy("lot", "part").rowsBetween(Window.unboundedPreceding, 0)
    return (cells.withColumn("total_consumed", nvl0(F.sum("consumed").over(pair)))
            .withColumn("upto", nvl0(F.sum("received").over(order)))
            .filter(F.col("lot").isNotNull() & (F.col("upto") > F.col("total_consumed")))
            .withColumn("before", F.col("upto") - nvl0("received")))


def _running_by_cells(ledger: DataFrame) -> DataFrame:
    """Receipts with their running total and the pair's consumption. Both are added up into cells in
    one pass; used-up cells are dropped before any row of a receipt is sorted."""
    received = ledger.filter(F.col("event_type") == "received")
    part = range_cell(received, "event_id")
    batches = received.select(*PAIR, "event_id", "event_ts", "expiry_date", "quantity", lot().alias("lot"), part.alias("part"))
    left = cells_on_shelf(position_cells(ledger, part)).select(
        *PAIR, "lot", "part", "total_consumed", F.col("before").alias("cumulative_qty_before"))
    return add_running(batches, left, PAIR, ["lot", "part"], ["event_id"], {"cumulative_qty": F.col("quantity")})


def _running_in_place(ledger: DataFrame) -> DataFrame:
    """The same where all rows of a pair lie together: one pass, nothing is shuffled."""
    pair = Window.partitionBy(*PAIR)
    order = pair.orderBy("lot", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    received = F.col("event_type") == "received"
    return (ledger.filter(received | F.col("event_type").isin(*CONSUMING_TYPES))
            .select(*PAIR, "event_id", "event_ts", "event_type", "expiry_date", "quantity", F.when(received, lot()).alias("lot"))
            .withColumn("total_consumed", nvl0(F.sum(F.when(~received, F.col("quantity"))).over(pair)))
            .withColumn("cumulative_qty", F.sum(F.when(received, F.col("quantity"))).over(order))
            .filter(received))


def current_stock(ledger: DataFrame, today: Column | None = None, colocated: bool = False) -> DataFrame:
    """Batches still on the shelf when stock is issued first-expiry-first-out.

    ``colocated`` says that the ledger is read in buckets of pairs of which none is hot (``LedgerStore.
    is_even``); without it a pair may hold any part of the ledger. ``today`` is the ledger's last day
    unless the caller passes the day of a larger ledger.
    """
    rows = (_running_in_place if colocated else _running_by_cells)(ledger).select(
        *PAIR, F.col("event_id").alias("batch_id"), event_day().alias("received_date"), "expiry_date",
        F.col("quantity").alias("batch_qty"), "cumulative_qty", "total_consumed")
    if today is None:
        today = as_of_date(ledger).scalar()
    remaining = F.greatest(F.lit(0), F.least(
        F.col("batch_qty"), F.col("cumulative_qty") - F.col("total_consumed")))
    return (rows.withColumn("remaining_qty", remaining.cast("bigint"))
            .filter(F.col("remaining_qty") > 0)
            .withColumn("as_of_date", today)
            .select(*PAIR, "batch_id", "received_date", "expiry_date", "batch_qty",
                    "remaining_qty",
                    F.datediff("expiry_date", "as_of_date").alias("days_to_expiry"),
                    F.coalesce(F.col("expiry_date") <= F.col("as_of_date"), F.lit(False)).alias("is_expired"),
                    F.col("expiry_date").isNull().alias("expiry_unknown"),
                    "as_of_date"))


def ledger_balance(ledger: DataFrame) -> DataFrame:
    used = F.sum(F.when(F.col("event_type").isin(*CONSUMING_TYPES), F.col("quantity")).otherwise(0))
    return ledger.groupBy(*PAIR).agg((_units("received") - used).alias("balance"))


def stock_reconcile(ledger: DataFrame, stock: DataFrame) -> DataFrame:
    held = stock.groupBy(*PAIR).agg(F.sum("remaining_qty").alias("batched"))
    return ledger_balance(ledger).join(held, PAIR, "left").agg(
        F.count_if(nvl0("batched") != F.col("balance")).alias("mismatches"),
        F.count_if(F.col("balance") < 0).alias("below_zero"),
        F.count("*").alias("compared"))


def stock_verify(stock: DataFrame) -> DataFrame:
    live = lambda days: ~F.col("is_expired") & (F.col("days_to_expiry") <= days)
    units = lambda c: F.sum(F.when(c, F.col("remaining_qty")).otherwise(0))
    series = stock.groupBy(*PAIR).agg(
        F.count("*").alias("rows"), F.sum("remaining_qty").alias("units"),
        F.count_if("is_expired").alias("xb"), units(F.col("is_expired")).alias("xu"),
        F.count_if(live(90)).alias("b90"), units(live(90)).alias("u90"),
        F.count_if(live(180)).alias("b180"), F.max("as_of_date").alias("day"))
    return series.agg(
        F.sum("rows").alias("batch_rows"), F.count_distinct("facility_id").alias("facilities"),
        F.count("*").alias("series"), F.sum("units").alias("units_on_hand"),
        F.sum("xb").alias("expired_batches"), F.sum("xu").alias("expired_units"),
        F.sum("b90").alias("expiring_90d_batches"), F.sum("u90").alias("expiring_90d_units"),
        F.sum("b180").alias("expiring_180d_batches"), F.max("day").alias("as_of"))


def recorded_balance(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """Ledger balance of the wanted pairs; a pair never seen has balance 0."""
    keys = keys.select(*PAIR).distinct()
    return keys.join(ledger_balance(ledger), PAIR, "left").select(*PAIR, nvl0("balance").alias("balance"))


def health_cover(forecast: DataFrame, ledger: DataFrame, facilities: DataFrame,
                 items: DataFrame) -> DataFrame:
    """Cover by the older rule: received less dispensed only, floored at zero."""
    demand = forecast.groupBy(*PAIR).agg(mean4("value").alias("daily_demand"))
    held = ledger.groupBy(*PAIR).agg(
        (_units("received") - _units("dispensed")).alias("on_hand"))
    fac = facilities.filter("is_forecast_facility").select("facility_id")
    return (demand.join(fac, "facility_id")
            .join(items.select("item_id", "display_name", "ven_class", "unit"), "item_id")
            .join(held, PAIR, "left")
            .withColumn("on_hand", F.greatest(nvl0("on_hand"), F.lit(0)))
            .withColumn("days_of_cover", ratio("on_hand", "daily_demand")))


def health_mix(cover: DataFrame, critical: int = 7, low: int = 14) -> DataFrame:
    d = F.col("days_of_cover")
    return cover.agg(
        F.count_if(d < critical).alias("critical"),
        F.count_if((d >= critical) & (d < low)).alias("low"),
        F.count_if(d >= low).alias("healthy"), F.count("*").alias("total_series"),
        rnd(mean4("days_of_cover"), 1).alias("mean_days_of_cover"))


def health_shortages(cover: DataFrame, low: int = 14, top: int = 6) -> DataFrame:
    gap = F.greatest(F.col("daily_demand") * low - F.col("on_hand"), F.lit(0.0))
    return (cover.groupBy(F.col("display_name").alias("item_name"), "ven_class", "unit")
            .agg(rnd(sum4(gap)).cast("bigint").alias("deficit_units"),
                 F.count_if(F.col("days_of_cover") < low).alias("facilities_affected"))
            .filter("deficit_units > 0 AND facilities_affected > 0")
            .orderBy(F.desc("deficit_units"), "item_name").limit(top))


def sum4(x) -> Column:
    """Sum of a fractional column, exact at four decimals so that it does not depend
    on the order in which partitions are merged."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(rnd(x, 4).cast("decimal(28,4)")).cast("double")


def mean4(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.try_divide(sum4(x), F.count(x).cast("double"))
