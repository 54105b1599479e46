"""Streams over the ledger (K1-K7).

Every sink is written per micro-batch under the batch's own number, so a batch that is run
again after a failure replaces what it wrote instead of adding to it.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import nvl0
from ..operators import plan, quality, stock
from ..operators.stock import PAIR
from ..operators.transfers import LIFECYCLE, apply_requests
from ..plans.kept import BUCKETS, KeptTable
from ..schema import CONSUMING_TYPES


def stream_of(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def seen_keys(spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> KeptTable:
    return KeptTable(spark, path, f"{key} string", [key], buckets)


def write_new(df: DataFrame, path: str, batch_id: int, key: str, seen: KeptTable) -> list[int]:
    """Write the rows whose key no earlier batch wrote, however long ago; one row of a key that the
    batch itself repeats. Keys of all batches are kept in buckets by digest, and only those of
    this batch's keys are read."""
    mine = df.dropDuplicates([key])
    buckets = seen.touched(mine)
    before = seen.read(batch_id - 1, buckets)
    write_batch(mine.join(before, key, "left_anti"), path, batch_id)
    if buckets:
        new = df.sparkSession.read.parquet(f"{path}/batch={batch_id}").select(key)
        seen.replace(before.unionByName(new), batch_id)
        seen.forget(buckets, batch_id)
    return buckets


def run_available(df: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None],
                  mode: str = "append") -> None:
    """Process everything that has arrived, then stop; the next call goes on from there."""
    query = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(on_batch).start())
    query.awaitTermination()


# -- K1 ----------------------------------------------------------------------------------

def ingest_captures(replies: DataFrame, items: DataFrame, out: str, checkpoint: str) -> None:
    """Replies through the gate: ledger rows to one sink, records to review to the other."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        gated = quality.capture_gate(quality.verify_item(quality.parse_reply(batch), items)).persist()
        write_batch(quality.to_ledger(gated.filter("route = 'events'")), f"{out}/ledger", batch_id)
        write_batch(gated.filter("route = 'review'").select(
            "event_id", "facility_id", "item_id", "event_type", "quantity", "confidence", "review_reason",
            F.lit("pending").alias("status")), f"{out}/review", batch_id)
        gated.unpersist()

    run_available(replies, checkpoint, on_batch)


# -- K2 ----------------------------------------------------------------------------------

def movements_once(movements: DataFrame, horizon: str = "30 days") -> DataFrame:
    """Each derived id once inside the horizon, which bounds the state; ``write_new`` keeps out
    repeats that come later."""
    return movements.withWatermark("event_ts", horizon).dropDuplicatesWithinWatermark(["event_id"])


# -- K3 ----------------------------------------------------------------------------------

def balances(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeptTable:
    return KeptTable(spark, path, "facility_id string, item_id string, balance bigint", PAIR, buckets)


def hold_overdraws(batch: DataFrame, batch_id: int, opening: DataFrame, kept: KeptTable, out: str) -> list[int]:
    """Hold what takes off more than the shelf has, across micro-batches: the running balance of a
    pair is kept, its opening balance counts the first time the pair is seen. Rows of a batch are
    sorted and streamed in report order, so a pair may have any number of them."""
    rows = batch if "resource_type" in batch.columns else batch.withColumn("resource_type", F.lit("medicine"))
    buckets = kept.touched(rows)
    known = kept.read(batch_id - 1, buckets)
    new = rows.select(*PAIR).distinct().join(known, PAIR, "left_anti").join(opening, PAIR, "left").select(*PAIR, nvl0("balance").alias("balance"))
    start = known.unionByName(new)
    folded = quality.overdraw_hold(rows, start, group=())
    write_batch(folded.select("event_id", *PAIR, "event_type", "quantity", "held", "on_record", "resource_type"), out, batch_id)
    if buckets:
        done = batch.sparkSession.read.parquet(f"{out}/batch={batch_id}").filter("resource_type = 'medicine' AND NOT held")
        moved = (F.when(F.col("event_type") == "received", F.col("quantity"))
                 .when(F.col("event_type").isin(*CONSUMING_TYPES), -F.col("quantity")))
        change = done.select(*PAIR, nvl0(moved).alias("balance"))
        kept.replace(start.unionByName(change).filter("item_id IS NOT NULL").groupBy(*PAIR).agg(F.sum("balance").alias("balance")), batch_id)
        kept.forget(buckets, batch_id)
    return buckets


# -- K4 ----------------------------------------------------------------------------------

KEEP_CLOSED = 400                # days


def transfer_states(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeptTable:
    return KeptTable(spark, path, "recommendation_id string, reached int, since timestamp_ntz", ["recommendation_id"], buckets)


def advance_transfers(batch: DataFrame, batch_id: int, kept: KeptTable, out: str, keep_closed: int = KEEP_CLOSED) -> list[int]:
    """The transfer lifecycle across micro-batches; the step a transfer has reached is kept. Each
    step is one minimum, so a transfer may have any number of requests. A received transfer stays
    known for ``keep_closed`` days of the requests' own time, to refuse late repeats, and leaves
    the table when its bucket is written after that."""
    steps = batch.filter(F.col("step").isin(*LIFECYCLE[1:]))
    buckets = kept.touched(steps)
    known = kept.read(batch_id - 1, buckets)
    write_batch(apply_requests(steps, known), out, batch_id)
    if buckets:
        log = batch.sparkSession.read.parquet(f"{out}/batch={batch_id}")
        position = F.array_position(F.array(*[F.lit(s) for s in LIFECYCLE]), F.col("fulfilment_status")) - 1
        now = log.select("recommendation_id", position.cast("int").alias("reached"), F.col("updated_at").cast("timestamp_ntz").alias("since"))
        rows = known.unionByName(now).groupBy("recommendation_id").agg(F.max("reached").alias("reached"), F.max("since").alias("since"))
        old = F.date_sub(F.to_date(steps.agg(F.max("ts")).scalar()), keep_closed)
        closed = (F.col("reached") == len(LIFECYCLE) - 1) & (F.to_date("since") < old)
        kept.replace(rows.filter(~closed), batch_id)
        kept.forget(buckets, batch_id)
    return buckets


# -- K5, K6 ------------------------------------------------------------------------------

def rolling_reports(events: DataFrame, length: str = "24 hours", slide: str = "1 hour",
                    late: str = "1 hour") -> DataFrame:
    """Reports per resource type in every sliding window."""
    return (events.withWatermark("event_ts", late).groupBy(F.window("event_ts", length, slide), "resource_type")
            .agg(F.count("*").alias("reports")))


def reporting_periods(events: DataFrame, length: str = "30 days", late: str = "1 day") -> DataFrame:
    return (events.filter("event_type = 'count'").withWatermark("event_ts", late)
            .groupBy(F.window("event_ts", length), "facility_id").agg(F.count("*").alias("reports")))


def keep_latest(out: str) -> Callable[[DataFrame, int], None]:
    """Sink for update mode: a batch writes the groups it changed."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        flat = batch.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                            *[c for c in batch.columns if c != "window"])
        write_batch(flat, out, batch_id)
    return on_batch


def latest(spark: SparkSession, out: str, keys: list[str], value: str) -> DataFrame:
    return spark.read.parquet(out).groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


# -- K7 ----------------------------------------------------------------------------------

CELLS = "facility_id string, item_id string, lot date, part int, received bigint, consumed bigint, last_day date"


def live_cells(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeptTable:
    return KeptTable(spark, path, CELLS, PAIR, buckets)


def merge_positions(batch: DataFrame, kept: KeptTable, batch_id: int) -> list[int]:
    """Adds a micro-batch to the kept totals of its pairs; returns the buckets it read and wrote.
    The ledger is not read, and neither are the other buckets."""
    delta = stock.position_cells(batch)
    buckets = kept.touched(batch)
    if buckets:
        kept.replace(stock.add_cells(kept.read(batch_id - 1, buckets), delta), batch_id)
        kept.forget(buckets, batch_id)
    return buckets


def live_lines(kept: KeptTable, baseline: DataFrame, facilities: DataFrame, items: DataFrame,
               pairs: DataFrame | None = None) -> DataFrame:
    """Reorder status of every pair, or of the wanted ones, as of the last batch: worked out from the
    kept totals when it is read."""
    today = kept.read().agg(F.max("last_day")).scalar()
    if pairs is None:
        cells = kept.read()
    else:
        cells = kept.read(buckets=kept.touched(pairs)).join(pairs.select(*PAIR).distinct(), PAIR, "left_semi")
        baseline = baseline.join(pairs.select(*PAIR).distinct(), PAIR, "left_semi")
    return plan.status_of(baseline, facilities, items, stock.on_hand(cells, today))


def refresh_positions(events: DataFrame, ledger_path: str, kept: KeptTable, out: str, checkpoint: str,
                      baseline: DataFrame, facilities: DataFrame, items: DataFrame) -> None:
    """Append each micro-batch to the ledger, merge it into the kept totals, and write the lines of
    the pairs it touched as alerts of that batch."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, ledger_path, batch_id)
        mine = batch.sparkSession.read.schema(batch.schema).parquet(f"{ledger_path}/batch={batch_id}")
        merge_positions(mine, kept, batch_id)
        lines = live_lines(kept, baseline, facilities, items, mine)
        write_batch(lines.select(*PAIR, "on_hand", "days_of_cover", "needs_reorder", "status"), out, batch_id)

    run_available(events, checkpoint, on_batch)
