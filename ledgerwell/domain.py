"""The domain tables of one data folder, each derived once per session.

The ledger is a stored table that sessions share; the tables that many operators read (the reorder
position above all) are written to the shared folder and read back. Call ``refresh`` after the
ledger has grown: the position then moves with the next read.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import forecast, plan, quality, resources, seasonal, stock, surge, transfers
from .plans.snapshot import shared_folder, snapshot
from .sources import testbed as tb
from .sources.store import LedgerStore, published

BUCKETS = 8            # of the stored test ledger at least; its days are kept by month
ROWS_PER_BUCKET = 400_000
MIN_DAYS = 8           # the test ledger has about two dozen events per series
SURGE = {"z_cut": 1.5, "min_ratio": 1.2, "min_absolute": 10.0}


def buckets_for(rows: int) -> int:
    """Buckets of a ledger of so many rows. One bucket is one task, so its size is what stays the same."""
    return max(BUCKETS, -(-rows // ROWS_PER_BUCKET))


class Domain:
    _open: dict[tuple, "Domain"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Domain":
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._open:
            cls._open[key] = cls(spark, sf_dir)
        return cls._open[key]

    @classmethod
    def refresh(cls) -> None:
        cls._open.clear()

    def read(self, name: str) -> DataFrame:
        return tb.read(self.spark, self.sf_dir, name)

    # lazy
    @property
    def resource_events(self) -> DataFrame:
        return self.ledger.unionByName(self.captures)

    @property
    def register(self) -> DataFrame:
        return tb.facilities(self.spark, self.sf_dir)

    @property
    def ledger(self) -> DataFrame:
        """The medicine rows of the stored ledger, in the columns of the event rows."""
        return self.store.read("medicine", columns=tb.STOCK_EVENT_COLUMNS)

    # written once
    @cached_property
    def store(self) -> LedgerStore:
        """A table of its own in the shared folder: a later session opens it again while the given
        files are the same."""
        path = f"{shared_folder(self.spark)}/ledgerwell-stored/{tb.version(self.spark, self.sf_dir)}"
        buckets = buckets_for(self.read("lineitem").count())                  # from the footers of the files
        return published(LedgerStore(self.spark, path, buckets, "month"), lambda: tb.stock_events(self.spark, self.sf_dir))

    @cached_property
    def captures(self) -> DataFrame:
        return snapshot(tb.capture_events(self.spark, self.sf_dir), "captures")

    @cached_property
    def facilities(self) -> DataFrame:
        return snapshot(resources.bed_norm(plan.lead_time(self.register)), "facilities")

    @cached_property
    def items(self) -> DataFrame:
        return snapshot(tb.items(self.spark, self.sf_dir), "items")

    @cached_property
    def demand(self) -> DataFrame:
        return snapshot(tb.demand_reference(self.spark, self.sf_dir), "demand_reference")

    @cached_property
    def staffing(self) -> DataFrame:
        return snapshot(tb.staffing(self.spark, self.sf_dir), "staffing")

    @cached_property
    def training(self) -> DataFrame:
        return snapshot(plan.training_set(self.ledger, self.facilities, MIN_DAYS), "training_set")

    @cached_property
    def forecast(self) -> DataFrame:
        return snapshot(plan.weekday_forecast(self.training), "forecast")

    @cached_property
    def stock(self) -> DataFrame:
        return snapshot(self.live_stock, "current_stock")

    @property
    def live_stock(self) -> DataFrame:
        return stock.current_stock(self.ledger, self.store.last_day("medicine").scalar(), self.store.is_even())

    @cached_property
    def baseline(self) -> DataFrame:
        return snapshot(plan.demand_baseline(self.forecast, self.ledger), "demand_baseline")

    @cached_property
    def reorder(self) -> DataFrame:
        return snapshot(plan.reorder_status(self.baseline, self.facilities, self.items, self.stock),
                        "reorder_status")

    @cached_property
    def recs(self) -> DataFrame:
        return snapshot(transfers.recommendations(self.reorder, self.stock, self.facilities),
                        "recommendations")

    @cached_property
    def access(self) -> DataFrame:
        return snapshot(transfers.nearest_help(self.reorder, self.facilities), "nearest_help")

    @property
    def requests(self) -> DataFrame:
        return tb.transfer_requests(self.spark, self.sf_dir)

    @cached_property
    def profiles(self) -> DataFrame:
        return snapshot(seasonal.district_profiles(self.facilities, self.demand), "district_profiles")

    @cached_property
    def vectors(self) -> DataFrame:
        return snapshot(seasonal.pattern_vectors(self.demand, self.items), "pattern_vectors")

    @cached_property
    def matches_out(self) -> DataFrame:
        return snapshot(seasonal.district_matches(self.profiles), "district_matches")

    @cached_property
    def matches_in(self) -> DataFrame:
        return snapshot(seasonal.district_matches(self.profiles, True), "district_matches_same_state")

    @cached_property
    def exchange(self) -> DataFrame:
        return snapshot(seasonal.exchange_eval(self.vectors, self.matches_out, self.matches_in),
                        "exchange_eval")

    @property
    def published(self) -> DataFrame:
        """Vectors as the districts send them: by class, in the order of their names."""
        v = seasonal.published_vector(self.vectors)
        return v.select(F.lit("IN").alias("country_code"), F.col("atc_class").alias("atc_code"),
                        F.col("monthly_multipliers").alias("monthly_coefficients"),
                        F.col("district_key").alias("source_district"),
                        F.col("district_key").alias("ingested_at"))

    @property
    def signal_classes(self) -> DataFrame:
        return self.spark.createDataFrame(tb.SIGNAL_CLASSES, "demand_driver string, signal_class string")

    @cached_property
    def signals(self) -> DataFrame:
        return snapshot(surge.surge_signals(self.vectors, **SURGE), "surge_signals")

    @cached_property
    def labels(self) -> DataFrame:
        return snapshot(surge.signal_labels(self.items, self.signal_classes), "signal_labels")

    @cached_property
    def impact(self) -> DataFrame:
        return snapshot(surge.surge_supply_impact(self.reorder, self.signals), "surge_supply_impact")

    @cached_property
    def absorption(self) -> DataFrame:
        return snapshot(surge.network_absorption(self.reorder), "network_absorption")

    @cached_property
    def surge_recs(self) -> DataFrame:
        return snapshot(surge.surge_recommendations(self.impact, self.reorder, self.stock, self.facilities),
                        "surge_recommendations")

    @cached_property
    def beds(self) -> DataFrame:
        return snapshot(resources.bed_status(self.captures, self.facilities), "bed_status")

    @cached_property
    def posts(self) -> DataFrame:
        return snapshot(resources.facility_staffing(self.staffing, self.facilities), "facility_staffing")

    @cached_property
    def staff(self) -> DataFrame:
        return snapshot(resources.staff_status(self.posts, self.facilities), "staff_status")

    @property
    def replies(self) -> DataFrame:
        return tb.replies(self.spark, self.sf_dir)

    @cached_property
    def gate(self) -> DataFrame:
        return snapshot(quality.capture_gate(quality.verify_item(
            quality.parse_reply(self.replies), self.items)), "capture_gate")

    @cached_property
    def models(self) -> DataFrame:
        return snapshot(forecast.fit_models(self.training), "models")
