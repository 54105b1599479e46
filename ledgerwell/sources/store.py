"""The ledger on disk: partitioned by resource type and day (or month), bucketed by facility and item.

A filter on type or days reads only their folders. All rows of a facility-item pair lie in one
bucket, so that sums and joins by pair need no shuffle of the ledger. Where one pair is so
large that its bucket would keep a task busy long after the others, the files are read
without their buckets instead and spread by size; the operators combine before they shuffle.
"""
from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR = ["facility_id", "item_id"]
PERIOD = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}
BUCKET_FILE = re.compile(r"_(\d{5})\.c\d{3}")
UNEVEN = 4                      # a bucket of so many times the mean size counts as hot
SMALL = 64 << 20                # and only if it is larger than one task's usual share of bytes


class LedgerStore:
    """``period`` and ``buckets`` belong to the stored table; open it with those it was made with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, period: str = "day"):
        self.spark, self.path, self.buckets, self.period = spark, path.rstrip("/"), buckets, period
        self.table = "ledger_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        self._sizes: Counter | None = None

    def _filesystem(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def exists(self) -> bool:
        fs, root = self._filesystem()
        return fs.exists(root)

    def append(self, events: DataFrame) -> None:
        """Adds rows; a task writes one bucket, day by day. Columns are those of the first write."""
        if self.exists():
            self._register()
            events = events.select(*[c for c in self.spark.table(self.table).columns if c != "event_period"])
        rows = events.withColumn("event_period", F.date_format("event_ts", PERIOD[self.period]))
        (rows.repartition(self.buckets, *PAIR).sortWithinPartitions("resource_type", "event_period", *PAIR)
         .write.format("parquet").mode("append").option("path", self.path)
         .partitionBy("resource_type", "event_period").bucketBy(self.buckets, *PAIR).sortBy(*PAIR).saveAsTable(self.table))
        self._sizes = None

    def _register(self) -> None:
        """Puts a table that another session wrote into this session's catalog."""
        if self.spark.catalog.tableExists(self.table):
            return
        found = self.spark.read.parquet(self.path)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name not in ("resource_type", "event_period"))
        self.spark.sql(f"""CREATE TABLE {self.table} ({fields}, resource_type string, event_period string) USING parquet
            PARTITIONED BY (resource_type, event_period)
            CLUSTERED BY (facility_id, item_id) SORTED BY (facility_id, item_id) INTO {self.buckets} BUCKETS LOCATION '{self.path}'""")
        self.spark.catalog.recoverPartitions(self.table)

    def bucket_bytes(self) -> Counter:
        """Bytes per bucket. The files are listed once after a write: they grow in number with the table."""
        if self._sizes is not None:
            return self._sizes
        fs, root = self._filesystem()
        files, sizes = fs.listFiles(root, True), Counter()
        while files.hasNext():
            f = files.next()
            if m := BUCKET_FILE.search(f.getPath().getName()):
                sizes[int(m[1])] += f.getLen()
        self._sizes = sizes
        return sizes

    def is_even(self) -> bool:
        sizes = self.bucket_bytes()
        return max(sizes.values(), default=0) <= max(SMALL, UNEVEN * sum(sizes.values()) / self.buckets)

    def read(self, resource_type: str | None = None, days: tuple[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of one type and between two days (both inclusive), as partition filters."""
        if not self.exists():
            raise AnalysisException(f"no ledger at {self.path}")
        if self.is_even():
            self._register()
            rows = self.spark.table(self.table)
        else:
            rows = self.spark.read.parquet(self.path).withColumn("event_period", F.col("event_period").cast("string"))
        if resource_type is not None:
            rows = rows.filter(F.col("resource_type") == resource_type)
        if days is not None:
            first, last = (F.date_format(F.lit(d).cast("date"), PERIOD[self.period]) for d in days)
            rows = rows.filter(F.col("event_period").between(first, last)).filter(F.to_date("event_ts").between(*[F.lit(d).cast("date") for d in days]))
        names = [c for c in rows.columns if c != "event_period"]
        return rows.select(*(columns or names))

    def last_day(self, resource_type: str | None = None) -> DataFrame:
        """The last day of the ledger (of one type): only rows of the last period are read."""
        self._register()
        rows = self.spark.table(self.table)
        folders = [dict(p.split("=", 1) for p in r.partition.split("/")) for r in self.spark.sql(f"SHOW PARTITIONS {self.table}").collect()]
        periods = [f["event_period"] for f in folders if resource_type in (None, f["resource_type"])]
        if resource_type is not None:
            rows = rows.filter(F.col("resource_type") == resource_type)
        return rows.filter(F.col("event_period") == max(periods, default="")).agg(F.max(F.to_date("event_ts")).alias("today"))


def published(store: LedgerStore, events) -> LedgerStore:
    """Writes the ledger once: under another name first, so that only a whole table is ever opened."""
    if store.exists():
        return store
    fs, root = store._filesystem()
    draft = LedgerStore(store.spark, f"{store.path}.{hashlib.md5(str(id(events)).encode()).hexdigest()[:8]}", store.buckets, store.period)
    draft.append(events())
    store.spark.sql(f"DROP TABLE {draft.table}")                     # the files stay: the table is external
    if not fs.rename(store.spark._jvm.org.apache.hadoop.fs.Path(draft.path), root):
        fs.delete(store.spark._jvm.org.apache.hadoop.fs.Path(draft.path), True)      # another session was first
    return store
