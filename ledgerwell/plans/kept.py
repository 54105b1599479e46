"""A table that micro-batches merge into without rereading it.

Rows lie in buckets by a digest of their key. A batch reads the buckets its keys fall into,
combines them with its own rows, and writes those buckets anew under its number; other buckets are
neither read nor written. A bucket's newest committed version is its content, so a batch that is run
again after a failure reads what it read before and replaces what it wrote.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class KeptTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        """The numbers of the entries ``<prefix>N`` of a folder."""
        at = self._path(folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return [int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit()]

    def _versions(self, bucket: int, upto: int) -> list[int]:
        return sorted(v for v in self._numbers(f"rows/bucket={bucket}", "at=") if v <= upto)

    def committed(self) -> int:
        return max(self._numbers("committed", ""), default=-1)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def read(self, upto: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows after batch ``upto`` (the last committed one), of some buckets or all."""
        upto = self.committed() if upto is None else upto
        buckets = self._numbers("rows", "bucket=") if buckets is None else buckets
        newest = [f"{self.path}/rows/bucket={b}/at={versions[-1]}" for b in buckets if (versions := self._versions(b, upto))]
        return self.spark.read.schema(self.schema).parquet(*newest) if newest else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, batch: int) -> None:
        """Writes whole buckets as of ``batch`` and commits it. Versions that no rerun needs go."""
        (rows.withColumn("bucket", self.bucket()).withColumn("at", F.lit(batch)).repartition("bucket")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "at").parquet(f"{self.path}/rows"))
        self.commit(batch)

    def commit(self, batch: int) -> None:
        at = self._path(f"committed/{batch}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True).close()

    def forget(self, buckets: Iterable[int], batch: int) -> None:
        """Deletes what ``batch`` and its rerun do not read: all but the newest version before it."""
        for b in buckets:
            for v in self._versions(b, batch - 1)[:-1]:
                at = self._path(f"rows/bucket={b}/at={v}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
