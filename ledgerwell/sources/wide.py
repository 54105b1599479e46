"""Reading of wide tables by a declared list of columns."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDE = 8


class WideRead(ValueError):
    """A wide table was asked for without saying which columns are needed."""


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None, wide: int = WIDE) -> DataFrame:
    """The named columns of a Parquet table, so that the scan reads nothing else.

    A table of ``wide`` columns or more is refused without a list, with ``*`` in it, with all of its
    columns or with a name it does not have; a narrower one may be read whole. Names are compared
    as they are written, so one with a dot or a blank is one name.
    """
    df = spark.read.parquet(path)
    if columns is None and len(df.columns) < wide:
        return df
    if not columns or "*" in columns:
        raise WideRead(f"{path} has {len(df.columns)} columns: name those that are needed")
    unknown, twice = sorted(set(columns) - set(df.columns)), len(columns) != len(set(columns))
    if unknown or twice:
        raise WideRead(f"{path}: no such columns {unknown}" if unknown else f"{path}: a column is named twice")
    if len(df.columns) >= wide and len(columns) == len(df.columns):
        raise WideRead(f"{path}: all {len(columns)} columns are named")
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in columns])
