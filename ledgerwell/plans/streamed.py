"""Work on sorted partitions batch by batch.

``in_key_order(df, keys, order).mapInPandas(...)`` hands a task its rows as Arrow batches in
key order. The other helpers cut the stream at key changes, so one Python call serves a
whole partition and only the current group is held.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_key_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a key together and sorted. The number of partitions is given, because left to
    itself adaptive execution merges small partitions and Python work is slow, not large."""
    return df.repartition(shuffle_width(df), *keys).sortWithinPartitions(*keys, *order)


def sorted_groups(batches: Iterator[pd.DataFrame], n_keys: int):
    """(key, rows) for runs of equal leading columns, across batch borders."""
    key, rows = None, []
    for pdf in batches:
        for row in zip(*(pdf[c].tolist() for c in pdf.columns)):
            k = row[:n_keys]
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(row)
    if rows:
        yield key, rows


def as_frames(produce: Callable, columns: list[str], size: int = 10_000):
    """Turn a generator of tuples into the iterator of frames mapInPandas wants."""
    def run(batches):
        out = []
        for row in produce(batches):
            out.append(row)
            if len(out) >= size:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)
    return run
