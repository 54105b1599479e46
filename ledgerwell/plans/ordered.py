"""Running totals that never put a whole group into one task.

A window over (facility, item) sorts that pair's rows in a single task, which breaks
when one pair holds a large part of the ledger. Here the rows of a group are cut into
cells that follow the sort order (for example expiry day, then a range of ids). Cell sums are
combined on the map side; the window over a group then sees cells, not rows, and the row window
only ever sees one cell.

A cell is one struct column: null keys are equal inside it, and the same column deals the rows
for the join with the cells and for the window, with one exchange.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = "_cell_key"


def range_cell(df: DataFrame, col: str, cells: int = 64, per_cell: int = 50) -> Column:
    """The number of the range of ``col`` that a row falls into. Bounds are quantiles of a uniform
    sample of ``cells * per_cell`` values, so ranges follow the values, whatever they look like.
    A null is in the first range."""
    drawn = df.select(col).filter(F.col(col).isNotNull()).orderBy(F.rand(11)).limit(cells * per_cell)
    values = sorted(r[0] for r in drawn.collect())                       # a fixed number of values
    bounds = sorted({values[i * len(values) // cells] for i in range(1, cells)}) if values else []

    def search(lo: int, hi: int) -> Column:                              # generated code, log2(cells) comparisons
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(col) >= F.lit(bounds[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))
    return search(0, len(bounds))


def cell_totals(df: DataFrame, keys: list[str], coarse: list[str],
                totals: dict[str, Column]) -> DataFrame:
    """One row per cell: its own totals (``<name>_cell``) and those before it
    (``<name>_before``)."""
    cells = df.groupBy(*keys, *coarse).agg(
        *[F.sum(v).alias(f"{n}_cell") for n, v in totals.items()])
    upto = (Window.partitionBy(*keys).orderBy(*coarse)
            .rowsBetween(Window.unboundedPreceding, 0))
    for n in totals:
        cells = cells.withColumn(
            f"{n}_before", F.sum(f"{n}_cell").over(upto) - F.col(f"{n}_cell"))
    return cells


def add_running(df: DataFrame, cells: DataFrame, keys: list[str], coarse: list[str],
                order: list, totals: dict[str, Column]) -> DataFrame:
    """Attach inclusive running totals to the rows; drops the helper columns.
    Columns a caller added to ``cells`` are kept."""
    cell = F.struct(*keys, *coarse)
    inside = Window.partitionBy(CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    shown = cells.select(cell.alias(CELL), *[c for c in cells.columns if c not in keys + coarse])
    out = df.withColumn(CELL, cell).join(shown, CELL)
    for n, v in totals.items():
        out = out.withColumn(n, F.col(f"{n}_before") + F.sum(v).over(inside))
    return out.drop(CELL, *[f"{n}_before" for n in totals], *[f"{n}_cell" for n in totals])


def running_totals(df: DataFrame, keys: list[str], coarse: list[str], order: list,
                   totals: dict[str, Column]) -> DataFrame:
    return add_running(df, cell_totals(df, keys, coarse, totals),
                       keys, coarse, order, totals)
