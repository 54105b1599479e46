"""Month names, calendar numbers and the April-March reporting year."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALENDAR = ["January", "February", "March", "April", "May", "June", "July",
            "August", "September", "October", "November", "December"]
FISCAL = CALENDAR[3:] + CALENDAR[:3]
OBSERVED = FISCAL[:3]
HELD_MONTH = "March"                     # held at 1.0, never scored
SCORED = [m for m in FISCAL[3:] if m != HELD_MONTH]


def _names(order) -> Column:
    return F.array(*[F.lit(m) for m in order])


def month_number(name) -> Column:
    return F.array_position(_names(CALENDAR), F.col(name) if isinstance(name, str) else name).cast("int")


def fiscal_number(name) -> Column:
    return F.array_position(_names(FISCAL), F.col(name) if isinstance(name, str) else name).cast("int")


def month_name(date_col) -> Column:
    return F.element_at(_names(CALENDAR), F.month(date_col))
