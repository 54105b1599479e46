"""Narrow a table to a place."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = {"facility": "facility_id", "state": "state", "district": "district"}
RECEIVER = {"facility": "to_facility_id", "state": "to_state", "district": "to_district"}
AREA_ONLY = {"facility": None, "state": "state", "district": "district"}


def in_scope(df: DataFrame, state: str | None = None, district: str | None = None,
             facility: str | None = None, vital_only: bool = False,
             columns: dict[str, str | None] = COLUMNS) -> DataFrame:
    """A facility alone decides; otherwise state and district do. A table without a facility
    column falls back to the area; ``skipped_filters`` names what it could not apply."""
    if facility and columns["facility"]:
        df = df.filter(F.col(columns["facility"]) == facility)
    else:
        for name, value in (("state", state), ("district", district)):
            if value:
                df = df.filter(F.col(columns[name]) == value)
    return df.filter("ven_class = 'Vital'") if vital_only else df


def skipped_filters(facility: str | None, columns: dict[str, str | None]) -> list[str]:
    return ["facility"] if facility and not columns["facility"] else []
