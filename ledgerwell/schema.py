"""Table schemas and closed vocabularies."""
from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields) -> T.StructType:
    """('name', type) is nullable, ('name!', type) is not."""
    return T.StructType([T.StructField(n.rstrip("!"), t, not n.endswith("!"))
                         for n, t in fields])


S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
DAY, TS, STRINGS = T.DateType(), T.TimestampType(), T.ArrayType(T.StringType())

RESOURCE_EVENTS = _struct(
    ("event_id!", S), ("resource_type!", S), ("facility_id!", S), ("item_id!", S),
    ("event_type!", S), ("quantity!", L), ("event_ts!", TS), ("source!", S),
    ("confidence", D), ("raw_transcript", S), ("expiry_date", DAY),
    ("resource_subtype", S), ("capacity", D))
LEDGER_COLUMNS = RESOURCE_EVENTS.fieldNames()

FACILITIES = _struct(
    ("facility_id!", S), ("country_code!", S), ("name", S), ("admin_l1", S),
    ("admin_l2", S), ("admin_l3", S), ("facility_type", S), ("location_type", S),
    ("latitude", D), ("longitude", D), ("population_served", L),
    ("is_demo_facility!", B))

DEMAND_REFERENCE = _struct(
    ("country_code!", S), ("admin_l1!", S), ("admin_l2!", S), ("district_key!", S),
    ("month!", S), ("indicator!", S), ("value!", D))

ITEMS = _struct(
    ("item_id!", S), ("atc_code", S), ("display_name!", S), ("local_name_in!", S),
    ("spoken_variants", STRINGS), ("unit!", S), ("ven_class!", S), ("demand_driver", S),
    ("units_per_driver_event", D), ("driver_rationale", S), ("is_forecast_item!", B),
    ("flat_baseline_reason", S), ("nlem_section", L), ("nlem_section_name", S),
    ("level_of_care", S), ("dosage_forms", S))

STAFFING = _struct(
    ("state!", S), ("cadre!", S), ("applies_to_facility_types", STRINGS),
    ("required", L), ("sanctioned", L), ("in_position", L), ("vacant", L),
    ("vacancy_rate", D), ("source_year!", L), ("source_file!", S))

TRANSFER_FULFILMENT = _struct(
    ("recommendation_id!", S), ("fulfilment_status!", S), ("from_facility_id", S),
    ("to_facility_id", S), ("item_id", S), ("quantity", L), ("approved_at", TS),
    ("dispatched_at", TS), ("received_at", TS), ("dispatch_event_id", S),
    ("receipt_event_id", S), ("updated_at", TS))

IMPACT_METRICS = _struct(
    ("as_of_date", DAY), ("units_dispensed", L), ("units_unmet", L), ("unmet_share", D),
    ("units_expired_fefo", L), ("units_expired_fifo", L),
    ("waste_avoided_by_fefo_units", L), ("waste_avoided_share", D))

# Closed vocabularies.
MOVEMENT_TYPES = ("received", "dispensed", "count", "lost", "dispatched", "expired")
CONSUMING_TYPES = ("dispensed", "expired", "dispatched", "lost")
NON_MOVEMENT_TYPES = ("request", "identify")
BED_TYPES = ("occupancy", "turned_away")
CAPTURE_SOURCES = ("voice", "chat", "barcode", "tap", "photo", "sms")
RESOURCE_TYPES = ("medicine", "bed", "personnel")
VEN_CLASSES = ("Vital", "Essential", "Desirable")
