"""Reporting, capture rules, coverage and impact."""
from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.months import CALENDAR, FISCAL, HELD_MONTH
from ..functions.num import joined, nvl0, ratio, rnd, share, to_long
from ..plans.listing import upto
from ..plans.one_row import beside
from ..plans.streamed import as_frames, in_key_order, sorted_groups
from ..schema import (CAPTURE_SOURCES, CONSUMING_TYPES, LEDGER_COLUMNS, MOVEMENT_TYPES,
                      NON_MOVEMENT_TYPES)
from .stock import PAIR, event_day, mean4, sum4

CONFIDENCE = 0.6
CENSUS_RURAL = 833_748_852          # fixed value: census 2011, rural population


# -- reporting ---------------------------------------------------------------------------

def facility_reporting(ledger: DataFrame, facilities: DataFrame, period_days: int = 30,
                       periods: int = 3) -> DataFrame:
    """Periods with a stock count among the last three; silent facilities stay."""
    today = ledger.agg(F.max(event_day())).scalar()
    counts = ledger.filter("event_type = 'count'").groupBy("facility_id", event_day().alias("day")).agg(F.count("*").alias("n"))
    age = F.datediff(today, "day")
    reported = (counts.filter(age < period_days * periods)
                .withColumn("p", F.floor(age / period_days))
                .groupBy("facility_id").agg(F.count_distinct("p").alias("periods_reported")))
    seen = counts.groupBy("facility_id").agg(F.max("day").alias("last_report"))
    n = nvl0("periods_reported")
    return (facilities.filter("is_forecast_facility").join(reported, "facility_id", "left")
            .join(seen, "facility_id", "left").withColumn("as_of_date", today).select(
        "facility_id", F.col("name").alias("facility_name"), F.col("admin_l1").alias("state"),
        F.col("admin_l2").alias("district"), F.lit(periods).alias("periods_expected"),
        n.alias("periods_reported"), rnd(n / F.lit(float(periods)), 2).alias("reporting_consistency"),
        "last_report", F.datediff("as_of_date", "last_report").alias("days_since_last_report"),
        F.when(n == 0, "silent").when(n < periods, "partial").otherwise("complete").alias("reporting_status"),
        "as_of_date"))


def reporting_summary(reporting: DataFrame) -> DataFrame:
    s = F.col("reporting_status")
    return reporting.agg(
        F.count("*").alias("facilities"), F.count_if(s == "complete").alias("complete"),
        F.count_if(s == "partial").alias("partial"), F.count_if(s == "silent").alias("silent"),
        rnd(mean4("reporting_consistency"), 3).alias("mean_consistency"))


def reporting_read(reporting: DataFrame, limit: int | None = None) -> DataFrame:
    return (reporting.orderBy("reporting_consistency", F.desc_nulls_last("days_since_last_report"), "facility_id")
            .transform(upto, limit).select("facility_id", "facility_name", "state", "district", "periods_expected",
                                 "periods_reported", "reporting_consistency", "last_report",
                                 "days_since_last_report", "reporting_status"))


# -- capture gate ------------------------------------------------------------------------

EXTRACTION = T.ArrayType(T.StructType([
    T.StructField("local_name", T.StringType()), T.StructField("item_id", T.StringType()),
    T.StructField("generic_name", T.StringType()), T.StructField("event_type", T.StringType()),
    T.StructField("quantity", T.LongType()), T.StructField("unit", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("loss_reason", T.StringType())]))


def parse_reply(replies: DataFrame, column: str = "reply") -> DataFrame:
    """JSON text to one row per extraction. Fences are stripped and a single object counts
    as a list of one; what cannot be read gives one row with ``error`` set."""
    text = F.regexp_replace(F.trim(F.regexp_replace(F.trim(F.col(column)), r"^```(json)?|```$", "")), r"^\s+|\s+$", "")
    text = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    rows = F.when(text.startswith("["), F.from_json(text, EXTRACTION, {"mode": "PERMISSIVE"}))
    parsed = replies.withColumn("_x", rows)
    return (parsed.withColumn("error", F.when(F.col("_x").isNull(), "reply is not JSON"))
            .withColumn("_e", F.explode_outer("_x"))
            .select(*replies.columns, "error", "_e.*").drop(column))


def loss_reason(event_type="event_type", reason="loss_reason") -> Column:
    """Kept for losses only, lower-cased; no reason given is 'unknown'."""
    text = F.lower(F.trim(F.coalesce(F.col(reason), F.lit(""))))
    return F.when(F.col(event_type) == "lost", F.when(text == "", "unknown").otherwise(text))


def name_key(col) -> Column:
    """A spoken or written name without case, bracketed glosses, strengths and spacing."""
    c = F.col(col) if isinstance(col, str) else col
    # The patterns of a name key.
    c = F.regexp_replace(c, r"\([^)]*\)|\[[^\]]*\]", " ")
    c = F.regexp_replace(F.lower(c), r"\b\d+(\.\d+)?\s*(mg|ml|mcg|g|gm|iu|lac|%)?\b", " ")
    c = F.regexp_replace(c, r"\s+", " ")
    return F.nullif(F.regexp_replace(c, r"^[ .,-]+|[ .,-]+$", ""), F.lit(""))


def verify_item(rows: DataFrame, items: DataFrame) -> DataFrame:
    """A given id counts only if the catalogue has it; else the spoken name, else the
    generic-name hint. Adds ``matched_id`` and ``matched_by``."""
    ids = items.select(F.col("item_id").alias("given_ok")).distinct()
    names = items.groupBy(name_key("display_name").alias("key")).agg(F.min("item_id").alias("by_name"))
    hints = names.withColumnsRenamed({"key": "hint_key", "by_name": "by_hint"})
    out = (rows.join(ids, F.trim("item_id") == F.col("given_ok"), "left")
           .withColumn("key", name_key("local_name")).withColumn("hint_key", name_key("generic_name"))
           .join(names, "key", "left").join(hints, "hint_key", "left"))
    return (out.withColumn("matched_id", F.coalesce("given_ok", "by_name", "by_hint"))
            .withColumn("matched_by", F.when(F.col("given_ok").isNotNull(), "id")
                        .when(F.col("by_name").isNotNull(), "name").when(F.col("by_hint").isNotNull(), "hint"))
            .drop("given_ok", "key", "hint_key", "by_name", "by_hint"))


def capture_gate(rows: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    """Route every extraction: ledger, review (with the reason), request or identified.
    Expects ``matched_id``; rows that could not be parsed become errors."""
    event = F.coalesce("event_type", F.lit("count"))
    conf = rnd(F.coalesce("confidence", F.lit(0.0)), 3)
    reason = (F.when(~event.isin(*MOVEMENT_TYPES), "unknown event type")
              .when(F.col("matched_id").isNull(), "no matching item")
              .when(F.coalesce("confidence", F.lit(0.0)) < threshold, "low confidence")
              .when(F.col("quantity").isNull(), "no quantity"))
    movement = ~event.isin(*NON_MOVEMENT_TYPES) & F.col("error").isNull()
    route = (F.when(F.col("error").isNotNull(), "errors").when(event == "request", "requests")
             .when(event == "identify", "identified").when(reason.isNotNull(), "review")
             .otherwise("events"))
    return (rows.withColumn("route", route).withColumn("review_reason", F.when(movement, reason))
            .withColumn("resource_subtype", loss_reason()).withColumn("confidence", conf)
            .withColumn("event_type", event).withColumn("item_id", F.col("matched_id")))


def confirm_rows(rows: DataFrame) -> DataFrame:
    """Rows a worker has read back: full confidence, every other rule still applies."""
    return capture_gate(rows.withColumn("confidence", F.lit(1.0)))


def overdraw_hold(events: DataFrame, balances: DataFrame | None, group=("report_id",)) -> DataFrame:
    """Hold what takes off more than the shelf has, in report order.

    A held row must not lower the balance, so this is a fold and not a running sum. Rows
    are sorted inside partitions and streamed batch by batch with one number of state per
    report and pair, so no group has to fit in memory. With no balances nothing is held.
    """
    out = T.StructType(events.schema.fields + [T.StructField("held", T.BooleanType()),
                                               T.StructField("on_record", T.LongType())])
    cols = events.columns
    if balances is None:
        return events.withColumn("held", F.lit(False)).withColumn("on_record", F.lit(None).cast("bigint"))
    keys = [*group, *PAIR]
    rows = (events.join(balances.select(*PAIR, F.col("balance").alias("_start")), PAIR, "left")
            .withColumn("_start", nvl0("_start")))
    consuming = set(CONSUMING_TYPES)

    def fold(batches):
        last, have = None, 0
        for pdf in batches:
            held, seen = [], []
            for key, kind, qty, item, start, res in zip(
                    pdf[keys].itertuples(index=False, name=None), pdf["event_type"], pdf["quantity"],
                    pdf["item_id"], pdf["_start"], pdf["resource_type"]):
                if key != last:
                    last, have = key, int(start)
                seen.append(have)
                hold = False
                if res == "medicine" and item is not None and not pd.isna(qty):
                    if kind == "received":
                        have += int(qty)
                    elif kind in consuming:
                        if int(qty) > have:
                            hold = True
                        else:
                            have -= int(qty)
                held.append(hold)
            pdf["held"], pdf["on_record"] = held, seen
            yield pdf[[*cols, "held", "on_record"]]

    return in_key_order(rows, keys, ["seq"]).mapInPandas(fold, out)


def review_approve(review: DataFrame, approvals: DataFrame) -> DataFrame:
    """Answer to every approval, in order: the first usable one promotes the record, later
    ones are refused. The reviewer's quantity wins over the extracted one."""
    rec = review.select("event_id", F.col("item_id").alias("_item"), F.col("quantity").alias("_qty"),
                        F.lit(True).alias("_known"))
    qty = F.coalesce("approved_quantity", "_qty")
    rows = approvals.join(rec, "event_id", "left").withColumn("quantity", qty)
    fault = (F.when(F.col("_known").isNull(), "no review item").when(F.col("_item").isNull(), "no item")
             .when(F.col("quantity").isNull(), "no quantity").when(F.col("quantity") < 0, "negative quantity"))
    rows = rows.withColumn("fault", fault).withColumn("at", F.struct("approved_at", "approval_id"))
    first = rows.groupBy("event_id").agg(F.min(F.when(F.col("fault").isNull(), F.col("at"))).alias("first"))
    rows = rows.join(first, "event_id")
    reason = F.when(F.col("_known").isNotNull() & F.coalesce(F.col("at") > F.col("first"), F.lit(False)),
                    "already approved").otherwise(F.col("fault"))
    return rows.select("approval_id", "event_id", F.col("_item").alias("item_id"),
                       reason.isNull().alias("approved"), reason.alias("reason"),
                       F.when(reason.isNull(), F.col("quantity")).alias("quantity"),
                       F.when(reason.isNull(), F.when(F.col("approved_quantity").isNotNull(), "reviewer")
                              .otherwise("extraction")).alias("quantity_source"))


def pending_review(review: DataFrame, decided: DataFrame) -> DataFrame:
    done = decided.filter("approved").select("event_id")
    return review.join(done, "event_id", "left_anti")


def to_ledger(records: DataFrame) -> DataFrame:
    """Project capture records onto the ledger's columns; absent ones are NULL."""
    have = set(records.columns)
    empty = {"expiry_date": "date", "capacity": "double"}
    return records.select(*[F.col(c) if c in have else F.lit(None).cast(empty.get(c, "string")).alias(c)
                            for c in LEDGER_COLUMNS])


# -- counts of captures ------------------------------------------------------------------

def captures(ledger: DataFrame, today=None) -> DataFrame:
    """today: a date or expression; the ledger's last day when not given."""
    rows = ledger.filter(F.col("source").isin(*CAPTURE_SOURCES))
    today = ledger.agg(F.max(event_day())).scalar() if today is None else F.lit(today).cast("date")
    return rows.agg(
        F.count_if(event_day() == today).alias("captures_today"),
        F.count_if(event_day() >= F.date_sub(today, 7)).alias("captures_last_7_days"),
        F.count("*").alias("captures_all_time"), F.count_distinct("facility_id").alias("facilities_reporting"),
        *[F.count_if(F.col("source") == s).alias(s) for s in CAPTURE_SOURCES])


def reported_today(events: DataFrame, resource_type: str, scope: DataFrame, now=None,
                   hours: int = 24) -> DataFrame:
    now = events.agg(F.max("event_ts")).scalar() if now is None else F.lit(now).cast("timestamp_ntz")
    rows = _recent_counts(events, resource_type, scope, now, hours)
    return rows.agg(F.count_distinct("facility_id").alias("centres"), F.count("*").alias("reports"),
                    F.max("event_ts").alias("latest"))


def reported_latest(events: DataFrame, resource_type: str, scope: DataFrame, now=None,
                    hours: int = 24, top: int = 20) -> DataFrame:
    now = events.agg(F.max("event_ts")).scalar() if now is None else F.lit(now).cast("timestamp_ntz")
    return (_recent_counts(events, resource_type, scope, now, hours)
            .orderBy(F.desc("event_ts"), "event_id").limit(top)
            .select("facility_id", "item_id", "quantity", "event_ts"))


def _recent_counts(events, resource_type, scope, now, hours):
    return (events.filter((F.col("resource_type") == resource_type) & (F.col("event_type") == "count")
                          & F.col("source").isin(*CAPTURE_SOURCES)
                          & (F.col("event_ts") >= now - F.expr(f"INTERVAL {hours} HOURS")))
            .join(scope.select("facility_id").distinct(), "facility_id", "left_semi"))


# -- quality and geography ---------------------------------------------------------------

def data_quality(facilities: DataFrame, items: DataFrame) -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    bad = ~F.coalesce("has_valid_coords", F.lit(False))
    fac = facilities.filter("country_code = 'IN'").agg(
        F.count("*").alias("facilities_loaded"),
        F.count_if(lat.isNull() | lon.isNull()).alias("missing_coords"),
        F.count_if((lat < -90) | (lat > 90)).alias("latitude_out_of_range"),
        F.count_if((lon < -180) | (lon > 180)).alias("longitude_out_of_range"),
        F.count_if(lat.between(-90, 90) & lon.between(-180, 180)
                   & ~(lat.between(6, 38) & lon.between(68, 98))).alias("outside_box"),
        F.count_if(bad).alias("excluded_from_distance"),
        F.count_if(bad & F.col("is_demo_facility")).alias("excluded_demo_facilities"),
        F.count_if(F.col("population_served").isNull()).alias("missing_population"),
        F.count_if(F.col("is_forecast_facility")).alias("forecast_facilities"),
        F.count_if(F.col("is_forecast_facility") & F.col("lead_time_is_estimated")).alias("implausible_hq_distance"))
    cat = items.agg(F.count("*").alias("items"), F.count_if(F.col("atc_code").isNull()).alias("items_without_atc"))
    return beside(fac, cat)


def geo_summary(facilities: DataFrame) -> DataFrame:
    """State and district rows in one pass over the register."""
    rows = facilities.filter("country_code = 'IN' AND admin_l1 <> ''")
    dist = rows.groupBy("admin_l1", "admin_l2").agg(
        F.count("*").alias("facility_count"), F.count_if(F.col("facility_type") == "phc").alias("phc_count"),
        F.count_if("is_demo_facility").alias("demo_count"), F.sum("population_served").alias("population_served"))
    sums = [F.sum(c).alias(c) for c in ("facility_count", "phc_count", "demo_count", "population_served")]
    cols = ["level", "state", "district", "facility_count", "phc_count", "district_count", "demo_count", "population_served"]
    state = (dist.groupBy(F.col("admin_l1").alias("state")).agg(*sums, F.count("admin_l2").alias("district_count"))
             .withColumn("level", F.lit("state")).withColumn("district", F.lit(None).cast("string")))
    district = (dist.filter("admin_l2 <> ''").withColumn("level", F.lit("district"))
                .withColumn("state", F.col("admin_l1")).withColumn("district", F.col("admin_l2"))
                .withColumn("district_count", F.lit(0).cast("bigint")))
    return state.select(*cols).unionByName(district.select(*cols))


def list_states(geo: DataFrame) -> DataFrame:
    return geo.filter("level = 'state'").select("state", "facility_count", "phc_count", "district_count")


def list_districts(geo: DataFrame, state: str | None = None, display: dict | None = None) -> DataFrame:
    """display: (state, DISTRICT) -> spelling to show; what is stored stays as it is."""
    rows = geo.filter("level = 'district'")
    if state:
        rows = rows.filter(F.col("state") == state)
    shown = F.col("district")
    for (s, d), name in (display or {}).items():
        shown = F.when((F.col("state") == s) & (F.upper(F.trim("district")) == d), name).otherwise(shown)
    return rows.select("state", "district", shown.alias("display_name"), "facility_count", "phc_count")


def facility_counts(geo: DataFrame, state: str | None = None, district: str | None = None) -> DataFrame:
    rows = geo.filter(F.col("level") == ("district" if district else "state"))
    if state:
        rows = rows.filter(F.col("state") == state)
    if district:
        rows = rows.filter(F.col("district") == district)
    n = F.count("*") if district else F.sum("district_count")
    return rows.agg(nvl0(F.sum("facility_count")).alias("facilities"), nvl0(F.sum("phc_count")).alias("phcs"),
                    nvl0(F.sum("demo_count")).alias("demo_facilities"),
                    nvl0(F.sum("population_served")).alias("population_served"),
                    F.count_distinct("state").alias("states"), nvl0(n).alias("districts"))


def national_summary(geo: DataFrame) -> DataFrame:
    st, di = F.col("level") == "state", F.col("level") == "district"
    return geo.agg(F.sum(F.when(st, F.col("facility_count"))).alias("facilities"), F.count_if(st).alias("states"),
                   F.count_if(di).alias("districts"),
                   F.count_distinct(F.when(di, F.col("district"))).alias("district_names"),
                   F.sum(F.when(st, F.col("demo_count"))).alias("demo_facilities"))


def scope_facilities(facilities: DataFrame, state: str | None = None, district: str | None = None,
                     facility_type: str = "phc", limit: int | None = None) -> DataFrame:
    rows = facilities.filter((F.col("country_code") == "IN") & (F.col("facility_type") == facility_type))
    if state:
        rows = rows.filter(F.col("admin_l1") == state)
    if district:
        rows = rows.filter(F.col("admin_l2") == district)
    return rows.orderBy("name", "facility_id").transform(upto, limit).select(
        "facility_id", "name", "admin_l1", "admin_l2", "latitude", "longitude", "population_served")


def get_facility(facilities: DataFrame, facility_id: str) -> DataFrame:
    return facilities.filter((F.col("country_code") == "IN") & (F.col("facility_id") == facility_id)).limit(1)


def population_reach(facilities: DataFrame, demand: DataFrame, census: int = CENSUS_RURAL) -> DataFrame:
    """Three nested tiers over rural health centres, each person counted once."""
    rural = (facilities.filter("country_code = 'IN' AND facility_type = 'phc' AND location_type = 'rural' "
                               "AND population_served IS NOT NULL")
             .withColumn("district_key", F.upper(F.trim("admin_l2"))))
    known = demand.select("admin_l1", "district_key").distinct().withColumn("_has", F.lit(True))
    tiers = F.array(F.when(F.col("is_forecast_facility"), F.lit(1)), F.when(F.col("_has"), F.lit(2)), F.lit(3))
    rows = (rural.join(known, ["admin_l1", "district_key"], "left")
            .withColumn("tier_order", F.explode(tiers)).filter("tier_order IS NOT NULL"))
    out = rows.groupBy("tier_order").agg(
        F.count("*").alias("phcs"), F.count_distinct("admin_l1").alias("states"),
        F.count_distinct("admin_l1", "admin_l2").alias("districts"), F.sum("population_served").alias("population"))
    names = F.array(F.lit("operating"), F.lit("demand_data_footprint"), F.lit("national_directory"))
    return out.select("tier_order", F.element_at(names, F.col("tier_order")).alias("tier"), "phcs", "states",
                      "districts", "population", to_long(ratio("population", "phcs")).alias("mean_catchment"),
                      rnd(F.lit(100.0) * F.col("population") / F.lit(float(census)), 2).alias("pct_of_census"))


def reach_check(facilities: DataFrame, census: int = CENSUS_RURAL, low: float = 0.80,
                high: float = 1.05) -> DataFrame:
    """Does the tiling land near the census, and the naive all-types sum beside it."""
    t, loc = F.col("facility_type"), F.col("location_type")
    pop = F.sum(F.when((t == "phc") & (loc == "rural"), F.col("population_served")))
    rows = facilities.filter("country_code = 'IN'").agg(
        pop.alias("rural_population"), F.sum("population_served").alias("naive_population"),
        F.count_if((t == "phc") & (loc == "urban")).alias("urban_phc"),
        F.count_if((t == "phc") & loc.isNull()).alias("phc_no_location"),
        F.count_if(t == "sub_cen").alias("sub_centres"), F.count_if(t == "chc").alias("chcs"),
        F.count_if(t.isin("dis_h", "s_t_h")).alias("hospitals"))
    r = ratio("rural_population", F.lit(float(census)))
    return rows.withColumn("tiles", r.between(low, high))


# -- waste and impact --------------------------------------------------------------------

def priced_expiry(ledger: DataFrame, items: DataFrame, prices: DataFrame) -> DataFrame:
    """Expired units by item with the first price whose key starts the item's name. The
    name is exploded into its own prefixes, so the prefix match is an equi-join."""
    expired = (ledger.filter("event_type = 'expired'").groupBy("item_id").agg(F.sum("quantity").alias("u"))
               .join(items, "item_id").groupBy(F.col("display_name").alias("item"), "unit")
               .agg(F.sum("u").alias("units")))
    heads = expired.withColumn("n", F.explode(F.sequence(F.lit(1), F.length("item")))).withColumn(
        "head", F.lower(F.expr("substring(item, 1, n)")))
    hit = (heads.join(prices.select(F.lower("item_match").alias("head"), "price", "ord"), "head")
           .groupBy("item", "unit").agg(F.min_by("price", "ord").alias("price")))
    return expired.join(hit, ["item", "unit"], "left").withColumn("value", rnd(F.col("units") * F.col("price"), 2))


def waste_value(priced: DataFrame, floor: float = 0.80) -> DataFrame:
    """Value of expiry; withheld when too little of it has a price."""
    rows = priced.agg(F.sum("units").alias("total_units"),
                      nvl0(F.sum(F.when(F.col("price").isNotNull(), F.col("units")))).alias("priced_units"),
                      rnd(sum4("value"), 2).alias("partial_value"))
    cover = ratio("priced_units", "total_units")
    return rows.select("total_units", "priced_units", "partial_value", rnd(cover, 4).alias("coverage"),
                       F.when(cover >= floor, rnd(F.col("partial_value") / cover, 2)).alias("headline_value"))


def impact_metrics(parts: DataFrame, new_part: DataFrame | None = None) -> DataFrame:
    """Sum of the parts; a part that is run again replaces its own rows."""
    if new_part is not None:
        parts = parts.join(new_part.select("part").distinct(), "part", "left_anti").unionByName(new_part)
    rows = parts.agg(F.max("as_of_date").alias("as_of_date"),
                     *[F.sum(c).alias(c) for c in ("units_dispensed", "units_unmet", "units_expired_fefo",
                                                   "units_expired_fifo")])
    saved = F.col("units_expired_fifo") - F.col("units_expired_fefo")
    return (rows.withColumn("unmet_share", rnd(ratio("units_unmet", F.col("units_dispensed") + F.col("units_unmet")), 4))
            .withColumn("waste_avoided_by_fefo_units", saved)
            .withColumn("waste_avoided_share", rnd(ratio(saved, "units_expired_fifo"), 4)))


REPLAY = ("facility_id string, item_id string, units_dispensed bigint, units_unmet bigint, "
          "units_expired_fefo bigint, units_expired_fifo bigint")


REPLAY_COLUMNS = ["facility_id", "item_id", "units_dispensed", "units_unmet", "units_expired_fefo",
                  "units_expired_fifo"]


def _walk(receipts, demand, end, by_expiry: bool):
    """One pair, one issuing rule. Days are integers; a batch whose expiry day has come is
    written off before anything is issued that day."""
    shelf, served, unmet, expired = [], 0, 0, 0
    i = 0
    for day, need in demand:
        while i < len(receipts) and receipts[i][0] <= day:
            got, exp, qty = receipts[i]
            heapq.heappush(shelf, ([exp, got] if by_expiry else [got, exp]) + [i, exp, qty])
            i += 1
        keep = []
        while need > 0 and shelf:
            lot = heapq.heappop(shelf)
            if lot[3] <= day:
                expired += lot[4]
                continue
            take = min(lot[4], need)
            lot[4] -= take
            need -= take
            served += take
            if lot[4]:
                keep.append(lot)
        for lot in keep:
            heapq.heappush(shelf, lot)
        unmet += need
    expired += sum(lot[4] for lot in shelf if lot[3] <= end)
    expired += sum(q for _, e, q in receipts[i:] if e <= end)
    return served, unmet, expired


def issue_policy_replay(ledger: DataFrame, never: int = 10 ** 6) -> DataFrame:
    """Replay receipts and demand under first-expiry and first-in issuing.

    Receipts are added up by day and expiry day and demand by day before they are grouped,
    so a pair's group is bounded by the calendar however many events it has.
    """
    day = F.unix_date(event_day())
    facts = (ledger.filter(F.col("event_type").isin("received", "dispensed"))
             .groupBy(*PAIR, day.alias("day"), (F.col("event_type") == "received").alias("is_receipt"),
                      F.when(F.col("event_type") == "received", F.coalesce(F.unix_date("expiry_date"), F.lit(never))).alias("exp"))
             .agg(F.sum("quantity").alias("qty")))
    last = ledger.agg(F.max(day)).scalar()
    facts = facts.withColumn("end", last)

    def replay(batches):
        for key, rows in sorted_groups(batches, 2):
            end = rows[0][6]
            receipts = [(r[2], r[4], r[5]) for r in rows if r[3]]
            demand = [(r[2], r[5]) for r in rows if not r[3]]
            a, b = _walk(receipts, demand, end, True), _walk(receipts, demand, end, False)
            yield (*key, a[0], a[1], a[2], b[2])

    cols = [*PAIR, "day", "is_receipt", "exp", "qty", "end"]
    return in_key_order(facts.select(*cols), PAIR, ["day", "exp"]).mapInPandas(as_frames(replay, REPLAY_COLUMNS), REPLAY)


# -- demand shape ------------------------------------------------------------------------

def _clean_baseline(demand: DataFrame) -> DataFrame:
    return (demand.filter(F.col("month").isin(*FISCAL[:9]))
            .groupBy(F.col("admin_l1").alias("state"), "district_key", "indicator")
            .agg(F.avg("value").alias("baseline")))


def demand_seasonality(demand: DataFrame, low: float = 0.25, high: float = 4.0) -> DataFrame:
    keys = ["state", "district_key", "indicator", "month"]
    months = F.explode(F.array(*[F.lit(m) for m in CALENDAR]))
    rows = _clean_baseline(demand).withColumn("month", months).join(
        demand.select(F.col("admin_l1").alias("state"), "district_key", "indicator", "month", "value"), keys, "left")
    m = F.when((F.col("month") == HELD_MONTH) | F.col("value").isNull() | (F.col("baseline") <= 0), F.lit(1.0)) \
        .otherwise(F.greatest(F.lit(low), F.least(F.lit(high), ratio("value", "baseline"))))
    return rows.select(*keys, m.alias("multiplier"))


def demand_scale(demand: DataFrame, facilities: DataFrame, floor_state: str | None = None,
                 floor_share: float = 0.5) -> DataFrame:
    """Monthly load per health centre; in one state a short register count is raised to a
    share of the state's mean."""
    phcs = (facilities.filter("country_code = 'IN' AND facility_type = 'phc'")
            .groupBy(F.col("admin_l1").alias("state"), F.upper(F.trim("admin_l2")).alias("district_key"))
            .agg(F.count("*").alias("phcs")))
    if floor_state:
        mean = phcs.filter(F.col("state") == floor_state).agg(F.bround(F.lit(floor_share) * F.avg("phcs")).cast("bigint")).scalar()
        phcs = phcs.withColumn("phcs", F.when(F.col("state") == floor_state, F.greatest("phcs", mean)).otherwise(F.col("phcs")))
    return (_clean_baseline(demand).join(phcs, ["state", "district_key"]).filter("baseline > 0")
            .select("state", "district_key", "indicator", (F.col("baseline") / F.col("phcs")).alias("per_phc"), "phcs"))


# -- text checks -------------------------------------------------------------------------

def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text in one spelling: 1,250, 1250 and 1250.0 are equal."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)*)"), 1)

    def norm(n):
        n = F.regexp_replace(n, ",", "")
        plain = n.rlike(r"^\d+(\.\d+)?$")
        head = F.regexp_replace(n, r"^0+(\d)", "$1")
        tail = F.when(head.contains("."), F.regexp_replace(head, r"(\.\d*?)0+$", "$1")).otherwise(head)
        return F.when(plain, F.regexp_replace(tail, r"\.$", "")).otherwise(n)
    return F.array_distinct(F.transform(found, norm))


def number_check(notes: DataFrame, text: str = "text", facts: str = "facts") -> DataFrame:
    """Numbers a note mentions that its facts do not contain."""
    foreign = F.array_except(numbers_in(F.col(text)), numbers_in(F.col(facts)))
    return (notes.withColumn("_f", foreign).drop(text, facts)
            .withColumn("foreign_numbers", F.size("_f"))
            .withColumn("first_foreign", F.array_min("_f"))
            .withColumn("numbers_checked", F.size("_f") == 0).drop("_f"))


# Fixed value: what a scanned code may look like.
CODE = r"^[0-9A-Za-z.\-]{4,64}$"


def code_lookup(teachings: DataFrame, scans: DataFrame, items: DataFrame) -> DataFrame:
    """Scanned code to item; the latest teaching of a code wins, and the item must exist."""
    known = items.select("item_id", F.col("display_name").alias("item_name"), "unit")
    taught = (teachings.withColumn("code", F.trim("code")).filter(F.col("code").rlike(CODE))
              .join(known.select("item_id"), "item_id", "left_semi")
              .groupBy("code").agg(F.max_by("item_id", F.struct("taught_at", "teaching_id")).alias("item_id")))
    return (scans.withColumn("code", F.trim("code")).filter(F.col("code").rlike(CODE))
            .join(taught, "code", "left").join(known, "item_id", "left"))


def sms_parse(messages: DataFrame, column: str = "message", prefix: str = "IN-") -> DataFrame:
    """The first word is the facility id, the rest is the report."""
    t = F.trim(F.regexp_replace(F.col(column), r"\s+", " "))
    head = F.upper(F.regexp_extract(t, r"^(\S+)", 1))
    body = F.regexp_extract(t, r"^\S+ (.+)$", 1)
    ok = head.startswith(prefix) & (body != "")
    return messages.withColumn("facility_id", F.when(ok, head)).withColumn("body", F.when(ok, body)) \
        .withColumn("error", F.when(~ok, "no facility id")).drop(column)


def extraction_score(routed: DataFrame, expected: DataFrame, held: DataFrame, asked: DataFrame,
                     accept: DataFrame) -> DataFrame:
    """Per case: rows written, items held and items requested against what was expected.
    ``accept`` maps (case, item, event) to the event it may stand for."""
    def bag(df, where, cols, name):
        rows = df.filter(where) if where is not None else df
        return rows.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))

    def canon(df):
        return (df.join(accept, ["case_id", "item_id", "event_type"], "left")
                .withColumn("event_type", F.coalesce("stands_for", "event_type")).drop("stands_for"))

    def item_set(df, where, name):
        rows = df.filter(where) if where is not None else df
        return rows.filter("item_id IS NOT NULL").groupBy("case_id").agg(F.sort_array(F.collect_set("item_id")).alias(name))

    triple = ["item_id", "event_type", "quantity"]
    cases = routed.select("case_id").union(expected.select("case_id")).distinct()
    parts = [bag(canon(routed.filter("route = 'events'")), None, triple, "got"),
             bag(canon(expected), None, triple, "want"),
             item_set(routed, "route = 'review'", "got_held"), item_set(held, None, "want_held"),
             item_set(routed, "route = 'requests'", "got_asked"), item_set(asked, None, "want_asked")]
    for p in parts:
        cases = cases.join(p, "case_id", "left")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    return cases.select("case_id", (same("got", "want") & same("got_held", "want_held")
                                    & same("got_asked", "want_asked")).alias("passed"))


def score_rate(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"),
                      share(F.count_if("passed"), F.count("*"), 1).alias("pass_rate"))
