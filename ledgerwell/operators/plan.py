"""Demand, lead time and reorder points."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.num import nvl0, ratio, rnd, to_long
from .stock import PAIR, _units, as_of_date, event_day, mean4, sum4

SERVICE_Z = 1.65
HORIZON = 30
MIN_DAYS = 180
MAX_SERIES = 5000
FLAT_DAYS = 14


def training_set(ledger: DataFrame, facilities: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """Daily dispensed units of the series with enough distinct event days (of any
    kind). The ledger is combined per pair and day before anything is joined to it, and read once."""
    wanted = facilities.filter("is_forecast_facility").select("facility_id")
    daily = (ledger.groupBy(*PAIR, event_day().alias("day"))
             .agg(_units("dispensed").alias("quantity"),
                  F.count_if(F.col("event_type") == "dispensed").alias("n"))
             .join(wanted, "facility_id", "left_semi"))
    days = F.count("*").over(Window.partitionBy(*PAIR))
    return (daily.filter("item_id IS NOT NULL").withColumn("days", days)
            .filter((F.col("days") >= min_days) & (F.col("n") > 0))
            .select(*PAIR, "day", "quantity"))


def training_preflight(training: DataFrame, max_series: int = MAX_SERIES) -> DataFrame:
    per = training.groupBy(*PAIR).agg(F.count("*").alias("rows"), F.min("day").alias("a"), F.max("day").alias("b"))
    return per.agg(F.count("*").alias("series"), F.sum("rows").alias("rows_in"),
                   F.min("a").alias("first_day"), F.max("b").alias("last_day"),
                   (F.count("*") > max_series).alias("over_ceiling"))


def weekday_forecast(training: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Default forecaster: the mean of the same weekday, else of all days."""
    last = training.agg(F.max("day").alias("d")).scalar()
    by_day = training.groupBy(*PAIR, F.dayofweek("day").alias("dow")).agg(
        F.sum("quantity").alias("q"), F.count("*").alias("n"))
    series = by_day.groupBy(*PAIR).agg(
        F.map_from_entries(F.collect_list(F.struct("dow", ratio("q", "n")))).alias("by_dow"),
        ratio(F.sum("q"), F.sum("n")).alias("mean"))
    ahead = series.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ahead = ahead.withColumn("day", F.date_add(last, F.col("h")))
    value = F.coalesce(F.element_at("by_dow", F.dayofweek("day")), F.col("mean"))
    return ahead.select(*PAIR, "day", rnd(value, 4).alias("value"))


def demand_baseline(forecast: DataFrame, ledger: DataFrame) -> DataFrame:
    d = forecast.groupBy(*PAIR).agg(mean4("value").alias("m"))
    o = (ledger.filter(F.col("event_type") == "dispensed").groupBy(*PAIR)
         .agg(F.stddev_samp("quantity").alias("sd"), F.count("*").alias("observed_days")))
    return d.join(o, PAIR, "left").select(
        *PAIR, rnd("m", 2).alias("avg_daily_demand"),
        rnd(F.coalesce("sd", F.lit(0.0)), 2).alias("demand_std_dev"), "observed_days")


def stock_on_hand(stock: DataFrame) -> DataFrame:
    return stock.groupBy(*PAIR).agg(
        F.sum("remaining_qty").alias("on_hand"), F.min("expiry_date").alias("soonest_expiry"),
        F.min("days_to_expiry").alias("days_to_soonest_expiry"))


def reorder_threshold(mu, sd, lead, z: float = SERVICE_Z) -> Column:
    """Demand over the lead time plus the safety stock."""
    return mu * lead + F.lit(z) * sd * F.sqrt(lead.cast("double"))


def ven_weight(col="ven_class") -> Column:
    return F.when(F.col(col) == "Vital", 3.0).when(F.col(col) == "Essential", 2.0).otherwise(1.0)


def ven_rank(col="ven_class") -> Column:
    return F.when(F.col(col) == "Vital", 1).when(F.col(col) == "Essential", 2).otherwise(3)


def reorder_status(baseline: DataFrame, facilities: DataFrame, items: DataFrame,
                   stock: DataFrame, z: float = SERVICE_Z, flat_days: int = FLAT_DAYS,
                   class_chars: int = 5) -> DataFrame:
    return status_of(baseline, facilities, items, stock_on_hand(stock), z, flat_days, class_chars)


def status_of(baseline: DataFrame, facilities: DataFrame, items: DataFrame, on_hand: DataFrame, z: float = SERVICE_Z,
              flat_days: int = FLAT_DAYS, class_chars: int = 5) -> DataFrame:
    """The lines of the plan for what the pairs have on hand."""
    fac = (facilities.filter("is_forecast_facility AND lead_time_days IS NOT NULL")
           .select("facility_id", F.col("name").alias("facility_name"),
                   F.col("admin_l1").alias("state"), F.col("admin_l2").alias("district"),
                   "lead_time_days", "distance_to_hq_km", "lead_time_is_estimated"))
    it = items.select("item_id", F.col("display_name").alias("item_name"), "unit", "ven_class",
                      "atc_code", F.substring("atc_code", 1, class_chars).alias("atc_class"))
    mu, sd, lead = F.col("avg_daily_demand"), F.col("demand_std_dev"), F.col("lead_time_days")
    limit = reorder_threshold(mu, sd, lead, z)
    held, cover = F.col("on_hand"), ratio("on_hand", "avg_daily_demand")
    rows = (baseline.join(fac, "facility_id").join(it, "item_id")
            .join(on_hand, PAIR, "left")
            .withColumn("on_hand", nvl0("on_hand")))
    return rows.select(
        "facility_id", "facility_name", "state", "district", "lead_time_days",
        "distance_to_hq_km", "lead_time_is_estimated", "item_id", "item_name", "unit",
        "ven_class", "atc_code", "atc_class", "on_hand", "soonest_expiry",
        "days_to_soonest_expiry", "avg_daily_demand", "demand_std_dev",
        rnd(F.lit(z) * sd * F.sqrt(lead.cast("double")), 1).alias("safety_stock"),
        rnd(limit, 1).alias("reorder_point"),
        rnd(mu * F.lit(float(flat_days)), 1).alias("legacy_threshold"),
        rnd(cover, 1).alias("days_of_cover"),
        (held <= limit).alias("needs_reorder"),
        rnd(ven_weight() * F.greatest(F.lit(0.0), F.lit(1.0) - ratio(held, limit)), 3).alias("priority_score"),
        F.when(held <= 0, "stocked_out").when(cover <= lead, "critical")
         .when(held <= limit, "reorder").otherwise("ok").alias("status"),
        "observed_days")


def reorder_summary(rs: DataFrame) -> DataFrame:
    need = F.col("needs_reorder")
    over = F.col("on_hand") > F.col("legacy_threshold")
    return rs.agg(
        F.count("*").alias("tracked_series"), F.count_if(need).alias("open_alerts"),
        F.count_if(F.col("status") == "stocked_out").alias("stocked_out"),
        F.count_if(F.col("status") == "critical").alias("critical"),
        F.count_if(need & (F.col("ven_class") == "Vital")).alias("vital_alerts"),
        rnd(mean4("reorder_point"), 1).alias("avg_reorder_point"),
        rnd(mean4("legacy_threshold"), 1).alias("avg_legacy"),
        F.count_if(need & over).alias("caught_only_by_new_rule"),
        F.count_if(~need & ~over).alias("flagged_only_by_old_rule"),
        F.count_distinct("facility_id").alias("facilities"),
        F.count_distinct("item_id").alias("items"))


# -- lead time ---------------------------------------------------------------------------

def valid_coordinates(box=(6, 38, 68, 98)) -> Column:
    """Inside the box; flagged, never corrected."""
    return F.coalesce(F.col("latitude").between(box[0], box[1])
                      & F.col("longitude").between(box[2], box[3]), F.lit(False))


def lead_time(facilities: DataFrame, base: int = 7, per_km: float = 0.08, low: int = 7,
              high: int = 30, max_km: int = 200, fallback_km: float = 25.0,
              cycle_days: int = 30) -> DataFrame:
    """Distance to the district's supplying hospital, and the lead time it implies."""
    place = ["admin_l1", "admin_l2"]
    fac = facilities.withColumn("has_valid_coords", valid_coordinates())
    valid = fac.filter("has_valid_coords")
    centre = valid.groupBy(*place).agg(mean4("latitude").alias("c_lat"), mean4("longitude").alias("c_lon"))
    rank = (F.when(F.col("facility_type") == "dis_h", 1).when(F.col("facility_type") == "s_t_h", 2)
            .otherwise(3))
    # One struct minimum per district: combined on the map side, no sort of a district.
    hq = (valid.filter(F.col("facility_type").isin("dis_h", "s_t_h", "chc"))
          .join(centre, place)
          .groupBy(*place).agg(F.min(F.struct(
              rank.alias("r"), haversine_km("latitude", "longitude", "c_lat", "c_lon").alias("km"),
              F.col("facility_id").alias("id"), F.col("latitude").alias("lat"),
              F.col("longitude").alias("lon"))).alias("hq"))
          .select(*place, F.col("hq.id").alias("district_hq_id"), "hq.lat", "hq.lon"))
    raw = (valid.select("facility_id", *place, "latitude", "longitude").join(hq, place)
           .withColumn("raw_km", rnd(haversine_km("latitude", "longitude", "lat", "lon"), 1)))
    # Plausible distances have at most max_km * 10 distinct values, which bounds the buffer.
    middle = (raw.filter(F.col("raw_km") <= max_km).groupBy(*place)
              .agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY raw_km)").alias("median_km")))
    far = F.col("raw_km") > max_km
    km = F.when(far, F.coalesce("median_km", F.lit(fallback_km))).otherwise(F.col("raw_km"))
    resolved = (raw.join(middle, place, "left")
                .select("facility_id", "district_hq_id", km.alias("distance_to_hq_km"),
                        far.alias("lead_time_is_estimated"),
                        F.least(F.lit(high), F.greatest(F.lit(low), to_long(
                            F.lit(float(base)) + F.lit(per_km) * km))).alias("lead_time_days"),
                        F.lit(cycle_days).cast("bigint").alias("indent_cycle_days")))
    return fac.join(resolved, "facility_id", "left")


def lead_time_verify(facilities: DataFrame) -> DataFrame:
    f = facilities.filter("is_forecast_facility")
    return f.agg(
        F.count("*").alias("forecast_facilities"),
        F.count_if(F.col("lead_time_days").isNull()).alias("missing_lead_time"),
        F.min("lead_time_days").alias("min_lead"), F.max("lead_time_days").alias("max_lead"),
        rnd(ratio(F.sum("lead_time_days"), F.count("lead_time_days")), 1).alias("avg_lead"),
        F.min("distance_to_hq_km").alias("min_km"), F.max("distance_to_hq_km").alias("max_km"),
        F.count_if("lead_time_is_estimated").alias("estimated"))


def lead_time_contrast(rs: DataFrame, z: float = SERVICE_Z) -> DataFrame:
    """The nearest and furthest facility for the busiest item; empty when they are the
    same. The far one's reorder point is also computed at the near lead time."""
    busiest = (rs.groupBy("item_id").agg(F.count("*").alias("n"))
               .orderBy(F.desc("n"), "item_id").limit(1).select("item_id"))
    rows = (rs.filter("avg_daily_demand > 0 AND NOT lead_time_is_estimated")
            .join(busiest, "item_id", "left_semi"))
    tail = ("facility_id", "facility_name", "item_name", "unit", "ven_class", "lead_time_days",
            "avg_daily_demand", "demand_std_dev", "reorder_point", "legacy_threshold")
    near = F.min(F.struct("distance_to_hq_km", *tail)).alias("n")
    far = F.min(F.struct((-F.col("distance_to_hq_km")).alias("neg"), "distance_to_hq_km", *tail)).alias("f")
    pair = rows.agg(near, far).filter("n.facility_id <> f.facility_id")
    if_near = reorder_threshold(F.col("f.avg_daily_demand"), F.col("f.demand_std_dev"),
                                F.col("n.lead_time_days"), z)
    return pair.select(
        F.col("n.item_name").alias("item_name"), F.col("n.unit").alias("unit"),
        F.col("n.facility_id").alias("near_facility_id"), F.col("f.facility_id").alias("far_facility_id"),
        F.col("n.distance_to_hq_km").alias("near_km"), F.col("f.distance_to_hq_km").alias("far_km"),
        F.col("n.lead_time_days").alias("near_lead"), F.col("f.lead_time_days").alias("far_lead"),
        F.col("f.reorder_point").alias("far_reorder_point"),
        rnd(if_near, 1).alias("far_reorder_if_near"),
        rnd(F.col("f.reorder_point") - if_near, 1).alias("extra_units_from_distance"),
        (F.col("f.lead_time_days") - F.col("n.lead_time_days")).alias("extra_lead_days"),
        rnd(F.col("f.reorder_point") - F.col("f.legacy_threshold"), 1).alias("flat_rule_shortfall"))


# -- reads -------------------------------------------------------------------------------

def pick_series(ledger: DataFrame, facilities: DataFrame, items: DataFrame) -> DataFrame:
    """The busiest facility-item in scope."""
    fac = facilities.filter("is_forecast_facility").select("facility_id", F.col("name").alias("facility_name"))
    it = items.select("item_id", F.col("display_name").alias("item_name"), "unit")
    return (ledger.groupBy(*PAIR).agg(F.sum("quantity").alias("total"))
            .join(fac, "facility_id").join(it, "item_id")
            .orderBy(F.desc("total"), *PAIR).limit(1)
            .select(*PAIR, "facility_name", "item_name", "unit", "total"))


def forecast_series(ledger: DataFrame, forecast: DataFrame, series: DataFrame,
                    history_days: int = 30, horizon: int = 7, train_end=None) -> DataFrame:
    """History up to ``train_end`` (the last seed day when not given), then the forecast;
    the last observed point is in both columns so that the two lines meet."""
    end = (F.lit(train_end).cast("date") if train_end else
           ledger.filter("source = 'seed'").agg(F.max(event_day())).scalar())
    key = series.select(*PAIR)
    hist = (ledger.filter("event_type = 'dispensed'").join(key, PAIR, "left_semi")
            .groupBy(event_day().alias("day")).agg(F.sum("quantity").alias("historical"))
            .filter((F.col("day") > F.date_sub(end, history_days)) & (F.col("day") <= end)))
    last = Window.partitionBy(F.lit(1)).orderBy(F.desc("day"))   # at most history_days rows
    hist = hist.withColumn("forecast", F.when(F.row_number().over(last) == 1, F.col("historical").cast("double")))
    pred = (forecast.join(key, PAIR, "left_semi").orderBy("day").limit(horizon)
            .select("day", F.lit(None).cast("bigint").alias("historical"), rnd("value", 1).alias("forecast")))
    return hist.select("day", "historical", "forecast").unionByName(pred)


def threshold_alert(rows: DataFrame, threshold_days: int = 14) -> DataFrame:
    """Lines under the flat threshold; zero demand means endless cover, no alert."""
    cover = ratio("on_hand", "avg_daily_demand")
    return rows.filter(F.col("avg_daily_demand") > 0).filter(cover < threshold_days).select(
        *PAIR, rnd(cover, 1).alias("days_of_cover"), F.lit(threshold_days).alias("threshold"),
        F.lit("active").alias("status"), rnd("avg_daily_demand", 2).alias("daily_demand"))


def model_chain(forecast: DataFrame, rs: DataFrame, recs: DataFrame) -> DataFrame:
    def step(order, name, df, value):
        return df.agg(value.alias("figure")).select(
            F.lit(order).alias("step_order"), F.lit(name).alias("step"), "figure")
    series = forecast.select(*PAIR).distinct()
    out = step(1, "series", series, F.count("*"))
    for part in (step(2, "lines", rs, F.count("*")),
                 step(3, "facilities", rs, F.count_distinct("facility_id")),
                 step(4, "shortages", rs, F.count_if("needs_reorder")),
                 step(5, "moves", recs, F.count("*"))):
        out = out.unionByName(part)
    return out


