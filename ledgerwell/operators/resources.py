"""Beds and staff (I1-I11) and the bed norm."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.months import CALENDAR
from ..functions.num import nvl0, ratio, rnd, share, to_long
from ..plans.listing import upto
from ..plans.near import near_pairs
from ..plans.snapshot import snapshot
from .plan import valid_coordinates
from .stock import event_day, mean4, sum4

# State spellings of the staffing source, and columns that must not leak.
STATE_ALIASES = {
    "A & N Islands": "Andaman & Nicobar Islands",
    "Andhra Pradesh Old": "Andhra Pradesh",
    "Dadra & Nagar Haveli": "Dadra & Nagar Haveli and Daman & Diu",
    "Daman & Diu": "Dadra & Nagar Haveli and Daman & Diu",
}
GENERATED_COLUMNS = ("mean_present", "attendance_vs_sanctioned", "days_none_present",
                     "days_reported", "status")
STAFF_ITEMS = {"Doctor (allopathic)": "STAFF-DOCTOR", "Nursing staff": "STAFF-NURSE",
               "Pharmacist": "STAFF-PHARMACIST"}
STAFF_AS_OF = "2022-03-31"
AVERAGE_STAY, DAY_CARE_TURNOVER = 1.8, 3.0


def bed_norm(facilities: DataFrame, essential: int = 2, desirable: int = 4,
             beds_per_nurse: int = 6) -> DataFrame:
    """Beds by the norm for health centres; whether a centre runs day and night is not
    known and stays NULL."""
    phc = (F.col("country_code") == "IN") & (F.col("facility_type") == "phc")
    beds = essential + desirable
    only = lambda c: F.when(phc, c)
    return facilities.select(
        "*", only(F.lit(beds)).cast("bigint").alias("bed_capacity"),
        only(F.lit(essential)).cast("bigint").alias("bed_capacity_essential"),
        only(F.lit(desirable)).cast("bigint").alias("bed_capacity_desirable"),
        only(F.lower("location_type") == "urban").alias("beds_are_day_care"),
        F.lit(None).cast("boolean").alias("is_24x7"),
        only(F.ceil(F.lit(beds) / F.lit(beds_per_nurse))).cast("bigint").alias("nurses_required"))


def bed_status(events: DataFrame, facilities: DataFrame, window_days: int = 30,
               pressure: float = 0.80) -> DataFrame:
    """Occupancy over the last days of the bed ledger itself."""
    beds = events.filter("resource_type = 'bed'")
    today = beds.agg(F.max(event_day())).scalar()
    occ = F.when(F.col("event_type") == "occupancy", F.col("quantity"))
    recent = (beds.filter(event_day() > F.date_sub(today, window_days)).groupBy("facility_id").agg(
        F.min("item_id").alias("bed_type"), F.min("capacity").alias("cap"),
        F.avg(occ).alias("mean_raw"), F.max(occ).alias("peak_occupied"),
        F.sum(F.when(F.col("event_type") == "turned_away", F.col("quantity")).otherwise(0)).alias("turned_away"),
        F.count(occ).alias("days_reported")))
    rate = ratio("mean_raw", "cap")
    cap = to_long("cap")
    rows = recent.join(facilities, "facility_id").withColumn("as_of_date", today)
    return rows.select(
        "facility_id", F.col("name").alias("facility_name"), F.col("admin_l1").alias("state"),
        F.col("admin_l2").alias("district"), "latitude", "longitude", "bed_type", "beds_are_day_care",
        cap.alias("bed_capacity"), rnd("mean_raw", 2).alias("mean_occupied"), "peak_occupied",
        rnd(rate, 3).alias("occupancy_rate"),
        F.when(F.col("mean_raw").isNotNull(), F.greatest(cap - to_long("mean_raw"), F.lit(0).cast("bigint"))).alias("free_beds"),
        "turned_away", "days_reported",
        F.when(F.col("turned_away") > 0, "over_capacity").when(rate >= pressure, "under_pressure")
         .otherwise("has_capacity").alias("status"), "as_of_date")


def bed_referrals(status: DataFrame, max_km: float = 50.0, k: int = 3) -> DataFrame:
    """The k nearest centres with a free overnight bed, first inside a small circle and
    only then, for centres with fewer than k, inside the whole one."""
    placed = status.filter(valid_coordinates())
    full = placed.filter("status IN ('over_capacity', 'under_pressure')").select(
        F.col("facility_id").alias("from_facility_id"), "state", "district",
        F.col("bed_capacity").alias("from_capacity"), F.col("occupancy_rate").alias("from_occupancy_rate"),
        F.col("turned_away").alias("from_turned_away"), F.col("status").alias("from_status"),
        F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))
    free = placed.filter("status = 'has_capacity' AND free_beds > 0 AND NOT beds_are_day_care").select(
        F.col("facility_id").alias("to_facility_id"), F.col("facility_name").alias("to_facility_name"),
        F.col("free_beds").alias("to_free_beds"), F.col("occupancy_rate").alias("to_occupancy_rate"),
        F.col("latitude").alias("b_lat"), F.col("longitude").alias("b_lon"))
    order = Window.partitionBy("from_facility_id").orderBy("km", "to_facility_id")

    def within(rows, radius):
        pairs = near_pairs(rows, free, radius, ("p_lat", "p_lon"), ("b_lat", "b_lon"), on=[])
        return (pairs.filter("to_facility_id <> from_facility_id")
                .withColumn("referral_rank", F.row_number().over(order)).filter(F.col("referral_rank") <= k)
                .drop("p_lat", "p_lon", "b_lat", "b_lon", "km"))

    near = within(full, max_km / 4)
    done = near.groupBy("from_facility_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("from_facility_id")
    near = snapshot(near.join(done, "from_facility_id", "left_semi"), "i2-near")
    rest = full.join(near.select("from_facility_id").distinct(), "from_facility_id", "left_anti")
    return near.unionByName(within(rest, max_km))


def bed_summary(status: DataFrame) -> DataFrame:
    st = F.col("status")
    return status.agg(
        F.count("*").alias("facilities"), F.sum("bed_capacity").alias("total_beds"),
        F.sum(F.when(~F.col("beds_are_day_care"), F.col("bed_capacity")).otherwise(0)).alias("overnight_beds"),
        rnd(sum4("mean_occupied"), 1).alias("beds_occupied"),
        rnd(mean4("occupancy_rate") * F.lit(100.0), 1).alias("mean_occupancy_pct"),
        F.sum("free_beds").alias("free_beds"), F.sum("turned_away").alias("turned_away_30d"),
        F.count_if(st == "has_capacity").alias("has_capacity"),
        F.count_if(st == "under_pressure").alias("under_pressure"),
        F.count_if(st == "over_capacity").alias("over_capacity"), F.max("as_of_date").alias("as_of"))


def bed_list(status: DataFrame, limit: int | None = None) -> DataFrame:
    return (status.orderBy(F.desc("turned_away"), F.desc_nulls_last("occupancy_rate"), "facility_id")
            .transform(upto, limit).select("facility_id", "facility_name", "state", "district", "bed_type",
                                 "bed_capacity", "mean_occupied", "occupancy_rate", "free_beds",
                                 "turned_away", "status"))


# -- staff -------------------------------------------------------------------------------

def _alias_state(col: str):
    out = F.col(col)
    for k, v in STATE_ALIASES.items():
        out = F.when(F.col(col) == k, v).otherwise(out)
    return out


def facility_staffing(staffing: DataFrame, facilities: DataFrame) -> DataFrame:
    """State posts spread over the facilities of the right type, in whole posts. The type
    list is exploded first, so the join is on (state, type)."""
    fac = (facilities.filter("country_code = 'IN' AND facility_type IN ('phc', 'chc')")
           .withColumn("staffing_state", _alias_state("admin_l1")))
    counts = fac.groupBy(F.col("staffing_state").alias("state")).agg(
        F.count_if(F.col("facility_type") == "phc").alias("phc"), F.count("*").alias("both"))
    one = F.size("applies_to_facility_types") == 1
    posts = (staffing.join(counts, "state")
             .withColumn("den", F.when(one, F.col("phc")).otherwise(F.col("both")))
             .withColumn("s_per", ratio("sanctioned", "den")).withColumn("p_per", ratio("in_position", "den"))
             .withColumn("facility_type", F.explode("applies_to_facility_types"))
             .select(F.col("state").alias("staffing_state"), "facility_type", "cadre", "den", "s_per", "p_per",
                     "vacancy_rate", (F.col("in_position") > F.col("sanctioned")).alias("over")))
    whole = F.greatest(F.lit(1).cast("bigint"), to_long("s_per"))
    filled = F.greatest(F.lit(0).cast("bigint"), to_long("p_per"))
    return (fac.filter("is_forecast_facility").join(posts, ["staffing_state", "facility_type"]).select(
        "facility_id", F.col("name").alias("facility_name"), F.col("admin_l1").alias("state"),
        F.col("admin_l2").alias("district"), "facility_type", "bed_capacity", "cadre",
        F.col("den").alias("facilities_sharing_these_posts"), rnd("s_per", 3).alias("sanctioned_per_facility"),
        rnd("p_per", 3).alias("in_position_per_facility"), "vacancy_rate", whole.alias("sanctioned_posts"),
        F.when(F.col("over"), filled).otherwise(F.least(whole, filled)).alias("expected_in_position"),
        F.when(F.col("cadre") == "Nursing staff", F.col("nurses_required")).alias("nurses_required_by_beds")))


def staffing_norm_gap(fs: DataFrame) -> DataFrame:
    rows = fs.filter("cadre = 'Nursing staff' AND nurses_required_by_beds IS NOT NULL")
    return rows.agg(
        F.count("*").alias("facilities"),
        rnd(ratio(F.sum("sanctioned_posts"), F.count("*")), 2).alias("avg_sanctioned"),
        rnd(ratio(F.sum("nurses_required_by_beds"), F.count("*")), 2).alias("avg_required_by_beds"),
        F.count_if(F.col("sanctioned_posts") < F.col("nurses_required_by_beds")).alias("under_norm"))


def staff_status(fs: DataFrame, facilities: DataFrame) -> DataFrame:
    item = F.coalesce(*[F.when(F.col("cadre") == c, i) for c, i in STAFF_ITEMS.items()])
    short = F.greatest(F.col("nurses_required") - F.col("expected_in_position"), F.lit(0).cast("bigint"))
    at = facilities.filter("is_forecast_facility").select("facility_id", "latitude", "longitude", "nurses_required")
    return fs.join(at, "facility_id").select(
        "facility_id", "facility_name", "state", "district", "latitude", "longitude", "bed_capacity",
        "nurses_required", item.alias("item_id"), "cadre", "sanctioned_posts", "expected_in_position",
        "vacancy_rate",
        F.when((F.col("cadre") == "Nursing staff") & F.col("nurses_required").isNotNull(), short).alias("nurses_short_of_bed_norm"),
        F.lit(STAFF_AS_OF).cast("date").alias("as_of_date"))


def weighted_vacancy():
    """Vacancy weighted by posts; rows without a rate leave both sums."""
    return ratio(sum4(F.col("vacancy_rate") * F.col("sanctioned_posts")),
                 F.sum(F.when(F.col("vacancy_rate").isNull(), 0).otherwise(F.col("sanctioned_posts"))))


def staff_summary(staff: DataFrame) -> DataFrame:
    return staff.agg(
        F.count_distinct("facility_id").alias("facilities"), F.count_distinct("state", "cadre").alias("roles"),
        F.sum("sanctioned_posts").alias("sanctioned_posts"),
        rnd(F.lit(100.0) * weighted_vacancy(), 1).alias("vacancy_pct"),
        F.count_if(F.col("vacancy_rate").isNull()).alias("no_figure"),
        F.sum("nurses_short_of_bed_norm").alias("nurses_short_of_bed_norm"), F.max("as_of_date").alias("as_of"))


def staff_by_cadre(staff: DataFrame) -> DataFrame:
    return staff.groupBy("cadre", "item_id").agg(
        F.count("*").alias("facilities"), F.sum("sanctioned_posts").alias("sanctioned_posts"),
        rnd(F.lit(100.0) * weighted_vacancy(), 1).alias("vacancy_pct"))


def staff_list(staff: DataFrame, limit: int | None = None) -> DataFrame:
    return (staff.orderBy(F.desc_nulls_last("vacancy_rate"), "facility_name", "cadre").transform(upto, limit)
            .select("facility_id", "facility_name", "state", "district", "cadre", "item_id",
                    "sanctioned_posts", "vacancy_rate", "nurses_short_of_bed_norm", "bed_capacity",
                    "nurses_required"))


def staff_reallocation_diag(staff: DataFrame) -> DataFrame:
    """Cadres with at most one post anywhere have nobody to lend."""
    per = staff.groupBy("cadre").agg(F.max("sanctioned_posts").alias("most"), F.sum("sanctioned_posts").alias("posts"))
    single = F.col("most") <= 1
    return per.agg(
        F.count("*").alias("cadres"), F.sum("posts").alias("sanctioned_posts"),
        F.count_if(single).alias("single_post_cadres"),
        F.sum(F.when(single, F.col("posts")).otherwise(0)).alias("posts_in_single_post_cadres"),
        F.array_join(F.sort_array(F.collect_set(F.when(~single, F.col("cadre")))), ", ").alias("donor_cadres"))


def resource_coverage(events: DataFrame, staff: DataFrame) -> DataFrame:
    a = events.groupBy("resource_type").agg(
        F.count("*").alias("events"), F.count_distinct("facility_id").alias("facilities"),
        F.count_distinct("item_id").alias("resources"))
    b = staff.agg(F.lit("establishment").alias("resource_type"), F.count("*").alias("events"),
                  F.count_distinct("facility_id").alias("facilities"),
                  F.count_distinct("cadre").alias("resources"))
    return a.unionByName(b)


def leaked_columns(df: DataFrame, forbidden=GENERATED_COLUMNS) -> list[str]:
    return sorted(set(df.columns) & set(forbidden))


def leaked_column_check(df: DataFrame, forbidden=GENERATED_COLUMNS) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(leaked_columns(df, forbidden))).alias("leaked_columns"))


def bed_demand(scale: DataFrame, seasonality: DataFrame, facilities: DataFrame,
               admission_share: float = 1.0, stay_days: float = AVERAGE_STAY,
               turnover: float = DAY_CARE_TURNOVER) -> DataFrame:
    """Beds needed per facility and month from observed admissions, capped at capacity.

    scale: state, district_key, monthly admissions per centre; seasonality: multiplier by
    month. The excess over capacity is turned away.
    """
    days = F.element_at(F.array(*[F.lit(n) for n in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]),
                        F.array_position(F.array(*[F.lit(m) for m in CALENDAR]), F.col("month")).cast("int"))
    fac = facilities.filter("bed_capacity > 0").select(
        "facility_id", F.col("admin_l1").alias("state"), F.upper(F.trim("admin_l2")).alias("district_key"),
        "bed_capacity", F.coalesce("beds_are_day_care", F.lit(False)).alias("day_care"))
    key = ["state", "district_key"]
    rows = fac.join(scale, key).join(seasonality, key)
    daily = F.col("admissions") * F.lit(admission_share) * F.col("multiplier") / days
    need = F.when(F.col("day_care"), daily / F.lit(turnover)).otherwise(daily * F.lit(stay_days))
    return rows.select(
        "facility_id", "month", "bed_capacity", rnd(need, 3).alias("beds_needed"),
        rnd(F.least(need, F.col("bed_capacity").cast("double")), 3).alias("occupied"),
        rnd(F.greatest(need - F.col("bed_capacity"), F.lit(0.0)), 3).alias("turned_away"))
