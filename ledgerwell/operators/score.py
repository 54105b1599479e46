"""Scorecards, comparisons and the map."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import nvl0, ratio, rnd, share, to_long
from ..plans.listing import upto
from ..plans.one_row import beside
from ..plans.ranks import counted, holds
from .plan import ven_rank
from .resources import weighted_vacancy
from .stock import mean4, sum4

TOP = 10
MIN_LINES = 8
MULTIPLIER = 3.0
FRAGILE = 35.0


def scorecard(rs: DataFrame) -> DataFrame:
    need, vital = F.col("needs_reorder"), F.col("ven_class") == "Vital"
    return rs.agg(
        F.count("*").alias("tracked"), F.count_if(~need).alias("available"), F.count_if(need).alias("short"),
        F.count_if(F.col("status") == "stocked_out").alias("stocked_out"),
        F.count_if(vital).alias("vital_tracked"), F.count_if(vital & ~need).alias("vital_available"),
        F.count_if(vital & need).alias("vital_short"),
        F.count_if((F.col("on_hand") <= 0) | (F.col("days_of_cover") <= 7)).alias("at_risk_week"),
        F.count_distinct("facility_id").alias("facilities"),
        F.count_distinct("state", "district").alias("districts"),
        F.count_distinct(F.when(need, F.col("district"))).alias("districts_short"),
        F.count_distinct("state").alias("states"), F.sum("on_hand").alias("units_on_hand"))


def _bucket(steps, last):
    """(condition, label) in order -> label and position columns."""
    label, pos = F.lit(last), F.lit(len(steps) + 1)
    for i, (cond, name) in reversed(list(enumerate(steps))):
        label, pos = F.when(cond, name).otherwise(label), F.when(cond, i + 1).otherwise(pos)
    return label.alias("bucket"), pos.alias("sort_order")


def stockout_timeline(rs: DataFrame) -> DataFrame:
    d = F.col("days_of_cover")
    cols = _bucket([(F.col("on_hand") <= 0, "Already out"), (d <= 7, "Within a week"),
                    (d <= 14, "1 to 2 weeks"), (d <= 30, "2 to 4 weeks")], "More than a month")
    return rs.filter("days_of_cover IS NOT NULL OR on_hand <= 0").groupBy(*cols).agg(F.count("*").alias("n"))


def worst_medicines(rs: DataFrame, top: int = TOP) -> DataFrame:
    return (rs.filter("needs_reorder").groupBy("item_name").agg(
        F.min("ven_class").alias("ven_class"), F.count_distinct("facility_id").alias("centres"),
        F.count_distinct("state", "district").alias("districts"))
        .orderBy(F.desc("centres"), F.desc("districts"), "item_name").limit(top))


def ven_breakdown(rs: DataFrame) -> DataFrame:
    short = F.count_if("needs_reorder")
    return rs.groupBy("ven_class").agg(F.count("*").alias("tracked"), short.alias("short"),
                                       share(short, F.count("*")).alias("pct"))


def district_quadrant(rs: DataFrame, absorption: DataFrame, multiplier: float = MULTIPLIER,
                      min_lines: int = MIN_LINES, qualified: bool = False) -> DataFrame:
    """Share short against share able to cope, by district name; ``qualified`` keeps two
    districts of one name in different states apart."""
    key = ["state", "district"] if qualified else ["district"]
    first = [] if qualified else [F.min("state").alias("state")]
    s = rs.groupBy(*key).agg(*first, F.count("*").alias("tracked"), F.count_if("needs_reorder").alias("n_short"),
                             F.count_if((F.col("ven_class") == "Vital") & F.col("needs_reorder")).alias("vital_short"),
                             F.count_if(F.col("status") == "stocked_out").alias("stocked_out")).filter(F.col("tracked") >= min_lines)
    c = absorption.filter(F.col("multiplier") == multiplier).groupBy(*key).agg(
        share(F.count_if("absorbs"), F.count("*")).alias("pct_cope"))
    rows = s.join(c, key).withColumn("pct_short", share("n_short", "tracked"))
    return rows.select("district", "state", "tracked", "vital_short", "stocked_out", "pct_short", "pct_cope",
                       ((F.col("pct_short") >= 40) & (F.col("pct_cope") < FRAGILE)).alias("critical"))


def absorption_share(absorption: DataFrame) -> DataFrame:
    holds = F.count_if("absorbs")
    return absorption.groupBy("multiplier").agg(holds.alias("holds"), F.count("*").alias("total"),
                                                share(holds, F.count("*")).alias("pct"))


def queue(impact: DataFrame, recs: DataFrame) -> DataFrame:
    a = impact.agg(F.count_if("lead_time_decisive").alias("transfer_only"))
    b = recs.agg(F.count("*").alias("recommended"), nvl0(F.sum("quantity")).alias("units"),
                 F.count_if(F.col("ven_class") == "Vital").alias("vital"))
    return beside(a, b)


def band(value: Column, good: float, fair: float, higher: bool = True) -> Column:
    ok, warn = (value >= good, value >= fair) if higher else (value <= good, value <= fair)
    return F.when(value.isNull(), "unknown").when(ok, "ok").when(warn, "warn").otherwise("bad")


def grades(card: DataFrame, absorption: DataFrame, multiplier: float = MULTIPLIER) -> DataFrame:
    """One row per headline rate with its verdict."""
    cope = absorption_share(absorption).filter(F.col("multiplier") == multiplier).agg(F.max("pct").alias("absorb3"))
    c = beside(card, cope)
    spread = F.when(F.col("districts") > 1, share("districts_short", "districts"))
    rates = [("availability", share("available", "tracked"), 90, 75, True),
             ("vital_availability", share("vital_available", "vital_tracked"), 95, 85, True),
             ("stocked_out", share("stocked_out", "tracked"), 1, 5, False),
             ("at_risk_week", share("at_risk_week", "tracked"), 5, 15, False),
             ("spread", spread, 25, 60, False), ("resilience", F.col("absorb3"), 70, FRAGILE, True)]
    rows = F.array(*[F.struct(F.lit(n).alias("grade"), v.alias("pct"), band(v, g, f, h).alias("tone"))
                     for n, v, g, f, h in rates])
    return c.select(F.explode(rows).alias("g")).select("g.*")


# -- beds and staff ----------------------------------------------------------------------

def bed_scorecard(beds: DataFrame) -> DataFrame:
    hit = F.col("turned_away") > 0
    s = beds.agg(F.count("*").alias("centres"), F.sum("bed_capacity").alias("beds"),
                 F.sum("free_beds").alias("free_beds"), F.sum("turned_away").alias("turned_away"),
                 rnd(mean4("occupancy_rate"), 4).alias("mean_occupancy"),
                 F.count_if(F.col("status") == "over_capacity").alias("over_capacity"),
                 F.count_if(hit).alias("turning_away"), F.count_distinct("state", "district").alias("districts"),
                 F.count_distinct(F.when(hit, F.col("district"))).alias("districts_affected"))
    free = rnd(F.lit(100.0) - F.lit(100.0) * F.col("mean_occupancy"), 1)
    over, turning = share("over_capacity", "centres"), share("turning_away", "centres")
    spread = F.when(F.col("districts") > 1, share("districts_affected", "districts"))
    return s.select("*", free.alias("free_pct"), band(free, 40, 15).alias("free_tone"), over.alias("over_pct"),
                    band(over, 5, 20, False).alias("over_tone"), turning.alias("turning_pct"),
                    band(turning, 5, 20, False).alias("turning_tone"), spread.alias("spread_pct"),
                    band(spread, 25, 60, False).alias("spread_tone"))


def bed_distribution(beds: DataFrame) -> DataFrame:
    r = F.col("occupancy_rate")
    cols = _bucket([(r >= 1, "Over capacity"), (r >= 0.85, "85% or more full"),
                    (r >= 0.5, "Half to 85% full"), (r > 0, "Under half full")], "Empty")
    return beds.groupBy(*cols).agg(F.count("*").alias("n"))


def bed_ranking(beds: DataFrame, top: int = TOP) -> DataFrame:
    return (beds.filter("turned_away > 0").orderBy(F.desc("turned_away"), "facility_id").limit(top).select(
        F.col("facility_name").alias("name"), F.col("turned_away").alias("value"),
        F.concat("district", F.lit(" - "), F.col("bed_capacity").cast("string"), F.lit(" beds")).alias("sub"),
        (F.col("status") == "over_capacity").alias("flag")))


def bed_quadrant(beds: DataFrame) -> DataFrame:
    mean = mean4("occupancy_rate")
    return beds.groupBy("district").agg(
        F.min("state").alias("state"), rnd(F.lit(100.0) * mean, 1).alias("x"),
        share(F.sum("free_beds"), F.sum("bed_capacity")).alias("y"), F.count("*").alias("tracked"),
        ((F.sum("turned_away") > 0) & (mean >= 0.5)).alias("critical"))


def bed_breakdown(beds: DataFrame, by: str = "state", top: int | None = None) -> DataFrame:
    m, c = F.col("mean_occupied"), F.col("bed_capacity").cast("double")
    rows = beds.groupBy(F.col(by).alias("name")).agg(
        rnd(sum4(F.when(m.isNotNull(), F.least(m, c)))).alias("a"),
        rnd(sum4(F.when(m.isNotNull(), F.greatest(c - m, F.lit(0.0))))).alias("b"),
        F.sum("bed_capacity").alias("cap"))
    return rows.orderBy(F.desc("cap"), "name").transform(upto, top).drop("cap")


def staff_scorecard(staff: DataFrame) -> DataFrame:
    """Headline figures; roles are counted once per state and cadre, not per centre."""
    s = staff.agg(F.count("*").alias("facility_cadres"), F.count_distinct("facility_id").alias("centres"),
                  F.sum("sanctioned_posts").alias("posts"), F.count_distinct("state", "cadre").alias("roles"),
                  rnd(weighted_vacancy(), 4).alias("mean_vacancy"),
                  F.count_if(F.col("vacancy_rate").isNull()).alias("no_figure"),
                  nvl0(F.sum("nurses_short_of_bed_norm")).alias("nurses_short"),
                  F.count_distinct("state", "district").alias("districts"), F.count_distinct("state").alias("states"))
    roles = staff.filter("vacancy_rate IS NOT NULL").groupBy("state", "cadre").agg(F.min("vacancy_rate").alias("v"))
    r = roles.agg(F.count_if(F.col("v") >= 0.3).alias("roles_badly_short"), F.count("*").alias("roles_scored"),
                  F.min(F.struct((-F.col("v")).alias("neg"), "state", "cadre")).alias("w"))
    out = beside(s, r)
    filled = F.least(F.lit(100.0), rnd(F.lit(100.0) - F.lit(100.0) * F.coalesce("mean_vacancy", F.lit(0.0)), 1))
    worst = rnd(F.lit(-100.0) * F.col("w.neg"), 1)
    bad = share("roles_badly_short", "roles_scored")
    return out.select(*s.columns, "roles_badly_short", "roles_scored", F.col("w.state").alias("worst_state"),
                      F.col("w.cadre").alias("worst_cadre"), worst.alias("worst_pct"),
                      band(worst, 15, 30, False).alias("worst_tone"), filled.alias("filled_pct"),
                      band(filled, 90, 75).alias("filled_tone"), bad.alias("badly_short_pct"),
                      band(bad, 20, 40, False).alias("badly_short_tone"))


def staff_distribution(staff: DataFrame) -> DataFrame:
    v = F.col("vacancy_rate")
    cols = _bucket([(v >= 0.5, "Half the posts empty"), (v >= 0.3, "30% to 50% empty"),
                    (v >= 0.1, "10% to 30% empty"), (v > 0, "Under 10% empty")], "Fully staffed")
    return staff.groupBy(*cols).agg(F.count("*").alias("n"))


def staff_ranking(staff: DataFrame, top: int = TOP) -> DataFrame:
    v = weighted_vacancy()
    rows = staff.groupBy(F.col("cadre").alias("name")).agg(
        rnd(F.lit(100.0) * v, 1).alias("value"),
        F.concat(F.sum("sanctioned_posts").cast("string"), F.lit(" sanctioned posts")).alias("sub"), (v >= 0.3).alias("flag"))
    return rows.orderBy(F.desc_nulls_last("value"), "name").limit(top)


def staff_quadrant(staff: DataFrame) -> DataFrame:
    v = F.min("vacancy_rate")
    return staff.filter("vacancy_rate IS NOT NULL").groupBy("state", F.col("cadre").alias("name")).agg(
        rnd(F.lit(100.0) * v, 1).alias("x"), F.sum("sanctioned_posts").alias("y"),
        F.count_distinct("facility_id").alias("tracked"), (v >= 0.3).alias("critical"))


def staff_breakdown(staff: DataFrame, by: str = "state", top: int | None = None) -> DataFrame:
    p, v = F.col("sanctioned_posts"), F.col("vacancy_rate")
    rows = staff.filter("vacancy_rate IS NOT NULL").groupBy(F.col(by).alias("name")).agg(
        rnd(sum4(p * (F.lit(1.0) - v))).alias("a"), rnd(sum4(p * v)).alias("b"), F.sum(p).alias("posts"))
    return rows.orderBy(F.desc("posts"), "name").transform(upto, top).drop("posts")


# -- geography ---------------------------------------------------------------------------

def reporting_geography(rs: DataFrame) -> DataFrame:
    """The facilities that report, with the lines and facilities of every level above them: one
    row per facility, district and state and one for all. No row holds the members of a level."""
    fac = rs.groupBy("state", "district", "facility_id").agg(F.min("facility_name").alias("name"), F.count("*").alias("lines"))
    levels = fac.rollup("state", "district", "facility_id").agg(
        F.grouping_id().alias("above"), F.min("name").alias("name"), F.sum("lines").alias("lines"), F.count("*").alias("facilities"))
    own = F.col("above") == 0
    return levels.select(
        F.when(own, "facility").when(F.col("above") == 1, "district").when(F.col("above") == 3, "state").otherwise("all").alias("level"),
        "state", "district", "facility_id", F.when(own, F.col("name")).alias("name"), "lines", "facilities")


def flat_geography(geo: DataFrame) -> DataFrame:
    """The facilities with the totals of their district and state beside them."""
    of = lambda level: geo.filter(F.col("level") == level)
    state = of("state").select(F.struct("state").alias("_s"), F.col("lines").alias("state_lines"))
    district = of("district").select(F.struct("state", "district").alias("_d"), F.col("lines").alias("district_lines"))
    rows = of("facility").withColumn("_s", F.struct("state")).withColumn("_d", F.struct("state", "district"))
    return rows.join(district, "_d").join(state, "_s").select(
        "state", "state_lines", "district", "district_lines", "facility_id", "name", "lines")


def geography_totals(geo: DataFrame) -> DataFrame:
    at = lambda level: F.count_if(F.col("level") == level)
    return geo.agg(at("state").alias("states"), at("district").alias("districts"), at("facility").alias("facilities"),
                   nvl0(F.sum(F.when(F.col("level") == "all", F.col("lines")))).alias("lines"))


def write_geography(geo: DataFrame, path: str) -> None:
    """The nested form, a row per district with its facilities by name and a folder per state."""
    (geo.filter("level = 'facility'").groupBy("state", "district")
     .agg(F.sum("lines").alias("lines"), F.sort_array(F.collect_list(F.struct("name", "facility_id", "lines"))).alias("facilities"))
     .write.mode("overwrite").partitionBy("state").parquet(path))


def medicine_comparison(rs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    need, vital = F.col("needs_reorder"), F.col("ven_class") == "Vital"
    n = F.count("*")
    return rs.groupBy("state", "district").agg(
        n.alias("tracked"), F.count_distinct("facility_id").alias("centres"),
        share(F.count_if(~need), n).alias("score"), share(F.count_if(vital & ~need), F.count_if(vital)).alias("secondary"),
        share(F.count_if(F.col("status") == "stocked_out"), n).alias("failure"),
        rnd(ratio(F.sum("lead_time_days"), n), 1).alias("lead_days"),
        rnd(mean4("distance_to_hq_km"), 0).alias("km")).filter(F.col("tracked") >= min_lines)


def lead_time_structure(rs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    n = F.count("*")
    d = rs.groupBy("state", "district").agg(
        n.alias("tracked"), (F.lit(100.0) * ratio(F.count_if(~F.col("needs_reorder")), n)).alias("score"),
        ratio(F.sum("lead_time_days"), n).alias("lead"), mean4("distance_to_hq_km").alias("km")).filter(F.col("tracked") >= min_lines)
    lead = F.col("lead")
    label, pos = _bucket([(lead < 9, "Under 9 days"), (lead < 12, "9 to 12 days"), (lead < 15, "12 to 15 days")], "15 days or more")
    return d.groupBy(label.alias("band"), pos).agg(
        F.count("*").alias("districts"), rnd(mean4("score"), 1).alias("mean_score"),
        rnd(mean4("lead"), 1).alias("mean_lead"), rnd(mean4("km"), 0).alias("mean_km"))


def lead_time_correlation(rs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """How closely a district's availability follows its lead time."""
    n = F.count("*")
    d = rs.groupBy("state", "district").agg(
        n.alias("tracked"), ratio(F.count_if(~F.col("needs_reorder")), n).alias("score"),
        ratio(F.sum("lead_time_days"), n).alias("lead")).filter(F.col("tracked") >= min_lines)
    return d.agg(F.count("*").alias("districts"), rnd(ratio(F.covar_samp("score", "lead"),
                                                                     F.stddev_samp("score") * F.stddev_samp("lead")), 4).alias("correlation"))


def bed_comparison(beds: DataFrame) -> DataFrame:
    n = F.count("*")
    return beds.groupBy("state", "district").agg(
        n.alias("tracked"), share(F.sum("free_beds"), F.sum("bed_capacity")).alias("score"),
        share(F.count_if(F.col("status") == "over_capacity"), n).alias("secondary"), F.sum("turned_away").alias("failure"))


def staff_comparison(staff: DataFrame, state: str | None = None) -> DataFrame:
    """States against each other, or the cadres inside one state."""
    fill = lambda c: rnd(F.lit(100.0) - F.lit(100.0) * mean4(c), 1)
    if state:
        return staff.filter(F.col("state") == state).groupBy(F.col("cadre").alias("district")).agg(
            F.count("*").alias("tracked"), F.count_distinct("facility_id").alias("centres"),
            fill("vacancy_rate").alias("score"), F.sum("sanctioned_posts").alias("secondary"))
    doctor = F.when(F.col("cadre") == "Doctor (allopathic)", F.col("vacancy_rate"))
    return staff.groupBy(F.col("state").alias("district")).agg(
        F.count("*").alias("tracked"), F.count_distinct("facility_id").alias("centres"),
        fill("vacancy_rate").alias("score"), fill(doctor).alias("secondary"), F.sum("sanctioned_posts").alias("failure"))


def league_finish(rows: DataFrame, key: str = "district") -> DataFrame:
    """Summary of a league table: fixed bands, both ends, the middle place.

    Places come from a counted histogram of the table's order (score, then key; null scores last).
    Null scores have places but no band, and no part in the median of the scores."""
    order = ["nulls", "score", key]
    places = counted(rows.withColumn("nulls", F.col("score").isNull()), order)
    s, n = F.col("score"), F.col("n")
    n_of = lambda cond: nvl0(F.sum(F.when(cond, n)))
    sums = places.agg(
        nvl0(F.sum("n")).alias("districts"), n_of(s < 60).alias("under_60"),
        n_of((s >= 60) & (s < 75)).alias("from_60"), n_of((s >= 75) & (s < 90)).alias("from_75"),
        n_of(s >= 90).alias("from_90"), F.min("score").alias("lowest"), F.max("score").alias("highest"),
        n_of(s.isNotNull()).alias("scored"))
    total, scored = sums.select("districts").scalar(), sums.select("scored").scalar()
    at = lambda place, c: F.max(F.when(holds(place), F.col(c)))
    mid, half = F.floor(total / 2), F.floor(scored / 2)
    ends = places.agg(
        at(F.lit(0), key).alias("worst"), at(total - 1, key).alias("best"), at(mid, key).alias("typical"),
        at(mid, "score").alias("typical_score"), at(half, "score").alias("median"))
    t = ends.select("typical_score").scalar()
    sides = places.agg(n_of(s > t).alias("above_typical"), n_of(s < t).alias("below_typical"))
    return beside(sums.drop("scored"), ends, sides).withColumn("gap", rnd(F.col("highest") - F.col("lowest"), 1))


def league_ends(rows: DataFrame, top: int = TOP, key: str = "district") -> DataFrame:
    worst = rows.orderBy(F.asc_nulls_last("score"), key).limit(top).withColumn("end", F.lit("worst"))
    best = rows.orderBy(F.desc_nulls_first("score"), F.desc(key)).limit(top).withColumn("end", F.lit("best"))
    return worst.unionByName(best).select("end", key, "score")


# -- map ---------------------------------------------------------------------------------

def district_centres(facilities: DataFrame) -> DataFrame:
    return (facilities.filter("has_valid_coords")
            .groupBy(F.col("admin_l1").alias("state"), F.col("admin_l2").alias("district"))
            .agg(rnd(mean4("latitude"), 5).alias("lat"), rnd(mean4("longitude"), 5).alias("lon")))


def map_districts(facilities: DataFrame, rs: DataFrame, absorption: DataFrame,
                  multiplier: float = MULTIPLIER) -> DataFrame:
    key = ["state", "district"]
    need = F.col("needs_reorder")
    risk = rs.groupBy(*key).agg(
        F.count("*").alias("tracked"), F.count_if(need).alias("short"),
        F.count_if(need & (F.col("ven_class") == "Vital")).alias("vital_short"),
        F.count_if(F.col("status") == "stocked_out").alias("stocked_out"),
        F.count_distinct("facility_id").alias("reporting_facilities"), F.sum("on_hand").alias("units_on_hand"))
    room = absorption.filter(F.col("multiplier") == multiplier).groupBy(*key).agg(
        share(F.count_if("absorbs"), F.count("*")).alias("pct_hold"), F.count("*").alias("positions"))
    return risk.join(district_centres(facilities), key).join(room, key, "left")


def map_flows(facilities: DataFrame, recs: DataFrame) -> DataFrame:
    """District pairs that exchange stock; moves inside a district are left off."""
    home = facilities.select(F.col("facility_id").alias("from_facility_id"),
                             F.col("admin_l1").alias("from_state"), F.col("admin_l2").alias("from_district"))
    worst = F.when(F.col("status") == "stocked_out", 1).when(F.col("status") == "critical", 2).otherwise(3)
    flows = (recs.join(home, "from_facility_id")
             .filter("NOT (from_state = to_state AND from_district = to_district)")
             .groupBy("from_state", "from_district", "to_state", "to_district").agg(
                 F.count("*").alias("moves"), F.sum("quantity").alias("units"),
                 F.count_if(F.col("ven_class") == "Vital").alias("vital_moves"), F.max("distance_km").alias("km"),
                 F.max("priority_score").alias("top_priority"), F.min(worst).alias("severity")))
    c = district_centres(facilities)
    a = c.select(*[F.col(x).alias("from_" + x) for x in c.columns])
    b = c.select(*[F.col(x).alias("to_" + x) for x in c.columns])
    return flows.join(a, ["from_state", "from_district"]).join(b, ["to_state", "to_district"])


def map_summary(districts: DataFrame, flows: DataFrame) -> DataFrame:
    a = districts.agg(F.count("*").alias("districts"),
                      F.count_if(F.col("vital_short") > 0).alias("districts_with_vital_short"),
                      F.count_if(F.col("pct_hold") < FRAGILE).alias("fragile_districts"))
    b = flows.agg(F.count("*").alias("flows"), nvl0(F.sum("units")).alias("units_in_flight"),
                  F.coalesce(F.max("km"), F.lit(0.0)).alias("longest_km"))
    return beside(a, b)


def facility_points(facilities: DataFrame, digits: int = 3) -> DataFrame:
    return facilities.filter("country_code = 'IN' AND facility_type IN ('phc', 'chc') AND has_valid_coords").select(
        rnd("latitude", digits).alias("lat"), rnd("longitude", digits).alias("lon"),
        F.when(F.col("facility_type") == "phc", 0).otherwise(1).alias("type"),
        F.when(F.col("is_forecast_facility"), 1).otherwise(0).alias("reporting"))


def facility_point_counts(facilities: DataFrame) -> DataFrame:
    ok = F.coalesce("has_valid_coords", F.lit(False))
    phc = F.col("facility_type") == "phc"
    rows = facilities.filter("country_code = 'IN' AND facility_type IN ('phc', 'chc')").agg(
        F.count_if(ok & phc).alias("phc"), F.count_if(ok & ~phc).alias("chc"), F.count_if(ok).alias("total"),
        F.count_if(ok & F.col("is_forecast_facility")).alias("reporting"),
        F.count_if(~ok & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("unplaceable"))
    return rows.withColumn("share", share("reporting", "total"))


def dashboard_stats(summary: DataFrame, moves: DataFrame, counts: DataFrame, captured: DataFrame) -> DataFrame:
    """The headline figures of the other reads side by side; every input has one row."""
    out = summary.select("tracked_series", "open_alerts", "stocked_out", "critical", "vital_alerts",
                         F.col("caught_only_by_new_rule").alias("caught_by_lead_time_rule"))
    m = moves.select(F.col("transfers").alias("pending_transfers"), F.col("units").alias("units_to_move"),
                     F.col("waste_avoided").alias("waste_avoided_units"), "substitutions")
    c = counts.select("facilities", "phcs", "demo_facilities", "districts", "population_served")
    k = captured.select("captures_today", "captures_last_7_days", "captures_all_time")
    return beside(out, m, c, k)
