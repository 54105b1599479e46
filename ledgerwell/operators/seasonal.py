"""Seasonal patterns shared between districts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.months import (CALENDAR, FISCAL, HELD_MONTH, OBSERVED, SCORED,
                                fiscal_number, month_number)
from ..functions.num import joined, nvl0, ratio, rnd, share
from ..plans.listing import upto
from ..plans.nearest import nearest
from ..plans.snapshot import snapshot
from .stock import mean4, sum4

SERIES = ["state", "district_key", "atc_class"]
ARMS = ("flat", "demo_out", "demo_in", "pooled")
Z = ("z_population", "z_facilities", "z_phcs", "z_pop_per_phc")


def district_profiles(facilities: DataFrame, demand: DataFrame) -> DataFrame:
    covered = demand.select(F.col("admin_l1").alias("state"), "district_key").distinct()
    base = (facilities.filter("country_code = 'IN' AND population_served IS NOT NULL")
            .groupBy(F.col("admin_l1").alias("state"), F.upper(F.trim("admin_l2")).alias("district_key"))
            .agg(F.min("admin_l2").alias("district"), F.count("*").alias("facility_count"),
                 F.count_if(F.col("facility_type") == "phc").alias("phc_count"),
                 F.sum("population_served").alias("population_served")))
    per = ratio("population_served", "phc_count")
    rows = (base.join(covered, ["state", "district_key"], "left_semi")
            .withColumn("per", per)
            .withColumn("l_pop", F.log(F.col("population_served") + 1.0))
            .withColumn("l_fac", F.log(F.col("facility_count") + 1.0))
            .withColumn("l_phc", F.log(F.col("phc_count") + 1.0))
            .withColumn("l_ppp", F.log(F.col("per") + 1.0)))
    names = ("l_pop", "l_fac", "l_phc", "l_ppp")
    stats = rows.agg(F.struct(*[F.avg(n).alias(n + "_mu") for n in names],
                              *[F.stddev_samp(n).alias(n + "_sd") for n in names])).scalar()
    rows = rows.withColumn("s", stats)
    z = lambda n: rnd(ratio(F.col(n) - F.col(f"s.{n}_mu"), F.col(f"s.{n}_sd")), 4)
    return rows.select("state", "district_key", "district", "facility_count", "phc_count",
                       "population_served", rnd("per").alias("population_per_phc"),
                       *[z(n).alias(a) for n, a in zip(names, Z)])


def pattern_vectors(demand: DataFrame, items: DataFrame, class_chars: int = 5) -> DataFrame:
    drivers = (items.filter("atc_code IS NOT NULL AND demand_driver IS NOT NULL")
               .select(F.substring("atc_code", 1, class_chars).alias("atc_class"),
                       F.col("demand_driver").alias("indicator")).distinct())
    monthly = (demand.join(drivers, "indicator")
               .groupBy(F.col("admin_l1").alias("state"), "district_key", "atc_class", "month")
               .agg(F.sum("value").alias("value")))
    base = (monthly.filter(F.col("month") != HELD_MONTH).groupBy(*SERIES)
            .agg(F.avg("value").alias("baseline"), F.count_if(F.col("value") > 0).alias("months_with_data"))
            .filter("baseline > 0"))
    return monthly.join(base, SERIES).withColumn("multiplier", rnd(
        F.when(F.col("month") == HELD_MONTH, 1.0).otherwise(ratio("value", "baseline")), 4))


def _rename(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def district_matches(profiles: DataFrame, same_state: bool = False, k: int = 3) -> DataFrame:
    """The k nearest districts in the four-dimensional profile, of other states or of the same one.
    Districts with an incomplete profile (no health centre) take no part; equal distances go by
    the donor's name."""
    found = nearest(profiles, list(Z), "state", ["district_key"], k, same_state)
    a = profiles.select(F.struct("district_key", F.col("state").alias("group")).alias("id"), "state", "district_key", "district",
                        "population_served", "phc_count", "population_per_phc")
    donors = _rename(a, "donor_").withColumnRenamed("donor_id", "other")
    return (found.join(a, "id").join(donors, "other").drop("id", "other")
            .withColumnRenamed("distance", "profile_distance").withColumnRenamed("rank", "match_rank")
            .select(*[c for c in a.columns if c != "id"], *[c for c in donors.columns if c != "other"], "profile_distance", "match_rank"))


def _window_mean(value: str) -> Column:
    """Mean over the observed months, added in calendar order."""
    parts = [F.max(F.when(F.col("month") == m, F.col(value))) for m in OBSERVED]
    n = F.count(F.when(F.col("month").isin(*OBSERVED), F.col(value)))
    return ratio(nvl0(parts[0]) + nvl0(parts[1]) + nvl0(parts[2]), n)


def exchange_eval(vectors: DataFrame, out_state: DataFrame, in_state: DataFrame) -> DataFrame:
    """Four forecasts of the held-out months from three observed ones."""
    observed = (vectors.filter(F.col("month").isin(*OBSERVED)).groupBy(*SERIES)
                .agg(F.avg("value").alias("o")))
    truth = vectors.filter(F.col("month").isin(*SCORED)).select(*SERIES, "month", F.col("value").alias("actual"))
    pooled = vectors.groupBy("atc_class", "month").agg(mean4("multiplier").alias("m_pooled"))
    pooled_w = pooled.groupBy("atc_class").agg(_window_mean("m_pooled").alias("w_pooled"))

    def borrowed(matches, tag, extra=()):
        first = matches.filter("match_rank = 1").select(
            "state", "district_key", "donor_state", "donor_district_key", *extra)
        v = vectors.select(F.col("state").alias("donor_state"), F.col("district_key").alias("donor_district_key"),
                           "atc_class", "month", "multiplier")
        rows = first.join(v, ["donor_state", "donor_district_key"])
        w = rows.groupBy(*SERIES).agg(_window_mean("multiplier").alias("w_" + tag))
        return rows.withColumnRenamed("multiplier", "m_" + tag), w

    d_out, w_out = borrowed(out_state, "demo_out", ("donor_district", "profile_distance"))
    d_in, w_in = borrowed(in_state, "demo_in")
    rows = (truth.join(observed, SERIES)
            .join(d_out.drop("donor_district_key"), SERIES + ["month"]).join(w_out, SERIES)
            .join(d_in.select(*SERIES, "month", "m_demo_in"), SERIES + ["month"]).join(w_in, SERIES)
            .join(pooled, ["atc_class", "month"]).join(pooled_w, "atc_class")
            .filter("actual > 0 AND o > 0 AND w_demo_out > 0 AND w_demo_in > 0 AND w_pooled > 0"))
    guess = {"flat": F.col("o")}
    for arm in ARMS[1:]:
        guess[arm] = ratio("o", "w_" + arm) * F.col("m_" + arm)
    return rows.select(
        *SERIES, "month", "donor_state", "donor_district", rnd("profile_distance", 4).alias("profile_distance"),
        "actual", *[rnd(guess[a], 2).alias(a + "_forecast") for a in ARMS],
        *[F.abs(guess[a] - F.col("actual")).alias(a + "_abs_error") for a in ARMS])


def _wmape(arm: str) -> Column:
    return share(sum4(arm + "_abs_error"), F.sum("actual"), 1)


def exchange_wmape(ev: DataFrame) -> DataFrame:
    rows = ev.agg(F.count("*").alias("predictions"),
                  F.count_distinct("state", "district_key").alias("districts"),
                  F.count_distinct("atc_class").alias("atc_classes"),
                  *[_wmape(a).alias(a + "_wmape") for a in ARMS])
    low = F.least(*[F.col(a + "_wmape") for a in ARMS])
    best = F.coalesce(*[F.when(F.col(a + "_wmape") == low, F.lit(a)) for a in ARMS])
    gain = F.col("flat_wmape") - F.col("pooled_wmape")
    return (rows.withColumn("best_arm", best)
            .withColumn("improvement_points", rnd(gain, 1))
            .withColumn("improvement_relative", share(gain, "flat_wmape", 1)))


def published_vector(vectors: DataFrame) -> DataFrame:
    """What a district publishes: twelve multipliers in fiscal order."""
    return vectors.groupBy(*SERIES).agg(
        F.array(*[F.max(F.when(F.col("month") == m, F.col("multiplier"))) for m in FISCAL])
        .alias("monthly_multipliers"))


def spread(df: DataFrame, column: str, names) -> DataFrame:
    """Array elements as columns."""
    return df.select(*[c for c in df.columns if c != column],
                     *[F.element_at(column, i + 1).alias(n.lower()) for i, n in enumerate(names)])


def thin_history_pick(ev: DataFrame, min_actual: float = 500.0) -> DataFrame:
    """The case where borrowing helps most, with its month series."""
    per = (ev.groupBy(*SERIES).agg(sum4("flat_abs_error").alias("flat_err"),
                                   sum4("pooled_abs_error").alias("pooled_err"),
                                   F.sum("actual").alias("total_actual"))
           .filter((F.col("total_actual") > min_actual) & (F.col("pooled_err") < F.col("flat_err"))))
    gain = ratio(F.col("flat_err") - F.col("pooled_err"), "total_actual")
    pick = per.withColumn("gain", gain).orderBy(F.desc("gain"), *SERIES).limit(1)
    return (ev.join(pick, SERIES).select(
        *SERIES, "month", fiscal_number("month").alias("month_order"), "actual", "flat_forecast",
        F.col("pooled_forecast").alias("borrowed_forecast"), share("flat_err", "total_actual").alias("flat_wmape"),
        share("pooled_err", "total_actual").alias("borrowed_wmape"),
        share(F.col("flat_err") - F.col("pooled_err"), "total_actual").alias("improvement_points")))


def local_patterns(demand: DataFrame, items: DataFrame, class_chars: int = 4,
                   district: str | None = None) -> DataFrame:
    """Twelve coefficients per class, January first, over an April-December baseline. A class
    with several drivers uses the first by name."""
    if district:
        demand = demand.filter(F.col("district_key") == district.strip().upper())
    drivers = (items.filter("atc_code IS NOT NULL AND demand_driver IS NOT NULL")
               .select(F.substring("atc_code", 1, class_chars).alias("atc_class"),
                       F.col("demand_driver").alias("indicator")).distinct())
    monthly = (demand.join(drivers, "indicator").groupBy("atc_class", "indicator", "month")
               .agg(F.sum("value").alias("value")))
    base = (monthly.filter(F.col("month").isin(*FISCAL[:9])).groupBy("atc_class")
            .agg(F.avg("value").alias("baseline")).filter("baseline > 0"))
    first = monthly.groupBy("atc_class").agg(F.min("indicator").alias("indicator"))
    rows = monthly.join(first, ["atc_class", "indicator"]).join(base, "atc_class")
    value = lambda m: F.max(F.when(F.col("month") == m, ratio("value", "baseline")))
    coef = [F.lit(1.0) if m == HELD_MONTH else
            F.when(nvl0(value(m)) == 0, 1.0).otherwise(rnd(value(m), 3)) for m in CALENDAR]
    return rows.groupBy("atc_class", F.col("indicator").alias("based_on_indicator")).agg(
        F.array(*coef).alias("monthly_coefficients"))


def class_units(items: DataFrame) -> DataFrame:
    return (items.filter("atc_code IS NOT NULL AND demand_driver IS NOT NULL AND units_per_driver_event IS NOT NULL")
            .groupBy(F.substring("atc_code", 1, 5).alias("atc_class"))
            .agg(F.sum("units_per_driver_event").alias("units_per_event"), F.min("unit").alias("unit"),
                 F.min("demand_driver").alias("driver"), joined("display_name").alias("medicines")))


def outlook_curve(ev: DataFrame, units: DataFrame, atc_class: str | None = None) -> DataFrame:
    """Actual, pooled and flat by month in the medicine's own unit; never across classes."""
    if atc_class:
        ev = ev.filter(F.col("atc_class") == atc_class)
    u = F.col("units_per_event")
    return (ev.join(units, "atc_class").groupBy("atc_class", "unit", "month")
            .agg(rnd(sum4(F.col("actual") * u)).alias("actual"),
                 rnd(sum4(F.col("pooled_forecast") * u)).alias("pooled"),
                 rnd(sum4(F.col("flat_forecast") * u)).alias("flat"))
            .withColumn("sort_order", fiscal_number("month") - 1))


def outlook_accuracy(ev: DataFrame) -> DataFrame:
    return ev.groupBy("atc_class").agg(
        *[_wmape(a).alias(a) for a in ARMS], F.count("*").alias("observations"),
        F.count_distinct("district_key").alias("districts"), F.sum("actual").alias("total_actual"))


def outlook_classes(ev: DataFrame, units: DataFrame, top: int | None = None) -> DataFrame:
    """What can be chosen, busiest first; the first row is the default class."""
    return (ev.join(units, "atc_class").groupBy("atc_class", "medicines", "unit")
            .agg(F.count("*").alias("months"),
                 rnd(sum4(F.col("actual") * F.col("units_per_event"))).alias("volume"))
            .orderBy(F.desc("volume"), "atc_class").transform(upto, top))


def outlook_donors(ev: DataFrame, top: int | None = None) -> DataFrame:
    return (ev.groupBy("donor_district", "donor_state", F.col("district_key").alias("receiver"),
                       F.col("state").alias("receiver_state"))
            .agg(rnd(F.min("profile_distance"), 3).alias("profile_distance"), F.count("*").alias("months"))
            .orderBy(F.desc("months"), "receiver_state", "receiver").transform(upto, top))


def outlook_reliability(curve: DataFrame, accuracy: DataFrame, reliable: float = 20.0,
                        directional: float = 40.0) -> DataFrame:
    shape = curve.groupBy("atc_class").agg(
        F.max_by("month", F.struct("actual", -F.col("sort_order"))).alias("peak_month"),
        F.min_by("month", F.struct("actual", "sort_order")).alias("trough_month"),
        F.max("actual").alias("hi"), F.min("actual").alias("lo"), F.count("*").alias("months"))
    gain = rnd(F.col("flat") - F.col("pooled"), 1)
    level = (F.when(F.col("pooled") >= directional, "bad").when(F.col("pooled") >= reliable, "warn")
             .when(gain > 0, "ok").otherwise("bad"))
    return (accuracy.join(shape, "atc_class").select(
        "atc_class", "flat", "pooled", gain.alias("gain"), (gain > 0).alias("helps"),
        level.alias("level"), "peak_month", "trough_month",
        rnd(ratio("hi", "lo"), 1).alias("swing"), "months"))


def peer_vector_store(published: DataFrame) -> DataFrame:
    """Vectors offered by peers: exactly twelve numbers, the latest per country and class."""
    ok = published.filter(F.size("monthly_coefficients") == 12)
    best = ok.groupBy("country_code", "atc_code").agg(F.max_by(
        F.struct("monthly_coefficients", "source_district"),
        F.struct("ingested_at", "source_district")).alias("b"))
    return best.select("country_code", "atc_code", "b.source_district", "b.monthly_coefficients")
