"""Surge detection and what it does to supply."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.months import month_name, month_number
from ..functions.num import joined, nvl0, ratio, rnd, share, to_long
from ..plans.listing import upto
from ..plans.ordered import running_totals
from ..plans.snapshot import snapshot
from .plan import SERVICE_Z, reorder_threshold, ven_rank
from .seasonal import SERIES
from .stock import PAIR, mean4, sum4
from .transfers import TARGET, USABLE_DAYS, best_donor, first_of_place, places, transfer_id

Z_CUT, MIN_RATIO, MIN_ABSOLUTE = 3.5, 1.5, 100.0
CONSISTENCY = 0.6745
MULTIPLIERS = (2.0, 3.0, 5.0)
MAX_KM = 300.0
LOW, HIGH = 1.0, 20.0


class ScenarioError(ValueError):
    """A multiplier outside the range the model can answer for."""


def surge_signals(vectors: DataFrame, z_cut: float = Z_CUT, min_ratio: float = MIN_RATIO,
                  min_absolute: float = MIN_ABSOLUTE) -> DataFrame:
    """Departures from the pooled seasonal expectation. The windows hold one series, that
    is twelve months."""
    pooled = vectors.groupBy("atc_class", "month").agg(mean4("multiplier").alias("pooled"))
    one = Window.partitionBy(*SERIES)
    expected = F.col("baseline") * F.col("pooled")
    rows = (vectors.join(pooled, ["atc_class", "month"]).filter("baseline > 0")
            .withColumn("expected", expected)
            .withColumn("residual", F.col("value") - F.col("expected"))
            .withColumn("med", F.percentile("residual", 0.5).over(one))
            .withColumn("sd", F.stddev_samp("residual").over(one))
            .withColumn("mu", F.avg("residual").over(one))
            .withColumn("mad_raw", F.percentile(F.abs(F.col("residual") - F.col("med")), 0.5).over(one)))
    z = F.lit(CONSISTENCY) * ratio(F.col("residual") - F.col("med"), "mad_raw")
    times = ratio("value", "expected")
    return rows.select(
        *SERIES, "month", rnd("value", 1).alias("observed"), rnd("expected", 1).alias("expected"),
        rnd("baseline", 1).alias("baseline"), rnd("pooled", 4).alias("pooled_multiplier"),
        rnd("residual", 1).alias("residual"), "months_with_data",
        rnd(ratio(F.col("residual") - F.col("mu"), "sd"), 2).alias("z_classical"),
        rnd(z, 2).alias("z_modified"), rnd("mad_raw", 2).alias("mad"),
        rnd(times, 2).alias("surge_multiplier"), (z >= z_cut).alias("passes_statistic"),
        (times >= min_ratio).alias("passes_ratio"), (F.col("value") >= min_absolute).alias("passes_magnitude"),
        (F.col("mad_raw").isNull() | (F.col("mad_raw") == 0)).alias("mad_undefined"),
        F.coalesce((F.col("mad_raw") > 0) & (z >= z_cut) & (times >= min_ratio)
                   & (F.col("value") >= min_absolute), F.lit(False)).alias("is_surge"))


def surge_summary(signals: DataFrame, months: int = 12) -> DataFrame:
    ceiling = (months - 1) / months ** 0.5
    s, r, m = (F.coalesce(c, F.lit(False)) for c in ("passes_statistic", "passes_ratio", "passes_magnitude"))
    return signals.agg(
        F.count("*").alias("series_months"), F.count_distinct("district_key").alias("districts"),
        F.count_distinct("atc_class").alias("atc_classes"), F.count_if("mad_undefined").alias("mad_undefined"),
        F.count_if("is_surge").alias("surges"), F.count_if(s).alias("pass_stat"),
        F.count_if(s & ~r).alias("stat_but_small_ratio"), F.count_if(s & r & ~m).alias("stat_but_too_few"),
        F.max("z_classical").alias("max_z_classical"), F.max("z_modified").alias("max_z_modified"),
        F.max("surge_multiplier").alias("max_multiplier"),
        (F.max("z_classical") <= ceiling + 0.01).alias("ceiling_ok"))


def surge_by_class(signals: DataFrame) -> DataFrame:
    return signals.filter("is_surge").groupBy("atc_class").agg(
        F.count("*").alias("surges"), F.count_distinct("district_key").alias("districts"),
        rnd(F.max("surge_multiplier"), 1).alias("peak"))


def _felt(rs: DataFrame, surges: DataFrame, qualified: bool) -> DataFrame:
    """Reorder lines in a surging district and class; by district name alone unless
    ``qualified`` also asks for the state."""
    right = surges.withColumnRenamed("state", "surge_state")
    rows = rs.withColumn("district_key", F.upper("district")).join(right, ["district_key", "atc_class"])
    return rows.filter("surge_state = state") if qualified else rows


def top_surges(signals: DataFrame, rs: DataFrame, top: int = 10) -> DataFrame:
    per = rs.groupBy(F.upper("district").alias("district_key"), "atc_class").agg(
        F.count_distinct("facility_id").alias("facilities"))
    return (signals.filter("is_surge").join(per, ["district_key", "atc_class"])
            .orderBy(F.desc("surge_multiplier"), "state", "district_key", "atc_class", "month").limit(top)
            .select("state", "district_key", "atc_class", "month", to_long("observed").alias("observed"),
                    to_long("expected").alias("expected"), "surge_multiplier", "z_modified", "z_classical",
                    "facilities"))


# -- names for signals -------------------------------------------------------------------

def signal_labels(items: DataFrame, labels: DataFrame) -> DataFrame:
    """labels: demand_driver, signal_class."""
    return (items.filter("atc_code IS NOT NULL").join(labels, "demand_driver")
            .groupBy(F.substring("atc_code", 1, 5).alias("atc_class"), "demand_driver", "signal_class")
            .agg(F.count_distinct("item_id").alias("items_driven"),
                 joined("display_name", ",", 4).alias("example_items")))


def lead_measure(demand: DataFrame, first: str, second: str) -> DataFrame:
    """Months from the peak of one indicator to the peak of another, per district."""
    peak = (demand.filter(F.col("indicator").isin(first, second)).groupBy("district_key")
            .agg(*[F.max_by("month", F.when(F.col("indicator") == i, F.struct(
                "value", -month_number("month")))).alias(n) for i, n in ((first, "a"), (second, "b"))])
            .dropna(subset=["a", "b"]))
    gap = F.pmod(month_number("b") - month_number("a"), F.lit(12))
    return peak.groupBy(gap.alias("gap")).agg(F.count("*").alias("districts"))


def signals_by_class_kind(signals: DataFrame, labels: DataFrame) -> DataFrame:
    return (signals.filter("is_surge").join(labels, "atc_class").groupBy("signal_class")
            .agg(F.count("*").alias("surge_months"), F.count_distinct("district_key").alias("districts"),
                 rnd(F.max("surge_multiplier"), 1).alias("peak")))


def surge_cards(signals: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """One warning per district, month and driver; the classes of a driver are joined."""
    rows = (signals.filter("is_surge").join(labels, "atc_class", "left")
            .withColumn("signal_key", F.coalesce("demand_driver", "atc_class")))
    cards = rows.groupBy("state", "district_key", "month", "signal_key").agg(
        F.min("atc_class").alias("atc_class"), joined("atc_class").alias("atc_classes"),
        *[F.max(c).alias(c) for c in ("observed", "expected", "baseline", "pooled_multiplier",
                                      "surge_multiplier", "z_modified", "z_classical", "mad")],
        *[F.bool_and(c).alias(c) for c in ("passes_statistic", "passes_ratio", "passes_magnitude")],
        F.min("demand_driver").alias("signal_indicator"), F.min("signal_class").alias("signal_class"),
        joined("example_items").alias("example_items"))
    return cards.orderBy(F.desc("surge_multiplier"), F.desc("z_modified"), "state", "district_key",
                         "month", "signal_key").transform(upto, limit)


def early_warning_count(cards: DataFrame) -> DataFrame:
    return (cards.filter("signal_class = 'leading'").groupBy("month")
            .agg(F.count_distinct("district_key").alias("districts")))


# -- supply under surge ------------------------------------------------------------------

def _under(mu: Column, sd: Column, z: float):
    lead = F.col("lead_time_days")
    limit = reorder_threshold(mu, sd, lead, z)
    runs = ratio("on_hand", mu)
    action = (F.when(runs < lead, "transfer_only").when(F.col("on_hand") < limit, "reorder_now")
              .otherwise("holds"))
    short = F.greatest(rnd(limit - F.col("on_hand")), F.lit(0.0))
    return limit, runs, action, short


def surge_supply_impact(rs: DataFrame, signals: DataFrame, z: float = SERVICE_Z,
                        sigma_exponent: float = 1.0, qualified: bool = False) -> DataFrame:
    surges = signals.filter("is_surge").select(
        "state", "district_key", "atc_class", F.col("month").alias("surge_month"), "surge_multiplier",
        "z_modified", to_long("observed").alias("driver_observed"), to_long("expected").alias("driver_expected"))
    rows = _felt(rs.filter("atc_class IS NOT NULL AND avg_daily_demand > 0"), surges, qualified)
    mu = F.col("avg_daily_demand") * F.col("surge_multiplier")
    sd = F.col("demand_std_dev") * F.pow("surge_multiplier", F.lit(sigma_exponent))
    limit, runs, action, short = _under(mu, sd, z)
    return rows.select(
        "facility_id", "facility_name", "state", "district", "item_id", "item_name", "unit", "ven_class",
        "atc_class", "lead_time_days", "lead_time_is_estimated", "distance_to_hq_km", "surge_month",
        "surge_multiplier", "z_modified", "driver_observed", "driver_expected", "on_hand",
        "avg_daily_demand", "reorder_point", "days_of_cover", "needs_reorder",
        F.col("status").alias("status_baseline"), rnd(mu, 2).alias("avg_daily_demand_surge"),
        rnd(limit, 1).alias("reorder_point_surge"), rnd(runs, 1).alias("days_of_cover_surge"),
        rnd(runs, 1).alias("days_to_stockout"), (F.col("on_hand") < limit).alias("needs_reorder_surge"),
        (runs < F.col("lead_time_days")).alias("lead_time_decisive"),
        (~F.col("needs_reorder") & (F.col("on_hand") < limit)).alias("newly_at_risk"),
        short.alias("shortfall_units"), action.alias("surge_action"))


def surge_impact_list(impact: DataFrame, limit: int | None = None) -> DataFrame:
    return impact.orderBy(F.desc("lead_time_decisive"), F.desc("newly_at_risk"), "days_to_stockout",
                          *PAIR, "surge_month").transform(upto, limit)


def network_absorption(rs: DataFrame, multipliers=MULTIPLIERS) -> DataFrame:
    pos = (rs.filter("atc_class IS NOT NULL AND avg_daily_demand > 0")
           .groupBy("state", "district", "atc_class").agg(
               F.min("ven_class").alias("ven_class"), F.count_distinct("facility_id").alias("facilities"),
               F.count("*").alias("stock_rows"), F.sum("on_hand").alias("district_on_hand"),
               rnd(sum4("avg_daily_demand"), 2).alias("district_daily_demand"),
               F.max("lead_time_days").alias("slowest_lead_time"),
               F.min("lead_time_days").alias("fastest_lead_time")))
    rows = pos.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    spike = F.col("district_daily_demand") * F.col("multiplier")
    days = rnd(ratio("district_on_hand", spike), 1)
    absorbs = days >= F.col("slowest_lead_time")
    return rows.select(
        *pos.columns, "multiplier", days.alias("absorption_days"), absorbs.alias("absorbs"),
        F.when(absorbs, F.lit(0).cast("bigint")).otherwise(F.greatest(
            to_long(spike * F.col("slowest_lead_time") - F.col("district_on_hand")), F.lit(0).cast("bigint"))).alias("units_short"),
        rnd(ratio("district_on_hand", F.col("district_daily_demand") * F.col("slowest_lead_time")), 2)
        .alias("max_multiplier_absorbed"))


def surge_recommendations(impact: DataFrame, rs: DataFrame, stock: DataFrame, facilities: DataFrame,
                          max_km: float = MAX_KM, target: float = TARGET,
                          usable_days: int = USABLE_DAYS) -> DataFrame:
    """Transfers under surge. Each donor's claims are added up Vital first and what goes
    past its spare stock is not promised."""
    at = places(facilities)
    need = (impact.filter("needs_reorder_surge").join(at, "facility_id").select(
        F.col("facility_id").alias("to_facility_id"), F.col("state").alias("to_state"),
        F.col("district").alias("to_district"), F.col("item_id").alias("requested_item_id"),
        F.col("item_name").alias("requested_item_name"), "ven_class", "unit", "atc_class", "surge_month",
        "surge_multiplier", F.col("on_hand").alias("r_hand"), F.col("avg_daily_demand_surge").alias("r_demand"),
        F.col("reorder_point_surge").alias("r_point"), F.col("days_of_cover_surge").alias("receiver_cover_before"),
        F.col("lead_time_days").alias("receiver_lead_time"), "lead_time_decisive", "surge_action",
        F.col("latitude").alias("to_lat"), F.col("longitude").alias("to_lon")))
    floor = impact.groupBy(*PAIR).agg(F.max("reorder_point_surge").alias("surge_point"))
    batch = stock.groupBy(*PAIR).agg(F.min(F.struct(
        "expiry_date", "batch_id", "days_to_expiry", "remaining_qty")).alias("b"))
    spare = F.col("on_hand") - F.coalesce("surge_point", "reorder_point")
    offer = (rs.join(floor, PAIR, "left").withColumn("spare_units", spare).filter("spare_units >= 1")
             .join(batch, PAIR).filter(F.col("b.days_to_expiry") >= usable_days).join(at, "facility_id")
             .select(F.col("facility_id").alias("from_facility_id"), F.col("item_id").alias("supplied_item_id"),
                     F.col("item_name").alias("supplied_item_name"), F.col("atc_class").alias("donor_class"),
                     F.col("on_hand").alias("d_hand"), F.col("avg_daily_demand").alias("d_demand"),
                     F.col("days_of_cover").alias("donor_cover_before"), "spare_units",
                     F.col("b.batch_id").alias("fefo_batch_id"), F.col("b.expiry_date").alias("fefo_expiry_date"),
                     F.col("b.days_to_expiry").alias("fefo_days_to_expiry"),
                     F.col("b.remaining_qty").alias("fefo_batch_qty"),
                     F.col("latitude").alias("from_lat"), F.col("longitude").alias("from_lon")))
    best = best_donor(snapshot(need, "h10-need"), snapshot(offer, "h10-offer"),
                      ["to_facility_id", "requested_item_id", "surge_month"], max_km,
                      F.col("fefo_days_to_expiry") >= F.col("receiver_lead_time") + usable_days,
                      ["distance_km", "fefo_days_to_expiry", "from_facility_id", "supplied_item_id"],
                      grows=["fefo_days_to_expiry"], asks={"fefo_days_to_expiry": F.col("receiver_lead_time") + usable_days})
    want = to_long(F.greatest(F.lit(0.0), F.least(
        F.col("r_point") * target - F.col("r_hand"), F.col("spare_units"), F.col("fefo_batch_qty"))))
    claims = (best.withColumn("requested_quantity", want)
              .filter(F.col("requested_quantity") >= F.greatest(F.lit(1).cast("bigint"), F.ceil("r_demand")))
              .withColumn("_ven", ven_rank()).withColumn("_late", F.when(F.col("lead_time_decisive"), 0).otherwise(1))
              .withColumn("_days", F.floor("receiver_cover_before")))
    # the totals read the claims twice; the search is to run once
    run = running_totals(snapshot(claims, "h10-claims"), ["from_facility_id", "supplied_item_id", "surge_month"],
                         ["_ven", "_late", "_days"],
                         ["receiver_cover_before", "distance_km", "to_facility_id", "requested_item_id"],
                         {"cumulative_claim": F.col("requested_quantity"),
                          "claim_rank": F.lit(1)}).drop("_ven", "_late", "_days")
    earlier = F.col("cumulative_claim") - F.col("requested_quantity")
    given = F.least(F.col("requested_quantity"), F.greatest(F.col("spare_units") - earlier, F.lit(0.0)))
    return (run.withColumn("given", given).filter("given >= 1").select(
        transfer_id("to_facility_id", "requested_item_id", "from_facility_id", "supplied_item_id",
                    "surge_month").alias("recommendation_id"),
        "to_facility_id", "to_state", "to_district", "from_facility_id", "requested_item_id",
        "requested_item_name", "supplied_item_id", "supplied_item_name", "is_substitution", "ven_class",
        "unit", "atc_class", "surge_month", "surge_multiplier", "lead_time_decisive", "surge_action",
        F.col("claim_rank").cast("bigint").alias("claim_rank"), "requested_quantity",
        to_long("given").alias("quantity"),
        (F.col("cumulative_claim") > F.col("spare_units")).alias("donor_partially_exhausted"),
        "distance_km", "receiver_lead_time", "fefo_batch_id", "fefo_expiry_date", "fefo_days_to_expiry",
        "receiver_cover_before",
        rnd(ratio(F.col("r_hand") + F.col("given"), "r_demand"), 1).alias("receiver_cover_after"),
        "donor_cover_before",
        rnd(ratio(F.col("d_hand") - F.col("given"), "d_demand"), 1).alias("donor_cover_after")))


def surge_transfers(recs: DataFrame, month: DataFrame, limit: int | None = None) -> DataFrame:
    """One month only: the months are alternatives that share the same donor stock."""
    return (recs.join(month.select(F.col("month").alias("surge_month")), "surge_month", "left_semi")
            .orderBy(F.desc("lead_time_decisive"), "claim_rank", "distance_km", "recommendation_id").transform(upto, limit)
            .select("recommendation_id", "to_facility_id", "from_facility_id", "surge_month", "quantity",
                    "claim_rank", "distance_km", "lead_time_decisive", "donor_partially_exhausted"))


def surge_month(stock: DataFrame) -> DataFrame:
    return stock.agg(F.max("as_of_date").alias("d")).select(month_name("d").alias("month"))


def lead_time_bands(impact: DataFrame) -> DataFrame:
    d = F.col("lead_time_days")
    band = (F.when(d <= 5, "1. <= 5 days").when(d <= 10, "2. 6-10 days")
            .when(d <= 15, "3. 11-15 days").otherwise("4. > 15 days"))
    late = F.count_if("lead_time_decisive")
    return impact.groupBy(band.alias("band")).agg(
        F.count("*").alias("lines"), late.alias("transfer_only"), share(late, F.count("*")).alias("pct"))


def absorption_by_multiplier(absorption: DataFrame) -> DataFrame:
    holds = F.count_if("absorbs")
    return absorption.groupBy("multiplier").agg(
        F.count("*").alias("district_classes"), holds.alias("absorbs"),
        share(holds, F.count("*")).alias("pct"), F.sum("units_short").alias("units_short"))


def claims_by_ven(recs: DataFrame) -> DataFrame:
    return recs.groupBy("ven_class").agg(
        F.count("*").alias("transfers"), F.sum("quantity").alias("units"),
        rnd(ratio(F.sum("claim_rank"), F.count("*")), 2).alias("mean_claim_rank"),
        F.count_if("donor_partially_exhausted").alias("rationed"))


# -- scenarios ---------------------------------------------------------------------------

def _scope(rs: DataFrame, multiplier: float, district, atc_class) -> DataFrame:
    if not LOW <= float(multiplier) <= HIGH:
        raise ScenarioError(f"multiplier must be between {LOW:g} and {HIGH:g}")
    rows = rs.filter("atc_class IS NOT NULL AND avg_daily_demand > 0")
    if district:
        rows = rows.filter(F.col("district") == district)
    if atc_class:
        rows = rows.filter(F.col("atc_class") == atc_class)
    return rows


def scenario_facilities(rs: DataFrame, multiplier: float, district: str | None = None,
                        atc_class: str | None = None, z: float = SERVICE_Z,
                        sigma_exponent: float = 1.0) -> DataFrame:
    """Every line of the scope at the multiplier asked for; no scope means all districts."""
    rows = _scope(rs, multiplier, district, atc_class)
    mu = F.col("avg_daily_demand") * F.lit(float(multiplier))
    sd = F.col("demand_std_dev") * F.pow(F.lit(float(multiplier)), F.lit(sigma_exponent))
    limit, runs, action, short = _under(mu, sd, z)
    return rows.select(
        "district", "atc_class", "facility_id", "item_id", "lead_time_days", "on_hand", "avg_daily_demand",
        rnd(mu, 2).alias("avg_daily_demand_surge"), rnd(limit, 1).alias("reorder_point_surge"),
        rnd(runs, 1).alias("days_to_stockout"), (runs < F.col("lead_time_days")).alias("lead_time_decisive"),
        (F.col("on_hand") < limit).alias("needs_reorder_surge"), short.alias("shortfall_units"),
        action.alias("surge_action"))


def scenario_transfers(rs: DataFrame, facilities: DataFrame, multiplier: float,
                       district: str | None = None, atc_class: str | None = None,
                       z: float = SERVICE_Z, sigma_exponent: float = 1.0,
                       max_km: float = MAX_KM, target: float = TARGET) -> DataFrame:
    m = F.lit(float(multiplier))
    limit = reorder_threshold(F.col("avg_daily_demand") * m, F.col("demand_std_dev") * F.pow(m, F.lit(sigma_exponent)),
                              F.col("lead_time_days"), z)
    rows = (_scope(rs, multiplier, district, atc_class).join(places(facilities), "facility_id")
            .withColumn("limit", limit))
    need = rows.filter("on_hand < limit").select(
        "district", "atc_class", F.col("facility_id").alias("to_facility_id"),
        F.col("item_id").alias("requested_item_id"), "ven_class", F.col("lead_time_days").alias("receiver_lead_time"),
        (F.col("limit") * target - F.col("on_hand")).alias("wanted"),
        rnd(ratio("on_hand", F.col("avg_daily_demand") * m), 1).alias("days_to_stockout"),
        F.col("latitude").alias("to_lat"), F.col("longitude").alias("to_lon"))
    offer = rows.filter("on_hand > limit").select(
        "district", F.col("atc_class").alias("donor_class"), F.col("facility_id").alias("from_facility_id"),
        F.col("item_id").alias("supplied_item_id"), (F.col("on_hand") - F.col("limit")).alias("spare_units"),
        F.col("latitude").alias("from_lat"), F.col("longitude").alias("from_lon"))
    offer = first_of_place(offer, ["district", "donor_class", "supplied_item_id"])
    best = best_donor(snapshot(need, "h13-need"), snapshot(offer, "h13-offer"),
                      ["to_facility_id", "requested_item_id"], max_km, F.lit(True),
                      ["distance_km", "from_facility_id", "supplied_item_id"], also_on=["district"])
    return (best.withColumn("quantity", to_long(F.least("wanted", "spare_units"))).filter("quantity >= 1")
            .select("district", "atc_class", "to_facility_id", "requested_item_id", "ven_class",
                    "receiver_lead_time", "from_facility_id", "supplied_item_id", "is_substitution",
                    "quantity", "distance_km", "days_to_stockout"))


def scenario_verdict(lines: DataFrame, moves: DataFrame, multiplier: float) -> DataFrame:
    """Does each district hold: pooled stock against the slowest lead time."""
    per = lines.groupBy("district", "atc_class").agg(
        F.count("*").alias("facility_count"), F.count_if(F.col("surge_action") != "holds").alias("facilities_failing"),
        F.count_if("lead_time_decisive").alias("facilities_transfer_only"),
        F.min("days_to_stockout").alias("first_stockout_days"), F.sum("on_hand").alias("district_on_hand"),
        rnd(sum4("avg_daily_demand"), 2).alias("district_daily_demand"),
        F.max("lead_time_days").alias("slowest_lead_time"))
    n = moves.groupBy("district", "atc_class").agg(F.count("*").alias("transfers"))
    spike = F.col("district_daily_demand") * F.lit(float(multiplier))
    days = rnd(ratio("district_on_hand", spike), 1)
    holds = days >= F.col("slowest_lead_time")
    thin = rnd(ratio("district_on_hand", F.col("district_daily_demand") * F.col("slowest_lead_time")), 2)
    return (per.join(n, ["district", "atc_class"], "left").withColumn("transfers", nvl0("transfers"))
            .select(*per.columns, "transfers", days.alias("absorption_days"), holds.alias("district_holds"),
                    thin.alias("max_multiplier_absorbed"), (thin < 1).alias("structurally_thin"),
                    F.when(holds, F.lit(0).cast("bigint")).otherwise(F.greatest(
                        to_long(spike * F.col("slowest_lead_time") - F.col("district_on_hand")),
                        F.lit(0).cast("bigint"))).alias("units_short"),
                    F.when(holds, "holds").when(F.col("transfers") > 0, "partly").otherwise("outside_help").alias("verdict")))


def scenario_options(rs: DataFrame) -> DataFrame:
    return (rs.filter("atc_class IS NOT NULL AND avg_daily_demand > 0")
            .groupBy("state", "district", "atc_class").agg(
                F.min("ven_class").alias("ven_class"), F.count_distinct("facility_id").alias("facilities"),
                F.count_distinct("item_name").alias("items"), joined("item_name", ",", 4).alias("example_items"),
                F.sum("on_hand").alias("on_hand"), F.max("lead_time_days").alias("slowest_lead_time"))
            .filter("facilities >= 2"))
