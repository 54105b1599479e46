"""Surge detection and supply under surge as SQL."""
from ..functions.months import CALENDAR
from .base import div, km, pct, register, rnd, tolong
from .stock import m4, s4

_Z, _R, _A = "1.5", "1.2", "10"        # the cut points the registered queries use
register("t_resid", """
SELECT *, quantile_cont(residual, 0.5) OVER w AS med, stddev_samp(residual) OVER w AS sd, avg(residual) OVER w AS mu
FROM (SELECT v.*, p.m AS pooled, baseline * p.m AS expected, value - baseline * p.m AS residual
      FROM t_vectors v JOIN t_pooled p USING (atc_class, month))
WINDOW w AS (PARTITION BY state, district_key, atc_class)
""")
_z = "(0.6745::DOUBLE * ((residual - med) / nullif(mad0, 0)))"
_t = "(value / nullif(expected, 0))"
register("t_signals", f"""
SELECT state, district_key, atc_class, month, {rnd('value', 1)} AS observed, {rnd('expected', 1)} AS expected,
  {rnd('baseline', 1)} AS baseline, {rnd('pooled', 4)} AS pooled_multiplier, {rnd('residual', 1)} AS residual, months_with_data,
  {rnd(div('residual - mu', 'sd'), 2)} AS z_classical, {rnd(_z, 2)} AS z_modified, {rnd('mad0', 2)} AS mad,
  {rnd(_t, 2)} AS surge_multiplier, {_z} >= {_Z} AS passes_statistic, {_t} >= {_R} AS passes_ratio, value >= {_A} AS passes_magnitude,
  mad0 IS NULL OR mad0 = 0 AS mad_undefined,
  coalesce(mad0 > 0 AND {_z} >= {_Z} AND {_t} >= {_R} AND value >= {_A}, false) AS is_surge
FROM (SELECT *, quantile_cont(abs(residual - med), 0.5) OVER (PARTITION BY state, district_key, atc_class) AS mad0 FROM t_resid)
""")
register("t_labels", """
SELECT substr(atc_code, 1, 5) AS atc_class, demand_driver, signal_class, count(DISTINCT item_id) AS items_driven,
  array_to_string(list_sort(list(DISTINCT display_name))[1:4], ',') AS example_items
FROM t_items JOIN (VALUES ('1-URGENT', 'leading'), ('2-HIGH', 'leading'), ('3-MEDIUM', 'coincident'),
  ('4-NOT SPECIFIED', 'programme'), ('5-LOW', 'coincident')) l(demand_driver, signal_class) USING (demand_driver)
WHERE atc_code IS NOT NULL GROUP BY ALL
""")
_MAX = ", ".join(f"max({c}) AS {c}" for c in ("observed", "expected", "baseline", "pooled_multiplier",
                                              "surge_multiplier", "z_modified", "z_classical", "mad"))
register("t_cards", f"""
SELECT s.state, district_key, month, coalesce(demand_driver, s.atc_class) AS signal_key, min(s.atc_class) AS atc_class,
  array_to_string(list_sort(list(DISTINCT s.atc_class)), ', ') AS atc_classes, {_MAX},
  bool_and(passes_statistic) AS passes_statistic, bool_and(passes_ratio) AS passes_ratio, bool_and(passes_magnitude) AS passes_magnitude,
  min(demand_driver) AS signal_indicator, min(signal_class) AS signal_class,
  array_to_string(coalesce(list_sort(list(DISTINCT example_items) FILTER (example_items IS NOT NULL)), []), ', ') AS example_items
FROM t_signals s LEFT JOIN t_labels l ON l.atc_class = s.atc_class WHERE is_surge GROUP BY 1, 2, 3, 4
""")


def under(mu: str, sd: str) -> str:
    return f"({mu} * lead_time_days + 1.65::DOUBLE * ({sd}) * sqrt(lead_time_days::DOUBLE))"


register("t_impact", f"""
SELECT facility_id, facility_name, state, district, item_id, item_name, unit, ven_class, atc_class, lead_time_days,
  lead_time_is_estimated, distance_to_hq_km, surge_month, surge_multiplier, z_modified, driver_observed, driver_expected, on_hand,
  avg_daily_demand, reorder_point, days_of_cover, needs_reorder, status AS status_baseline, {rnd('mu', 2)} AS avg_daily_demand_surge,
  {rnd('lim', 1)} AS reorder_point_surge, {rnd('runs', 1)} AS days_of_cover_surge, {rnd('runs', 1)} AS days_to_stockout,
  on_hand < lim AS needs_reorder_surge, runs < lead_time_days AS lead_time_decisive,
  NOT needs_reorder AND on_hand < lim AS newly_at_risk, greatest({rnd('(lim - on_hand)')}, 0.0::DOUBLE) AS shortfall_units,
  CASE WHEN runs < lead_time_days THEN 'transfer_only' WHEN on_hand < lim THEN 'reorder_now' ELSE 'holds' END AS surge_action
FROM (SELECT *, on_hand::DOUBLE / nullif(mu, 0) AS runs, {under('mu', 'sd')} AS lim
  FROM (SELECT r.*, s.month AS surge_month, s.surge_multiplier, s.z_modified, {tolong('s.observed')} AS driver_observed,
      {tolong('s.expected')} AS driver_expected, avg_daily_demand * surge_multiplier AS mu,
      demand_std_dev * pow(surge_multiplier, 1.0::DOUBLE) AS sd
    FROM t_reorder r JOIN t_signals s ON upper(r.district) = s.district_key AND r.atc_class = s.atc_class
    WHERE is_surge AND avg_daily_demand > 0))
""")
_days = rnd(div("district_on_hand", "(district_daily_demand * multiplier)"), 1)
register("t_absorb", f"""
SELECT *, {_days} AS absorption_days, {_days} >= slowest_lead_time AS absorbs,
  CASE WHEN {_days} >= slowest_lead_time THEN 0 ELSE greatest({tolong('(district_daily_demand * multiplier * slowest_lead_time - district_on_hand)')}, 0) END AS units_short,
  {rnd(div('district_on_hand', '(district_daily_demand * slowest_lead_time)'), 2)} AS max_multiplier_absorbed
FROM (SELECT state, district, atc_class, min(ven_class) AS ven_class, count(DISTINCT facility_id) AS facilities, count(*) AS stock_rows,
    sum(on_hand)::BIGINT AS district_on_hand, {rnd(s4('avg_daily_demand'), 2)} AS district_daily_demand,
    max(lead_time_days) AS slowest_lead_time, min(lead_time_days) AS fastest_lead_time
  FROM t_reorder WHERE atc_class IS NOT NULL AND avg_daily_demand > 0 GROUP BY ALL)
CROSS JOIN (VALUES (2.0::DOUBLE), (3.0::DOUBLE), (5.0::DOUBLE)) m(multiplier)
""")
register("t_surge_pairs", f"""
SELECT *, {rnd('raw', 1)} AS distance_km FROM (
  SELECT d.facility_id AS to_facility_id, d.state AS to_state, d.district AS to_district, d.item_id AS requested_item_id,
    d.item_name AS requested_item_name, d.ven_class, d.unit, d.atc_class, d.surge_month, d.surge_multiplier,
    d.on_hand AS r_hand, d.avg_daily_demand_surge AS r_demand, d.reorder_point_surge AS r_point,
    d.days_of_cover_surge AS receiver_cover_before, d.lead_time_days AS receiver_lead_time, d.lead_time_decisive, d.surge_action,
    s.facility_id AS from_facility_id, s.item_id AS supplied_item_id, s.item_name AS supplied_item_name,
    s.on_hand AS d_hand, s.avg_daily_demand AS d_demand, s.days_of_cover AS donor_cover_before,
    s.on_hand - coalesce(g.p, s.reorder_point) AS spare_units, s.item_id <> d.item_id AS is_substitution,
    b.batch_id AS fefo_batch_id, b.expiry_date AS fefo_expiry_date, b.days_to_expiry AS fefo_days_to_expiry, b.remaining_qty AS bq,
    {km('fd.latitude', 'fd.longitude', 'fs.latitude', 'fs.longitude')} AS raw
  FROM t_impact d JOIN t_reorder s ON s.facility_id <> d.facility_id AND (s.item_id = d.item_id OR s.atc_class = d.atc_class)
  LEFT JOIN (SELECT facility_id, item_id, max(reorder_point_surge) AS p FROM t_impact GROUP BY ALL) g
    ON g.facility_id = s.facility_id AND g.item_id = s.item_id
  JOIN t_facilities fd ON fd.facility_id = d.facility_id JOIN t_facilities fs ON fs.facility_id = s.facility_id
  JOIN (SELECT * FROM t_batches QUALIFY row_number() OVER (PARTITION BY facility_id, item_id
        ORDER BY expiry_date ASC NULLS FIRST, batch_id) = 1) b ON b.facility_id = s.facility_id AND b.item_id = s.item_id
  WHERE d.needs_reorder_surge AND fd.has_valid_coords AND fs.has_valid_coords)
WHERE spare_units >= 1 AND raw <= 300 AND fefo_days_to_expiry >= receiver_lead_time + 30
""")
register("t_surge_recs", f"""
SELECT sha256(concat_ws('|', to_facility_id, requested_item_id, from_facility_id, supplied_item_id, surge_month)) AS recommendation_id,
  to_facility_id, to_state, to_district, from_facility_id, requested_item_id, requested_item_name, supplied_item_id,
  supplied_item_name, is_substitution, ven_class, unit, atc_class, surge_month, surge_multiplier, lead_time_decisive, surge_action,
  claim_rank, requested_quantity, {tolong('given')} AS quantity, cumulative > spare_units AS donor_partially_exhausted, distance_km,
  receiver_lead_time, fefo_batch_id, fefo_expiry_date, fefo_days_to_expiry, receiver_cover_before,
  {rnd(div('r_hand + given', 'r_demand'), 1)} AS receiver_cover_after, donor_cover_before,
  {rnd(div('d_hand - given', 'd_demand'), 1)} AS donor_cover_after
FROM (SELECT *, least(requested_quantity::DOUBLE, greatest(spare_units - (cumulative - requested_quantity), 0.0::DOUBLE)) AS given
  FROM (SELECT *, sum(requested_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS cumulative, row_number() OVER w AS claim_rank
    FROM (SELECT *, {tolong('greatest(0.0::DOUBLE, least(r_point * 1.5::DOUBLE - r_hand, spare_units, bq))')} AS requested_quantity
      FROM t_surge_pairs QUALIFY row_number() OVER (PARTITION BY to_facility_id, requested_item_id, surge_month
        ORDER BY is_substitution, distance_km, fefo_days_to_expiry, from_facility_id, supplied_item_id) = 1)
    WHERE requested_quantity >= greatest(1, ceil(r_demand))
    WINDOW w AS (PARTITION BY from_facility_id, supplied_item_id, surge_month
      ORDER BY CASE ven_class WHEN 'Vital' THEN 1 WHEN 'Essential' THEN 2 ELSE 3 END, lead_time_decisive DESC,
        receiver_cover_before, distance_km, to_facility_id, requested_item_id)))
WHERE given >= 1
""")
register("t_month", f"SELECT {CALENDAR}[month(max(as_of_date))] AS month FROM t_batches")
_S = f"""SELECT district, atc_class, facility_id, item_id, lead_time_days, on_hand, avg_daily_demand, {rnd('mu', 2)} AS avg_daily_demand_surge,
  {rnd('lim', 1)} AS reorder_point_surge, {rnd('runs', 1)} AS days_to_stockout, runs < lead_time_days AS lead_time_decisive,
  on_hand < lim AS needs_reorder_surge, greatest({rnd('(lim - on_hand)')}, 0.0::DOUBLE) AS shortfall_units,
  CASE WHEN runs < lead_time_days THEN 'transfer_only' WHEN on_hand < lim THEN 'reorder_now' ELSE 'holds' END AS surge_action
FROM t_scoped"""
register("t_scoped", f"""
SELECT *, on_hand::DOUBLE / nullif(mu, 0) AS runs, {under('mu', 'demand_std_dev * pow(3.0::DOUBLE, 1.0::DOUBLE)')} AS lim
FROM (SELECT *, avg_daily_demand * 3.0::DOUBLE AS mu FROM t_reorder WHERE atc_class IS NOT NULL AND avg_daily_demand > 0)
""")
register("t_scenario", _S)
register("t_moves", f"""
SELECT district, atc_class, to_facility_id, requested_item_id, ven_class, receiver_lead_time, from_facility_id, supplied_item_id,
  is_substitution, {tolong('least(wanted, spare)')} AS quantity, distance_km, days_to_stockout
FROM (SELECT n.district, n.atc_class, n.facility_id AS to_facility_id, n.item_id AS requested_item_id, n.ven_class,
    n.lead_time_days AS receiver_lead_time, s.facility_id AS from_facility_id, s.item_id AS supplied_item_id,
    s.item_id <> n.item_id AS is_substitution, n.lim * 1.5::DOUBLE - n.on_hand AS wanted, s.on_hand - s.lim AS spare,
    {rnd(km('fn.latitude', 'fn.longitude', 'fs.latitude', 'fs.longitude'), 1)} AS distance_km, {rnd('n.runs', 1)} AS days_to_stockout
  FROM t_scoped n JOIN t_scoped s ON s.district = n.district AND s.atc_class = n.atc_class AND s.facility_id <> n.facility_id
  JOIN t_facilities fn ON fn.facility_id = n.facility_id JOIN t_facilities fs ON fs.facility_id = s.facility_id
  WHERE n.on_hand < n.lim AND s.on_hand > s.lim AND fn.has_valid_coords AND fs.has_valid_coords
    AND {km('fn.latitude', 'fn.longitude', 'fs.latitude', 'fs.longitude')} <= 300
  QUALIFY row_number() OVER (PARTITION BY n.facility_id, n.item_id ORDER BY is_substitution, distance_km, s.facility_id, s.item_id) = 1)
WHERE {tolong('least(wanted, spare)')} >= 1
""")
_vd = rnd(div("district_on_hand", "(district_daily_demand * 3.0::DOUBLE)"), 1)
_thin = rnd(div("district_on_hand", "(district_daily_demand * slowest_lead_time)"), 2)
SQL = {
    "H1_surge_signals": "SELECT * FROM t_signals",
    "H2_surge_summary": """SELECT count(*) AS series_months, count(DISTINCT district_key) AS districts, count(DISTINCT atc_class) AS atc_classes,
        count(*) FILTER (mad_undefined) AS mad_undefined, count(*) FILTER (is_surge) AS surges,
        count(*) FILTER (passes_statistic) AS pass_stat, count(*) FILTER (passes_statistic AND NOT passes_ratio) AS stat_but_small_ratio,
        count(*) FILTER (passes_statistic AND passes_ratio AND NOT passes_magnitude) AS stat_but_too_few,
        max(z_classical) AS max_z_classical, max(z_modified) AS max_z_modified, max(surge_multiplier) AS max_multiplier,
        max(z_classical) <= 11 / sqrt(12) + 0.01 AS ceiling_ok FROM t_signals""",
    "H3_surge_by_class": f"""SELECT atc_class, count(*) AS surges, count(DISTINCT district_key) AS districts,
        {rnd('max(surge_multiplier)', 1)} AS peak FROM t_signals WHERE is_surge GROUP BY ALL""",
    "H3_top_surges": f"""SELECT s.state, district_key, s.atc_class, month, {tolong('observed')} AS observed, {tolong('expected')} AS expected,
        surge_multiplier, z_modified, z_classical, count(DISTINCT r.facility_id) AS facilities
        FROM t_signals s JOIN t_reorder r ON upper(r.district) = s.district_key AND r.atc_class = s.atc_class WHERE is_surge
        GROUP BY ALL ORDER BY surge_multiplier DESC, s.state, district_key, s.atc_class, month LIMIT 10""",
    "H4_signal_labels": "SELECT * FROM t_labels",
    "H5_lead_measure": f"""
        WITH p AS (SELECT district_key, indicator, list_position({CALENDAR}, month) AS m FROM t_demand
          WHERE indicator IN ('1-URGENT', '3-MEDIUM') QUALIFY row_number() OVER (PARTITION BY district_key, indicator
            ORDER BY value DESC, list_position({CALENDAR}, month)) = 1)
        SELECT ((b.m - a.m + 12) % 12)::INTEGER AS gap, count(*) AS districts FROM p a JOIN p b USING (district_key)
        WHERE a.indicator = '1-URGENT' AND b.indicator = '3-MEDIUM' GROUP BY ALL""",
    "H6_signals_by_class_kind": f"""SELECT signal_class, count(*) AS surge_months, count(DISTINCT district_key) AS districts,
        {rnd('max(surge_multiplier)', 1)} AS peak FROM t_signals JOIN t_labels USING (atc_class) WHERE is_surge GROUP BY ALL""",
    "H7_surge_cards": """SELECT * FROM t_cards ORDER BY surge_multiplier DESC, z_modified DESC, state, district_key, month, signal_key""",
    "H8_surge_supply_impact": "SELECT * FROM t_impact",
    "H8_surge_impact_list": """SELECT * FROM t_impact ORDER BY lead_time_decisive DESC, newly_at_risk DESC, days_to_stockout,
        facility_id, item_id, surge_month""",
    "H9_network_absorption": "SELECT * FROM t_absorb",
    "H10_surge_recommendations": "SELECT * FROM t_surge_recs",
    "H11_lead_time_bands": f"""SELECT CASE WHEN lead_time_days <= 5 THEN '1. <= 5 days' WHEN lead_time_days <= 10 THEN '2. 6-10 days'
        WHEN lead_time_days <= 15 THEN '3. 11-15 days' ELSE '4. > 15 days' END AS band, count(*) AS lines,
        count(*) FILTER (lead_time_decisive) AS transfer_only, {pct('count(*) FILTER (lead_time_decisive)', 'count(*)')} AS pct
        FROM t_impact GROUP BY 1""",
    "H12_absorption_by_multiplier": f"""SELECT multiplier, count(*) AS district_classes, count(*) FILTER (absorbs) AS absorbs,
        {pct('count(*) FILTER (absorbs)', 'count(*)')} AS pct, sum(units_short)::BIGINT AS units_short FROM t_absorb GROUP BY ALL""",
    "H12_claims_by_ven": f"""SELECT ven_class, count(*) AS transfers, sum(quantity)::BIGINT AS units,
        {rnd(div('sum(claim_rank)', 'count(*)'), 2)} AS mean_claim_rank, count(*) FILTER (donor_partially_exhausted) AS rationed
        FROM t_surge_recs GROUP BY ALL""",
    "H13_scenario_facilities": "SELECT * FROM t_scenario",
    "H13_scenario_transfers": "SELECT * FROM t_moves",
    "H13_scenario_verdict": f"""
        WITH p AS (SELECT district, atc_class, count(*) AS facility_count, count(*) FILTER (surge_action <> 'holds') AS facilities_failing,
          count(*) FILTER (lead_time_decisive) AS facilities_transfer_only, min(days_to_stockout) AS first_stockout_days,
          sum(on_hand)::BIGINT AS district_on_hand, {rnd(s4('avg_daily_demand'), 2)} AS district_daily_demand,
          max(lead_time_days) AS slowest_lead_time FROM t_scenario GROUP BY ALL),
        n AS (SELECT district, atc_class, count(*) AS transfers FROM t_moves GROUP BY ALL)
        SELECT p.*, coalesce(transfers, 0) AS transfers, {_vd} AS absorption_days, {_vd} >= slowest_lead_time AS district_holds,
          {_thin} AS max_multiplier_absorbed, {_thin} < 1 AS structurally_thin,
          CASE WHEN {_vd} >= slowest_lead_time THEN 0 ELSE greatest({tolong('(district_daily_demand * 3.0::DOUBLE * slowest_lead_time - district_on_hand)')}, 0) END AS units_short,
          CASE WHEN {_vd} >= slowest_lead_time THEN 'holds' WHEN coalesce(transfers, 0) > 0 THEN 'partly' ELSE 'outside_help' END AS verdict
        FROM p LEFT JOIN n USING (district, atc_class)""",
    "H14_scenario_options": """SELECT state, district, atc_class, min(ven_class) AS ven_class, count(DISTINCT facility_id) AS facilities,
        count(DISTINCT item_name) AS items, array_to_string(list_sort(list(DISTINCT item_name))[1:4], ',') AS example_items,
        sum(on_hand)::BIGINT AS on_hand, max(lead_time_days) AS slowest_lead_time FROM t_reorder
        WHERE atc_class IS NOT NULL AND avg_daily_demand > 0 GROUP BY ALL HAVING count(DISTINCT facility_id) >= 2""",
    "H15_surge_month": "SELECT * FROM t_month",
    "H15_surge_transfers": """SELECT recommendation_id, to_facility_id, from_facility_id, surge_month, quantity, claim_rank, distance_km,
        lead_time_decisive, donor_partially_exhausted FROM t_surge_recs WHERE surge_month = (SELECT month FROM t_month)
        ORDER BY lead_time_decisive DESC, claim_rank, distance_km, recommendation_id""",
    "H16_early_warning_count": """SELECT month, count(DISTINCT district_key) AS districts FROM t_cards
        WHERE signal_class = 'leading' GROUP BY ALL""",
}
