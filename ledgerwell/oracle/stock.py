"""Stock position, demand and reorder point as SQL."""
from .base import div, km, pct, register, rnd, tolong

register("t_consumed", """
SELECT facility_id, item_id, sum(quantity) FILTER (event_type = 'dispensed') AS total_dispensed,
  sum(quantity) FILTER (event_type = 'expired') AS total_expired,
  sum(quantity) FILTER (event_type = 'dispatched') AS total_dispatched, sum(quantity) AS total_consumed
FROM t_stock WHERE event_type IN ('dispensed', 'expired', 'dispatched', 'lost') GROUP BY ALL
""")
register("t_today", "SELECT max(event_date) AS today FROM t_stock")
register("t_batches", """
SELECT * FROM (
  SELECT b.facility_id, b.item_id, b.event_id AS batch_id, b.event_date AS received_date, b.expiry_date,
    b.quantity AS batch_qty,
    greatest(0, least(b.quantity, sum(b.quantity) OVER (PARTITION BY b.facility_id, b.item_id
      ORDER BY b.expiry_date ASC NULLS LAST, b.event_id ROWS UNBOUNDED PRECEDING)
      - coalesce(c.total_consumed, 0)))::BIGINT AS remaining_qty,
    b.expiry_date - today AS days_to_expiry, coalesce(b.expiry_date <= today, false) AS is_expired,
    b.expiry_date IS NULL AS expiry_unknown, today AS as_of_date
  FROM t_stock b CROSS JOIN t_today LEFT JOIN t_consumed c USING (facility_id, item_id)
  WHERE b.event_type = 'received')
WHERE remaining_qty > 0
""")
register("t_balance", """
SELECT facility_id, item_id, sum(CASE WHEN event_type = 'received' THEN quantity ELSE -quantity END)::BIGINT AS balance
FROM t_stock GROUP BY ALL
""")
register("t_hq", f"""
SELECT admin_l1, admin_l2, facility_id AS hq_id, latitude AS h_lat, longitude AS h_lon
FROM (SELECT f.*, row_number() OVER (PARTITION BY f.admin_l1, f.admin_l2 ORDER BY
        CASE facility_type WHEN 'dis_h' THEN 1 WHEN 's_t_h' THEN 2 ELSE 3 END,
        {km('latitude', 'longitude', 'c_lat', 'c_lon')}, facility_id) AS rn
      FROM t_valid f JOIN (SELECT admin_l1, admin_l2,
            sum({rnd('latitude', 4)}::DECIMAL(28,4))::DOUBLE / count(*) AS c_lat,
            sum({rnd('longitude', 4)}::DECIMAL(28,4))::DOUBLE / count(*) AS c_lon
          FROM t_valid GROUP BY ALL) USING (admin_l1, admin_l2)
      WHERE facility_type IN ('dis_h', 's_t_h', 'chc'))
WHERE rn = 1
""")
register("t_valid", """
SELECT * FROM t_facilities_raw WHERE latitude BETWEEN 6 AND 38 AND longitude BETWEEN 68 AND 98
""")
register("t_rawkm", f"""
SELECT facility_id, admin_l1, admin_l2, hq_id, {rnd(km('latitude', 'longitude', 'h_lat', 'h_lon'), 1)} AS raw_km
FROM t_valid JOIN t_hq USING (admin_l1, admin_l2)
""")
register("t_lead", f"""
SELECT facility_id, hq_id AS district_hq_id, dkm AS distance_to_hq_km, raw_km > 200 AS lead_time_is_estimated,
  least(30, greatest(7, {tolong('7.0::DOUBLE + 0.08::DOUBLE * dkm')}))::BIGINT AS lead_time_days, 30::BIGINT AS indent_cycle_days
FROM (SELECT r.*, CASE WHEN raw_km > 200 THEN coalesce(m, 25.0) ELSE raw_km END AS dkm
      FROM t_rawkm r LEFT JOIN (SELECT admin_l1, admin_l2, quantile_disc(raw_km, 0.5) AS m
        FROM t_rawkm WHERE raw_km <= 200 GROUP BY ALL) USING (admin_l1, admin_l2))
""")
register("t_facilities", """
SELECT f.*, coalesce(latitude BETWEEN 6 AND 38 AND longitude BETWEEN 68 AND 98, false) AS has_valid_coords,
  district_hq_id, distance_to_hq_km, lead_time_is_estimated, lead_time_days, indent_cycle_days
FROM t_facilities_raw f LEFT JOIN t_lead USING (facility_id)
""")
register("t_daily", """
SELECT facility_id, item_id, event_date AS day, coalesce(sum(quantity) FILTER (event_type = 'dispensed'), 0)::BIGINT AS quantity,
  count(*) FILTER (event_type = 'dispensed') AS n
FROM t_stock WHERE facility_id IN (SELECT facility_id FROM t_facilities WHERE is_forecast_facility) GROUP BY ALL
""")
register("t_training", """
SELECT facility_id, item_id, day, quantity FROM t_daily
WHERE n > 0 AND (facility_id, item_id) IN
  (SELECT (facility_id, item_id) FROM t_daily GROUP BY facility_id, item_id HAVING count(*) >= 8)
""")
register("t_forecast", f"""
SELECT s.facility_id, s.item_id, d.day, {rnd('coalesce(w.m, s.m)', 4)} AS value
FROM (SELECT facility_id, item_id, sum(quantity)::DOUBLE / count(*) AS m FROM t_training GROUP BY ALL) s
CROSS JOIN (SELECT ((SELECT max(day) FROM t_training) + h::INTEGER)::DATE AS day FROM range(1, 31) t(h)) d
LEFT JOIN (SELECT facility_id, item_id, dayofweek(day) AS dow, sum(quantity)::DOUBLE / count(*) AS m
           FROM t_training GROUP BY ALL) w
  ON w.facility_id = s.facility_id AND w.item_id = s.item_id AND w.dow = dayofweek(d.day)
""")
register("t_baseline", f"""
SELECT f.facility_id, f.item_id, {rnd('m', 2)} AS avg_daily_demand,
  {rnd('coalesce(sd, 0)', 2)} AS demand_std_dev, observed_days
FROM (SELECT facility_id, item_id, sum(value::DECIMAL(28,4))::DOUBLE / count(*) AS m FROM t_forecast GROUP BY ALL) f
LEFT JOIN (SELECT facility_id, item_id, stddev_samp(quantity) AS sd, count(*) AS observed_days
           FROM t_stock WHERE event_type = 'dispensed' GROUP BY ALL) USING (facility_id, item_id)
""")
_LIMIT = "(mu * lead_time_days + 1.65::DOUBLE * sd * sqrt(lead_time_days::DOUBLE))"
register("t_reorder", f"""
SELECT facility_id, facility_name, state, district, lead_time_days, distance_to_hq_km, lead_time_is_estimated,
  item_id, item_name, unit, ven_class, atc_code, atc_class, on_hand, soonest_expiry, days_to_soonest_expiry,
  mu AS avg_daily_demand, sd AS demand_std_dev,
  {rnd('(1.65::DOUBLE * sd * sqrt(lead_time_days::DOUBLE))', 1)} AS safety_stock,
  {rnd('lim', 1)} AS reorder_point, {rnd('(mu * 14.0::DOUBLE)', 1)} AS legacy_threshold,
  {rnd('cover', 1)} AS days_of_cover, on_hand <= lim AS needs_reorder,
  {rnd("(CASE ven_class WHEN 'Vital' THEN 3.0::DOUBLE WHEN 'Essential' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * greatest(0.0::DOUBLE, 1.0::DOUBLE - on_hand::DOUBLE / nullif(lim, 0)))", 3)} AS priority_score,
  CASE WHEN on_hand <= 0 THEN 'stocked_out' WHEN cover <= lead_time_days THEN 'critical'
    WHEN on_hand <= lim THEN 'reorder' ELSE 'ok' END AS status, observed_days
FROM (
  SELECT b.facility_id, f.name AS facility_name, f.admin_l1 AS state, f.admin_l2 AS district, f.lead_time_days,
    f.distance_to_hq_km, f.lead_time_is_estimated, b.item_id, i.display_name AS item_name, i.unit, i.ven_class,
    i.atc_code, substr(i.atc_code, 1, 5) AS atc_class, coalesce(h.on_hand, 0)::BIGINT AS on_hand, h.soonest_expiry,
    h.days_to_soonest_expiry, b.avg_daily_demand AS mu, b.demand_std_dev AS sd, b.observed_days,
    b.avg_daily_demand * f.lead_time_days + 1.65::DOUBLE * b.demand_std_dev * sqrt(f.lead_time_days::DOUBLE) AS lim,
    coalesce(h.on_hand, 0)::DOUBLE / nullif(b.avg_daily_demand, 0) AS cover
  FROM t_baseline b JOIN t_facilities f USING (facility_id) JOIN t_items i USING (item_id)
  LEFT JOIN (SELECT facility_id, item_id, sum(remaining_qty) AS on_hand, min(expiry_date) AS soonest_expiry,
      min(days_to_expiry) AS days_to_soonest_expiry FROM t_batches GROUP BY ALL) h USING (facility_id, item_id)
  WHERE f.is_forecast_facility AND f.lead_time_days IS NOT NULL)
""")


def m4(x: str) -> str:
    """Mean that is exact at four decimals."""
    return f"(sum({rnd(x, 4)}::DECIMAL(28,4))::DOUBLE / nullif(count({x}), 0))"


def s4(x: str) -> str:
    return f"sum({rnd(x, 4)}::DECIMAL(28,4))::DOUBLE"


register("t_cover", f"""
SELECT display_name, ven_class, unit, daily_demand, greatest(coalesce(h.on_hand, 0), 0) AS on_hand,
  greatest(coalesce(h.on_hand, 0), 0)::DOUBLE / nullif(daily_demand, 0) AS days_of_cover
FROM (SELECT facility_id, item_id, {m4('value')} AS daily_demand FROM t_forecast GROUP BY ALL)
JOIN (SELECT facility_id FROM t_facilities WHERE is_forecast_facility) USING (facility_id)
JOIN t_items USING (item_id)
LEFT JOIN (SELECT facility_id, item_id, coalesce(sum(quantity) FILTER (event_type = 'received'), 0)
    - coalesce(sum(quantity) FILTER (event_type = 'dispensed'), 0) AS on_hand FROM t_stock GROUP BY ALL) h
  USING (facility_id, item_id)
""")
register("t_alert_keys", """
SELECT DISTINCT facility_id, item_id FROM t_captures WHERE resource_type = 'medicine'
""")
register("t_pick", """
SELECT e.facility_id, e.item_id, f.name AS facility_name, i.display_name AS item_name, i.unit, sum(quantity)::BIGINT AS total
FROM t_stock e JOIN t_facilities f USING (facility_id) JOIN t_items i USING (item_id)
WHERE f.is_forecast_facility GROUP BY ALL ORDER BY total DESC, e.facility_id, e.item_id LIMIT 1
""")

SQL = {
    "D1_as_of_date": "SELECT max(event_date) AS today FROM t_stock",
    "D2_consumed": """SELECT facility_id, item_id, coalesce(total_dispensed, 0)::BIGINT AS total_dispensed,
        coalesce(total_expired, 0)::BIGINT AS total_expired, coalesce(total_dispatched, 0)::BIGINT AS total_dispatched,
        total_consumed::BIGINT AS total_consumed FROM t_consumed""",
    "D3_current_stock": "SELECT * FROM t_batches",
    "D4_stock_reconcile": """SELECT count(*) FILTER (coalesce(batched, 0) <> balance) AS mismatches,
        count(*) FILTER (balance < 0) AS below_zero, count(*) AS compared
        FROM t_balance LEFT JOIN (SELECT facility_id, item_id, sum(remaining_qty) AS batched FROM t_batches GROUP BY ALL)
        USING (facility_id, item_id)""",
    "D5_stock_verify": """SELECT count(*) AS batch_rows, count(DISTINCT facility_id) AS facilities,
        count(DISTINCT facility_id || '|' || item_id) AS series, sum(remaining_qty)::BIGINT AS units_on_hand,
        count(*) FILTER (is_expired) AS expired_batches,
        sum(CASE WHEN is_expired THEN remaining_qty ELSE 0 END)::BIGINT AS expired_units,
        count(*) FILTER (NOT is_expired AND days_to_expiry <= 90) AS expiring_90d_batches,
        sum(CASE WHEN NOT is_expired AND days_to_expiry <= 90 THEN remaining_qty ELSE 0 END)::BIGINT AS expiring_90d_units,
        count(*) FILTER (NOT is_expired AND days_to_expiry <= 180) AS expiring_180d_batches, max(as_of_date) AS as_of
        FROM t_batches""",
    "D6_recorded_balance": """SELECT facility_id, item_id, coalesce(balance, 0)::BIGINT AS balance
        FROM t_alert_keys LEFT JOIN t_balance USING (facility_id, item_id)""",
    "D7_health_mix": f"""SELECT count(*) FILTER (days_of_cover < 7) AS critical,
        count(*) FILTER (days_of_cover >= 7 AND days_of_cover < 14) AS low,
        count(*) FILTER (days_of_cover >= 14) AS healthy, count(*) AS total_series,
        {rnd(m4('days_of_cover'), 1)} AS mean_days_of_cover FROM t_cover""",
    "D7_health_shortages": f"""SELECT display_name AS item_name, ven_class, unit,
        {tolong(s4('greatest(daily_demand * 14 - on_hand, 0.0::DOUBLE)'))} AS deficit_units,
        count(*) FILTER (days_of_cover < 14) AS facilities_affected
        FROM t_cover GROUP BY ALL HAVING deficit_units > 0 AND facilities_affected > 0
        ORDER BY deficit_units DESC, item_name LIMIT 6""",
    "D8_training_set": "SELECT * FROM t_training",
    "D8_training_preflight": """SELECT count(DISTINCT facility_id || '|' || item_id) AS series, count(*) AS rows_in,
        min(day) AS first_day, max(day) AS last_day, count(DISTINCT facility_id || '|' || item_id) > 5000 AS over_ceiling
        FROM t_training""",
    "D9_weekday_forecast": "SELECT * FROM t_forecast",
    "D11_demand_baseline": "SELECT * FROM t_baseline",
    "D12_reorder_status": "SELECT * FROM t_reorder",
    "D13_reorder_summary": f"""SELECT count(*) AS tracked_series, count(*) FILTER (needs_reorder) AS open_alerts,
        count(*) FILTER (status = 'stocked_out') AS stocked_out, count(*) FILTER (status = 'critical') AS critical,
        count(*) FILTER (needs_reorder AND ven_class = 'Vital') AS vital_alerts,
        {rnd(m4('reorder_point'), 1)} AS avg_reorder_point, {rnd(m4('legacy_threshold'), 1)} AS avg_legacy,
        count(*) FILTER (needs_reorder AND on_hand > legacy_threshold) AS caught_only_by_new_rule,
        count(*) FILTER (NOT needs_reorder AND on_hand <= legacy_threshold) AS flagged_only_by_old_rule,
        count(DISTINCT facility_id) AS facilities, count(DISTINCT item_id) AS items FROM t_reorder""",
    "D14_lead_time": "SELECT * FROM t_facilities",
    "D14_lead_time_verify": f"""SELECT count(*) AS forecast_facilities,
        count(*) FILTER (lead_time_days IS NULL) AS missing_lead_time, min(lead_time_days) AS min_lead,
        max(lead_time_days) AS max_lead, {rnd('(sum(lead_time_days)::DOUBLE / count(lead_time_days))', 1)} AS avg_lead,
        min(distance_to_hq_km) AS min_km, max(distance_to_hq_km) AS max_km,
        count(*) FILTER (lead_time_is_estimated) AS estimated FROM t_facilities WHERE is_forecast_facility""",
    "D15_lead_time_contrast": f"""
        WITH busiest AS (SELECT item_id FROM t_reorder GROUP BY item_id ORDER BY count(*) DESC, item_id LIMIT 1),
        pool AS (SELECT * FROM t_reorder WHERE avg_daily_demand > 0 AND NOT lead_time_is_estimated
                 AND item_id IN (SELECT item_id FROM busiest)),
        n AS (SELECT * FROM pool ORDER BY distance_to_hq_km, facility_id LIMIT 1),
        f AS (SELECT *, avg_daily_demand AS mu, demand_std_dev AS sd FROM pool ORDER BY distance_to_hq_km DESC, facility_id LIMIT 1),
        j AS (SELECT n.item_name, n.unit, n.facility_id AS near_facility_id, f.facility_id AS far_facility_id,
          n.distance_to_hq_km AS near_km, f.distance_to_hq_km AS far_km, n.lead_time_days AS near_lead,
          f.lead_time_days AS far_lead, f.reorder_point AS far_reorder_point, f.legacy_threshold,
          f.mu * n.lead_time_days + 1.65::DOUBLE * f.sd * sqrt(n.lead_time_days::DOUBLE) AS if_near
          FROM n, f WHERE n.facility_id <> f.facility_id)
        SELECT item_name, unit, near_facility_id, far_facility_id, near_km, far_km, near_lead, far_lead, far_reorder_point,
          {rnd('if_near', 1)} AS far_reorder_if_near, {rnd('(far_reorder_point - if_near)', 1)} AS extra_units_from_distance,
          far_lead - near_lead AS extra_lead_days, {rnd('(far_reorder_point - legacy_threshold)', 1)} AS flat_rule_shortfall FROM j""",
    "D16_forecast_series": f"""
        WITH e AS (SELECT max(event_date) AS d FROM t_stock WHERE source = 'seed'),
        h AS (SELECT event_date AS day, sum(quantity)::BIGINT AS historical FROM t_stock
          WHERE event_type = 'dispensed' AND (facility_id, item_id) IN (SELECT (facility_id, item_id) FROM t_pick)
          AND event_date > (SELECT d FROM e) - 30 AND event_date <= (SELECT d FROM e) GROUP BY event_date)
        SELECT day, historical, CASE WHEN day = (SELECT max(day) FROM h) THEN historical::DOUBLE END AS forecast FROM h
        UNION ALL (SELECT day, NULL, {rnd('value', 1)} FROM t_forecast
          WHERE (facility_id, item_id) IN (SELECT (facility_id, item_id) FROM t_pick) ORDER BY day LIMIT 7)""",
    "D17_pick_series": "SELECT * FROM t_pick",
    "D18_threshold_alert": f"""SELECT facility_id, item_id, {rnd('(on_hand::DOUBLE / avg_daily_demand)', 1)} AS days_of_cover,
        14 AS threshold, 'active' AS status, {rnd('avg_daily_demand', 2)} AS daily_demand
        FROM t_reorder WHERE avg_daily_demand > 0 AND on_hand::DOUBLE / avg_daily_demand < 14""",
    "D19_model_chain": """SELECT 1 AS step_order, 'series' AS step, count(DISTINCT facility_id || '|' || item_id) AS figure FROM t_forecast
        UNION ALL SELECT 2, 'lines', count(*) FROM t_reorder
        UNION ALL SELECT 3, 'facilities', count(DISTINCT facility_id) FROM t_reorder
        UNION ALL SELECT 4, 'shortages', count(*) FILTER (needs_reorder) FROM t_reorder
        UNION ALL SELECT 5, 'moves', count(*) FROM t_recs""",
}
