"""Redistribution, access and lifecycle as SQL."""
from .base import div, km, register, rnd, tolong

register("t_risk", """
SELECT facility_id, item_id, batch_id, expiry_date, days_to_expiry, remaining_qty, earlier AS units_expiring_earlier,
  CASE WHEN days_to_expiry IS NOT NULL THEN greatest(0.0::DOUBLE, remaining_qty
    - greatest(0.0::DOUBLE, avg_daily_demand * days_to_expiry - earlier)) END AS at_risk_units
FROM (SELECT *, coalesce(sum(remaining_qty) OVER (PARTITION BY facility_id, item_id ORDER BY expiry_date ASC NULLS FIRST,
        batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier FROM t_batches)
JOIN (SELECT facility_id, item_id, avg_daily_demand FROM t_reorder) USING (facility_id, item_id)
""")
register("t_fefo", """
SELECT facility_id, item_id, batch_id AS fefo_batch_id, expiry_date AS fefo_expiry_date, days_to_expiry AS fefo_days_to_expiry,
  remaining_qty AS fefo_batch_qty, at_risk_units AS fefo_at_risk_units
FROM t_risk QUALIFY row_number() OVER (PARTITION BY facility_id, item_id
  ORDER BY (at_risk_units > 0) DESC NULLS LAST, expiry_date ASC NULLS FIRST, batch_id) = 1
""")
register("t_recs_all", f"""
SELECT *, {rnd('raw', 1)} AS distance_km,
  {tolong('greatest(0.0::DOUBLE, least(rp * 1.5::DOUBLE - r_hand, spare, fefo_batch_qty))')} AS quantity
FROM (
  SELECT d.facility_id AS to_facility_id, d.facility_name AS to_facility_name, d.state AS to_state, d.district AS to_district,
    s.facility_id AS from_facility_id, s.facility_name AS from_facility_name, d.item_id AS requested_item_id,
    d.item_name AS requested_item_name, s.item_id AS supplied_item_id, s.item_name AS supplied_item_name,
    s.item_id <> d.item_id AS is_substitution, d.ven_class, d.unit, d.priority_score, d.status,
    d.on_hand AS r_hand, d.avg_daily_demand AS r_demand, d.reorder_point AS rp, d.days_of_cover AS receiver_cover_before,
    d.lead_time_days AS r_lead, s.on_hand AS d_hand, s.avg_daily_demand AS d_demand, s.days_of_cover AS donor_cover_before,
    s.on_hand - s.reorder_point AS spare, b.* EXCLUDE (facility_id, item_id),
    {km('fd.latitude', 'fd.longitude', 'fs.latitude', 'fs.longitude')} AS raw
  FROM t_reorder d
  JOIN t_reorder s ON s.facility_id <> d.facility_id AND (s.item_id = d.item_id OR s.atc_class = d.atc_class)
  JOIN t_facilities fd ON fd.facility_id = d.facility_id JOIN t_facilities fs ON fs.facility_id = s.facility_id
  JOIN t_fefo b ON b.facility_id = s.facility_id AND b.item_id = s.item_id
  WHERE d.needs_reorder AND d.avg_daily_demand > 0 AND s.on_hand > s.reorder_point * 1.5::DOUBLE
    AND fd.has_valid_coords AND fs.has_valid_coords)
WHERE raw <= 150 AND fefo_days_to_expiry >= r_lead + 30
""")
register("t_recs", f"""
SELECT sha256(concat_ws('|', to_facility_id, requested_item_id, from_facility_id, supplied_item_id, fefo_batch_id)) AS recommendation_id,
  to_facility_id, to_facility_name, to_state, to_district, from_facility_id, from_facility_name, requested_item_id,
  requested_item_name, supplied_item_id, supplied_item_name, is_substitution, ven_class, unit, priority_score, status,
  quantity, distance_km, fefo_batch_id, fefo_expiry_date, fefo_days_to_expiry, receiver_cover_before,
  {rnd(div('r_hand + quantity', 'r_demand'), 1)} AS receiver_cover_after, donor_cover_before,
  {rnd(div('d_hand - quantity', 'd_demand'), 1)} AS donor_cover_after,
  {tolong('least(quantity::DOUBLE, fefo_at_risk_units)')} AS waste_avoided_units
FROM t_recs_all WHERE quantity >= greatest(1, ceil(r_demand))
QUALIFY row_number() OVER (PARTITION BY to_facility_id, requested_item_id
  ORDER BY is_substitution, distance_km, fefo_days_to_expiry, from_facility_id, supplied_item_id) = 1
""")
register("t_subs", """
SELECT d.facility_id, d.atc_class, d.facility_name, d.state, d.district, d.item_id AS requested_item_id,
  d.item_name AS requested_item_name, d.ven_class AS requested_ven_class, d.on_hand AS requested_on_hand,
  d.days_of_cover AS requested_days_of_cover, a.unit, a.item_id AS alternative_item_id, a.item_name AS alternative_item_name,
  a.ven_class AS alternative_ven_class, a.atc_code AS alternative_atc_code, a.on_hand AS alternative_on_hand,
  a.days_of_cover AS alternative_days_of_cover,
  row_number() OVER (PARTITION BY d.facility_id, d.item_id ORDER BY a.days_of_cover DESC NULLS LAST, a.item_id)::INTEGER AS rank_by_cover
FROM t_reorder d JOIN t_reorder a ON a.facility_id = d.facility_id AND a.atc_class = d.atc_class AND a.item_id <> d.item_id
WHERE d.needs_reorder AND a.on_hand > a.reorder_point
""")
register("t_access", f"""
SELECT * EXCLUDE (raw, rn), {rnd('raw', 1)} AS km FROM (
  SELECT s.facility_id, s.facility_name, s.state, s.district, s.item_id, s.item_name, s.unit, s.ven_class, s.on_hand,
    s.days_of_cover, s.status, s.population, h.facility_id AS source_id, h.facility_name AS source_name,
    h.district AS source_district, h.state AS source_state, h.on_hand AS source_on_hand,
    {km('s.latitude', 's.longitude', 'h.latitude', 'h.longitude')} AS raw,
    row_number() OVER (PARTITION BY s.facility_id, s.item_id
      ORDER BY {km('s.latitude', 's.longitude', 'h.latitude', 'h.longitude')}, h.facility_id) AS rn
  FROM (SELECT r.*, latitude, longitude, population_served AS population FROM t_reorder r JOIN t_facilities f USING (facility_id)
        WHERE needs_reorder AND ven_class = 'Vital' AND has_valid_coords) s
  LEFT JOIN (SELECT r.*, latitude, longitude FROM t_reorder r JOIN t_facilities f USING (facility_id)
        WHERE NOT needs_reorder AND on_hand > 0 AND has_valid_coords) h
    ON h.item_id = s.item_id AND h.facility_id <> s.facility_id)
WHERE rn = 1
""")
register("t_triage", f"""
SELECT r.facility_id, facility_name, state, district, r.item_id, item_name, unit, ven_class, on_hand, reorder_point,
  greatest({tolong('(reorder_point - on_hand)')}, 0) AS shortfall, days_of_cover, lead_time_days, status,
  c.facility_id IS NOT NULL AS has_transfer,
  c.facility_id IS NULL AND coalesce(days_of_cover < lead_time_days, false) AS too_late_to_order,
  CASE WHEN c.facility_id IS NOT NULL THEN 'transfer' WHEN days_of_cover < lead_time_days THEN 'escalate' ELSE 'order' END AS answer
FROM t_reorder r LEFT JOIN (SELECT DISTINCT to_facility_id AS facility_id, requested_item_id AS item_id FROM t_recs) c
  ON c.facility_id = r.facility_id AND c.item_id = r.item_id
WHERE needs_reorder
""")
register("t_requests", """
SELECT 'T' || user_id AS recommendation_id, 'Q' || event_id AS request_id, ts,
  CASE event_type WHEN 'click' THEN 'approved' WHEN 'view' THEN 'dispatched' WHEN 'purchase' THEN 'received'
    ELSE 'recommended' END AS step FROM events
""")
register("t_s1", """SELECT recommendation_id, ts, request_id FROM t_requests WHERE step = 'approved'
QUALIFY row_number() OVER (PARTITION BY recommendation_id ORDER BY ts, request_id) = 1""")
register("t_s2", """SELECT r.recommendation_id, r.ts, r.request_id FROM t_requests r JOIN t_s1 a USING (recommendation_id)
WHERE step = 'dispatched' AND (r.ts, r.request_id) > (a.ts, a.request_id)
QUALIFY row_number() OVER (PARTITION BY r.recommendation_id ORDER BY r.ts, r.request_id) = 1""")
register("t_s3", """SELECT r.recommendation_id, r.ts, r.request_id FROM t_requests r JOIN t_s2 a USING (recommendation_id)
WHERE step = 'received' AND (r.ts, r.request_id) > (a.ts, a.request_id)
QUALIFY row_number() OVER (PARTITION BY r.recommendation_id ORDER BY r.ts, r.request_id) = 1""")
register("t_log", """
SELECT recommendation_id, 'approved' AS fulfilment_status, ts AS updated_at, request_id, NULL::VARCHAR AS movement_event_id FROM t_s1
UNION ALL SELECT recommendation_id, 'dispatched', ts, request_id, recommendation_id || ':dispatched' FROM t_s2
UNION ALL SELECT recommendation_id, 'received', ts, request_id, recommendation_id || ':received' FROM t_s3
""")

SQL = {
    "E1_recommendations": "SELECT * FROM t_recs",
    "E2_batch_risk": "SELECT * FROM t_risk",
    "E3_fefo_batch_choice": "SELECT * FROM t_fefo",
    "E4_transfer_effects": """SELECT count(*) AS transfers, count(*) FILTER (is_substitution) AS substitutions,
        coalesce(sum(quantity), 0)::BIGINT AS units, coalesce(sum(waste_avoided_units), 0)::BIGINT AS waste_avoided,
        count(*) FILTER (receiver_cover_after > receiver_cover_before) AS receivers_improved, max(distance_km) AS max_km,
        count(DISTINCT to_facility_id) AS receivers, count(DISTINCT from_facility_id) AS donors FROM t_recs""",
    "E5_substitutes": "SELECT * FROM t_subs",
    "E5_best_substitutes": """SELECT * FROM t_subs WHERE rank_by_cover <= 3 ORDER BY requested_days_of_cover NULLS FIRST,
        alternative_days_of_cover DESC NULLS LAST, facility_id, requested_item_id, alternative_item_id""",
    "E6_substitution_constraint": """SELECT count(*) AS classes, count(*) FILTER (n > 1) AS classes_with_a_pair
        FROM (SELECT atc_class, count(DISTINCT item_id) AS n FROM t_reorder WHERE atc_class IS NOT NULL GROUP BY ALL)""",
    "E7_donor_safety_check": "SELECT count(*) FILTER (donor_cover_after < 0) AS negative_donor FROM t_recs",
    "E8_score_redistribution": f"""
        WITH inv AS (SELECT r.facility_id, item_id, on_hand, avg_daily_demand AS dd, latitude, longitude,
            CASE WHEN avg_daily_demand > 0 THEN on_hand / avg_daily_demand END AS cover
          FROM t_reorder r JOIN t_facilities USING (facility_id) WHERE has_valid_coords),
        pairs AS (SELECT n.facility_id AS to_facility_id, n.item_id, d.facility_id AS from_facility_id, d.on_hand AS dh, d.dd AS ddm,
            n.on_hand AS rh, n.dd AS rd, {km('n.latitude', 'n.longitude', 'd.latitude', 'd.longitude')} AS raw,
            greatest(0, least(floor(28.0::DOUBLE * n.dd)::BIGINT - n.on_hand, d.on_hand - floor(28.0::DOUBLE * d.dd)::BIGINT))::BIGINT AS quantity
          FROM inv n JOIN inv d ON d.item_id = n.item_id AND n.cover < 14 AND (d.cover IS NULL OR d.cover > 42)),
        scored AS (SELECT *, coalesce((dh - quantity)::DOUBLE / nullif(ddm, 0) / raw, 'infinity'::DOUBLE) AS score
          FROM pairs WHERE raw > 0 AND raw <= 150 AND quantity > 0)
        SELECT to_facility_id, item_id, from_facility_id, quantity, {rnd('raw', 2)} AS distance_km,
          {rnd(div('dh - quantity', 'ddm'), 1)} AS donor_post_cover, {rnd(div('rh + quantity', 'rd'), 1)} AS receiver_post_cover,
          {rnd('score', 2)} AS score
        FROM scored QUALIFY row_number() OVER (PARTITION BY to_facility_id, item_id ORDER BY score DESC, from_facility_id) = 1""",
    "E9_nearest_help": "SELECT * FROM t_access",
    "E10_access_summary": """SELECT count(*) AS cases, count(*) FILTER (km <= 25) AS near,
        count(*) FILTER (km > 25 AND km <= 100) AS "between", count(*) FILTER (km > 100) AS far,
        count(*) FILTER (km IS NULL) AS unreachable,
        (SELECT list_sort(list(km))[(len(list(km)) // 2) + 1] FROM t_access WHERE km IS NOT NULL) AS median_km,
        (SELECT count(DISTINCT facility_id) FROM t_access) AS centres,
        (SELECT coalesce(sum(p), 0)::BIGINT FROM (SELECT max(population) AS p FROM t_access GROUP BY facility_id)) AS people
        FROM t_access""",
    "E11_triage": "SELECT * FROM t_triage",
    "E11_triage_summary": """SELECT count(*) AS total, count(*) FILTER (answer = 'transfer') AS transfer,
        count(*) FILTER (answer = 'order') AS "order", count(*) FILTER (answer = 'escalate') AS escalate,
        count(*) FILTER (answer = 'escalate' AND ven_class = 'Vital') AS escalate_vital,
        count(*) FILTER (answer = 'escalate' AND on_hand <= 0) AS escalate_out_now FROM t_triage""",
    "E12_transfer_lifecycle": "SELECT * FROM t_log",
    "E12_rejected_requests": """SELECT step, count(*) AS rejected FROM t_requests
        WHERE request_id NOT IN (SELECT request_id FROM t_log) GROUP BY step""",
    "E13_transfer_pending": """SELECT recommendation_id, CASE WHEN r IS NOT NULL THEN 'received' WHEN d IS NOT NULL THEN 'dispatched'
        ELSE 'approved' END AS fulfilment_status, a AS approved_at, d AS dispatched_at, r AS received_at
        FROM (SELECT recommendation_id, max(updated_at) FILTER (fulfilment_status = 'approved') AS a,
          max(updated_at) FILTER (fulfilment_status = 'dispatched') AS d,
          max(updated_at) FILTER (fulfilment_status = 'received') AS r FROM t_log GROUP BY ALL)""",
    "E14_movement_reconcile": """
        WITH m AS (SELECT recommendation_id || ':' || step AS event_id, count(*) AS n FROM t_requests
          WHERE step IN ('dispatched', 'received') GROUP BY ALL),
        l AS (SELECT DISTINCT movement_event_id AS event_id, 1 AS in_log FROM t_log WHERE movement_event_id IS NOT NULL)
        SELECT count(*) FILTER (n > 1) AS duplicated_movements, count(*) FILTER (in_log IS NULL) AS movement_without_step,
          count(*) FILTER (n IS NULL) AS step_without_movement, count(*) FILTER (n IS NOT NULL AND in_log IS NOT NULL) AS matched
        FROM m FULL JOIN l USING (event_id)""",
    "E15_alerts": """SELECT facility_id, item_id, facility_name, state, district, item_name, unit, ven_class, on_hand,
        avg_daily_demand, days_of_cover, reorder_point, safety_stock, legacy_threshold, lead_time_days, priority_score,
        status, days_to_soonest_expiry, soonest_expiry FROM t_reorder WHERE needs_reorder
        ORDER BY priority_score DESC, days_of_cover ASC NULLS FIRST, facility_id, item_id""",
    "E16_recommendation_list": """SELECT recommendation_id, from_facility_id, to_facility_id, requested_item_id, supplied_item_id,
        is_substitution, quantity, distance_km, waste_avoided_units, priority_score, status FROM t_recs
        ORDER BY priority_score DESC, distance_km, recommendation_id""",
}
