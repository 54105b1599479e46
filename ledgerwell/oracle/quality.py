"""Reporting, capture rules, coverage and impact as SQL."""
from .base import div, pct, register, rnd, tolong
from .stock import m4, s4

register("t_reporting", f"""
SELECT f.facility_id, f.name AS facility_name, f.admin_l1 AS state, f.admin_l2 AS district, 3 AS periods_expected,
  coalesce(periods_reported, 0) AS periods_reported, {rnd('(coalesce(periods_reported, 0) / 3.0::DOUBLE)', 2)} AS reporting_consistency,
  last_report, (today - last_report)::INTEGER AS days_since_last_report,
  CASE WHEN coalesce(periods_reported, 0) = 0 THEN 'silent' WHEN periods_reported < 3 THEN 'partial' ELSE 'complete' END AS reporting_status,
  today AS as_of_date
FROM t_facilities f CROSS JOIN (SELECT max(event_date) AS today FROM t_captures WHERE resource_type = 'medicine')
LEFT JOIN (SELECT facility_id, max(event_date) AS last_report FROM t_captures WHERE resource_type = 'medicine' AND event_type = 'count' GROUP BY ALL)
  USING (facility_id)
LEFT JOIN (SELECT facility_id, count(DISTINCT (today - event_date) // 2) AS periods_reported FROM t_captures
  CROSS JOIN (SELECT max(event_date) AS today FROM t_captures WHERE resource_type = 'medicine')
  WHERE resource_type = 'medicine' AND event_type = 'count' AND event_date > today - 6 GROUP BY ALL) USING (facility_id)
WHERE f.is_forecast_facility
""")
register("t_extract", """
SELECT 'E' || event_id AS event_id, 'R' || user_id AS report_id, event_id AS seq, 'F' || user_id AS facility_id, ts AS event_ts, user_id,
  k % 17 = 3 AS prose,
  CASE WHEN k % 10 = 9 THEN NULL ELSE 'Brand#' || (k % 25 + 1) END AS by_name,
  CASE WHEN k % 3 = 0 THEN 'Brand#' || (k % 25 + 1) END AS by_id, CASE WHEN k % 7 = 0 THEN 'Brand#1' END AS by_hint,
  CASE event_type WHEN 'click' THEN 'dispensed' WHEN 'view' THEN 'received'
    WHEN 'purchase' THEN CASE WHEN k % 5 = 0 THEN 'issued' ELSE 'count' END WHEN 'error' THEN 'lost'
    ELSE CASE WHEN k % 2 = 0 THEN 'request' ELSE 'identify' END END AS event_type,
  CASE WHEN k % 11 <> 0 THEN floor(value)::BIGINT END AS quantity, 0.5::DOUBLE + (k % 10)::DOUBLE / 20.0::DOUBLE AS confidence,
  CASE WHEN k % 6 <> 0 THEN 'broken' ELSE 'unknown' END AS lr
FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)
""")
register("t_gate", f"""
SELECT event_id, report_id, seq, facility_id, event_ts, user_id,
  CASE WHEN NOT prose THEN coalesce(by_id, by_name, by_hint) END AS item_id,
  CASE WHEN prose THEN NULL WHEN by_id IS NOT NULL THEN 'id' WHEN by_name IS NOT NULL THEN 'name' WHEN by_hint IS NOT NULL THEN 'hint' END AS matched_by,
  CASE WHEN prose THEN 'count' ELSE event_type END AS event_type, CASE WHEN NOT prose THEN quantity END AS quantity,
  CASE WHEN prose THEN 0.0::DOUBLE ELSE {rnd('confidence', 3)} END AS confidence,
  CASE WHEN NOT prose AND event_type = 'lost' THEN lr END AS resource_subtype,
  CASE WHEN prose OR event_type IN ('request', 'identify') THEN NULL WHEN event_type = 'issued' THEN 'unknown event type'
    WHEN coalesce(by_id, by_name, by_hint) IS NULL THEN 'no matching item' WHEN confidence < 0.6::DOUBLE THEN 'low confidence'
    WHEN quantity IS NULL THEN 'no quantity' END AS review_reason,
  CASE WHEN prose THEN 'errors' WHEN event_type = 'request' THEN 'requests' WHEN event_type = 'identify' THEN 'identified'
    WHEN event_type = 'issued' OR coalesce(by_id, by_name, by_hint) IS NULL OR confidence < 0.6::DOUBLE OR quantity IS NULL THEN 'review'
    ELSE 'events' END AS route
FROM t_extract
""")
register("t_held", """
SELECT event_id, report_id, facility_id, item_id, event_type, quantity, held, on_record FROM t_fold
""")
register("t_gate_rows", """
SELECT g.*, coalesce(b.balance, 0) AS start, row_number() OVER (PARTITION BY report_id, g.facility_id, g.item_id ORDER BY seq) AS rn
FROM t_gate g LEFT JOIN t_balance b ON b.facility_id = g.facility_id AND b.item_id = g.item_id WHERE route = 'events'
""")
_fold = """
WITH RECURSIVE walk AS (
  SELECT event_id, report_id, facility_id, item_id, event_type, quantity, rn, start AS on_record,
    event_type IN ('dispensed', 'lost') AND quantity > start AS held,
    start + CASE WHEN event_type = 'received' THEN quantity WHEN event_type IN ('dispensed', 'lost') AND quantity <= start THEN -quantity ELSE 0 END AS have
  FROM t_gate_rows WHERE rn = 1
  UNION ALL
  SELECT n.event_id, n.report_id, n.facility_id, n.item_id, n.event_type, n.quantity, n.rn, w.have,
    n.event_type IN ('dispensed', 'lost') AND n.quantity > w.have,
    w.have + CASE WHEN n.event_type = 'received' THEN n.quantity WHEN n.event_type IN ('dispensed', 'lost') AND n.quantity <= w.have THEN -n.quantity ELSE 0 END
  FROM walk w JOIN t_gate_rows n ON n.report_id = w.report_id AND n.facility_id = w.facility_id AND n.item_id = w.item_id AND n.rn = w.rn + 1)
SELECT event_id, report_id, facility_id, item_id, event_type, quantity, held, on_record::BIGINT AS on_record FROM walk
"""
register("t_fold", _fold)
register("t_geo", """
SELECT 'state' AS level, admin_l1 AS state, NULL AS district, count(*) AS facility_count, count(*) FILTER (facility_type = 'phc') AS phc_count,
  count(DISTINCT admin_l2) AS district_count, count(*) FILTER (is_demo_facility) AS demo_count, sum(population_served)::BIGINT AS population_served
FROM t_facilities WHERE admin_l1 <> '' GROUP BY admin_l1
UNION ALL SELECT 'district', admin_l1, admin_l2, count(*), count(*) FILTER (facility_type = 'phc'), 0, count(*) FILTER (is_demo_facility),
  sum(population_served)::BIGINT FROM t_facilities WHERE admin_l1 <> '' AND admin_l2 <> '' GROUP BY admin_l1, admin_l2
""")
_tier = "count(*) AS phcs, count(DISTINCT admin_l1) AS states, count(DISTINCT admin_l1 || '|' || admin_l2) AS districts, sum(population_served)::BIGINT AS population"
_rural = "t_facilities WHERE facility_type = 'phc' AND location_type = 'rural' AND population_served IS NOT NULL"
register("t_reach", f"""
SELECT tier_order, tier, phcs, states, districts, population, {tolong(div('population', 'phcs'))} AS mean_catchment,
  {rnd('(100.0::DOUBLE * population / 833748852.0::DOUBLE)', 2)} AS pct_of_census FROM (
  SELECT 1 AS tier_order, 'operating' AS tier, {_tier} FROM {_rural} AND is_forecast_facility
  UNION ALL SELECT 2, 'demand_data_footprint', {_tier} FROM {_rural} AND (admin_l1, upper(trim(admin_l2))) IN (SELECT (admin_l1, district_key) FROM t_demand)
  UNION ALL SELECT 3, 'national_directory', {_tier} FROM {_rural}) WHERE phcs > 0
""")
register("t_priced", f"""
SELECT item, unit, units, price, {rnd('(units * price)', 2)} AS value FROM (
  SELECT e.item, e.unit, e.units, (SELECT first(list_price ORDER BY n) FROM (SELECT list_price, display_name, split_part(item_id, '#', 2)::BIGINT AS n FROM t_items) p
    WHERE p.n % 3 <> 2 AND p.n % 5 <> 4 AND starts_with(lower(e.item), lower(CASE WHEN p.n % 3 = 0 THEN display_name ELSE split_part(display_name, ' ', 1) END))) AS price
  FROM (SELECT display_name AS item, unit, sum(quantity)::BIGINT AS units FROM t_stock JOIN t_items USING (item_id)
        WHERE event_type = 'expired' GROUP BY ALL) e)
""")
register("t_parts", """
SELECT admin_l1 AS part, max(event_date) AS as_of_date, coalesce(sum(quantity) FILTER (event_type = 'dispensed'), 0)::BIGINT AS d,
  coalesce(sum(quantity) FILTER (event_type = 'lost'), 0)::BIGINT AS u, coalesce(sum(quantity) FILTER (event_type = 'expired'), 0)::BIGINT AS e,
  coalesce(sum(quantity) FILTER (event_type IN ('expired', 'lost')), 0)::BIGINT AS f
FROM t_stock JOIN t_facilities USING (facility_id) GROUP BY ALL
""")


def nums(x: str) -> str:
    one = ("CASE WHEN regexp_full_match(n, '\\d+(\\.\\d+)?') THEN regexp_replace(CASE WHEN contains(h, '.') THEN "
           "regexp_replace(h, '(\\.\\d*?)0+$', '\\1') ELSE h END, '\\.$', '') ELSE n END")
    one = one.replace("h,", "regexp_replace(n, '^0+(\\d)', '\\1'),").replace("ELSE h END", "ELSE regexp_replace(n, '^0+(\\d)', '\\1') END")
    return f"list_distinct([{one} FOR n IN [replace(m, ',', '') FOR m IN regexp_extract_all({x}, '\\d+(?:[.,]\\d+)*')]])"


_triple = "list_sort(list((item_id, event_type, quantity)))"
_SCORED = f"""
        WITH e AS (SELECT report_id AS case_id, user_id, {_triple} AS got FROM (SELECT * REPLACE (CASE WHEN event_type = 'count' THEN 'received' ELSE event_type END AS event_type)
            FROM t_gate WHERE route = 'events') GROUP BY ALL),
        w AS (SELECT report_id AS case_id, {_triple} AS want FROM (SELECT * REPLACE (CASE WHEN event_type = 'count' THEN 'received' ELSE event_type END AS event_type,
            quantity + CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS quantity) FROM t_gate WHERE route = 'events') GROUP BY ALL),
        c AS (SELECT DISTINCT report_id AS case_id FROM t_gate)
        SELECT case_id, got IS NOT DISTINCT FROM want AS passed FROM c LEFT JOIN e USING (case_id) LEFT JOIN w USING (case_id)"""

_REPLAYED = """
        SELECT * FROM (WITH RECURSIVE fact AS (SELECT facility_id, item_id, event_date AS day, event_type = 'received' AS receipt,
            CASE WHEN event_type = 'received' THEN coalesce(expiry_date, DATE '4000-01-01') END AS exp, sum(quantity)::BIGINT AS qty
          FROM t_stock WHERE event_type IN ('received', 'dispensed') GROUP BY ALL),
        need AS (SELECT facility_id, item_id, day, qty, row_number() OVER (PARTITION BY facility_id, item_id ORDER BY day) AS step FROM fact WHERE NOT receipt),
        lot AS (SELECT facility_id, item_id, day AS got, exp, qty, rule FROM fact, (VALUES ('fefo'), ('fifo')) r(rule) WHERE receipt),
        shelf AS (
          SELECT facility_id, item_id, got, exp, rule, qty AS left_qty, 0::BIGINT AS step FROM lot
          UNION ALL
          SELECT facility_id, item_id, got, exp, rule,
            left_qty - CASE WHEN open THEN greatest(0, least(left_qty, want - before)) ELSE 0 END, step
          FROM (SELECT s.facility_id, s.item_id, s.got, s.exp, s.rule, s.left_qty, n.step, n.qty AS want, s.got <= n.day AND s.exp > n.day AS open,
              coalesce(sum(CASE WHEN s.got <= n.day AND s.exp > n.day THEN s.left_qty ELSE 0 END) OVER (PARTITION BY s.facility_id, s.item_id, s.rule
                ORDER BY CASE WHEN s.rule = 'fefo' THEN s.exp ELSE s.got END, CASE WHEN s.rule = 'fefo' THEN s.got ELSE s.exp END
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
            FROM shelf s JOIN need n ON n.facility_id = s.facility_id AND n.item_id = s.item_id AND n.step = s.step + 1)),
        last AS (SELECT * FROM shelf QUALIFY step = max(step) OVER (PARTITION BY facility_id, item_id)),
        fate AS (SELECT facility_id, item_id,
            coalesce(sum(left_qty) FILTER (rule = 'fefo'), 0)::BIGINT AS kept,
            coalesce(sum(left_qty) FILTER (rule = 'fefo' AND exp <= (SELECT max(event_date) FROM t_stock)), 0)::BIGINT AS fefo,
            coalesce(sum(left_qty) FILTER (rule = 'fifo' AND exp <= (SELECT max(event_date) FROM t_stock)), 0)::BIGINT AS fifo FROM last GROUP BY ALL),
        total AS (SELECT facility_id, item_id, coalesce(sum(qty) FILTER (receipt), 0)::BIGINT AS got, coalesce(sum(qty) FILTER (NOT receipt), 0)::BIGINT AS want
          FROM fact GROUP BY ALL)
        SELECT facility_id, item_id, got - coalesce(kept, 0) AS units_dispensed, want - (got - coalesce(kept, 0)) AS units_unmet,
          coalesce(fefo, 0) AS units_expired_fefo, coalesce(fifo, 0) AS units_expired_fifo FROM total LEFT JOIN fate USING (facility_id, item_id))"""

_APPROVED = """
        WITH a AS (SELECT 'A' || event_id AS approval_id, 'E' || (event_id - event_id % 3) AS event_id, ts,
          CASE WHEN k % 7 = 0 THEN -1 WHEN k % 5 <> 0 THEN k END::BIGINT AS aq FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)),
        r AS (SELECT a.*, g.event_id IS NOT NULL AS known, g.item_id, coalesce(aq, g.quantity) AS q FROM a
          LEFT JOIN (SELECT * FROM t_gate WHERE route = 'review') g USING (event_id)),
        f AS (SELECT *, CASE WHEN NOT known THEN 'no review item' WHEN item_id IS NULL THEN 'no item' WHEN q IS NULL THEN 'no quantity'
          WHEN q < 0 THEN 'negative quantity' END AS fault FROM r),
        o AS (SELECT *, count(*) FILTER (fault IS NULL) OVER (PARTITION BY event_id ORDER BY ts, approval_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
        z AS (SELECT *, CASE WHEN before > 0 THEN 'already approved' ELSE fault END AS reason FROM o)
        SELECT approval_id, event_id, item_id, reason IS NULL AS approved, reason, CASE WHEN reason IS NULL THEN q END AS quantity,
          CASE WHEN reason IS NULL THEN CASE WHEN aq IS NOT NULL THEN 'reviewer' ELSE 'extraction' END END AS quantity_source FROM z"""

SQL = {
    "J1_facility_reporting": "SELECT * FROM t_reporting",
    "J1_reporting_summary": f"""SELECT count(*) AS facilities, count(*) FILTER (reporting_status = 'complete') AS complete,
        count(*) FILTER (reporting_status = 'partial') AS partial, count(*) FILTER (reporting_status = 'silent') AS silent,
        {rnd(m4('reporting_consistency'), 3)} AS mean_consistency FROM t_reporting""",
    "J2_capture_gate": "SELECT event_id, report_id, item_id, matched_by, event_type, quantity, confidence, resource_subtype, review_reason, route FROM t_gate",
    "J3_loss_reason": "SELECT resource_subtype, count(*) AS n FROM t_gate WHERE event_type = 'lost' AND route <> 'errors' GROUP BY ALL",
    "J3_loss_reason_rows": "SELECT event_id, resource_subtype FROM t_gate WHERE event_type = 'lost' AND route <> 'errors'",
    "J4_overdraw_hold": "SELECT * FROM t_held",
    "J5_review_approve": _APPROVED,
    "J5_pending_review": f"""SELECT event_id, facility_id, item_id, review_reason FROM t_gate WHERE route = 'review'
        AND event_id NOT IN (SELECT event_id FROM ({_APPROVED}) WHERE approved AND event_id IS NOT NULL)""",
    "J6_confirm_rows": """SELECT route, coalesce(CASE WHEN review_reason = 'low confidence' THEN CASE WHEN quantity IS NULL THEN 'no quantity' END ELSE review_reason END, '') AS why,
        count(*) AS n FROM (SELECT *  REPLACE (CASE WHEN review_reason = 'low confidence' AND quantity IS NOT NULL THEN 'events' ELSE route END AS route) FROM t_gate) GROUP BY ALL""",
    "J6_confirmed_rows": """SELECT event_id, CASE WHEN review_reason = 'low confidence' AND quantity IS NOT NULL THEN 'events' ELSE route END AS route,
        coalesce(CASE WHEN review_reason = 'low confidence' THEN CASE WHEN quantity IS NULL THEN 'no quantity' END ELSE review_reason END, '') AS why FROM t_gate""",
    "J7_captures": """SELECT count(*) FILTER (event_date = today) AS captures_today, count(*) FILTER (event_date >= today - 7) AS captures_last_7_days,
        count(*) AS captures_all_time, count(DISTINCT facility_id) AS facilities_reporting, count(*) FILTER (source = 'voice') AS voice,
        count(*) FILTER (source = 'chat') AS chat, count(*) FILTER (source = 'barcode') AS barcode, count(*) FILTER (source = 'tap') AS tap,
        count(*) FILTER (source = 'photo') AS photo, count(*) FILTER (source = 'sms') AS sms
        FROM t_stock CROSS JOIN t_today WHERE source <> 'seed'""",
    "J8_reported_today": """SELECT count(DISTINCT facility_id) AS centres, count(*) AS reports, max(event_ts) AS latest FROM t_captures
        WHERE resource_type = 'personnel' AND event_type = 'count' AND event_ts >= (SELECT max(event_ts) FROM t_captures) - INTERVAL 24 HOURS
        AND facility_id IN (SELECT facility_id FROM t_staff)""",
    "J8_reported_latest": """SELECT facility_id, item_id, quantity, event_ts FROM t_captures
        WHERE resource_type = 'personnel' AND event_type = 'count' AND event_ts >= (SELECT max(event_ts) FROM t_captures) - INTERVAL 24 HOURS
        AND facility_id IN (SELECT facility_id FROM t_staff) ORDER BY event_ts DESC, event_id LIMIT 20""",
    "J9_data_quality": """SELECT count(*) AS facilities_loaded, count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS missing_coords,
        count(*) FILTER (latitude < -90 OR latitude > 90) AS latitude_out_of_range, count(*) FILTER (longitude < -180 OR longitude > 180) AS longitude_out_of_range,
        count(*) FILTER (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude BETWEEN 6 AND 38 AND longitude BETWEEN 68 AND 98)) AS outside_box,
        count(*) FILTER (NOT has_valid_coords) AS excluded_from_distance, count(*) FILTER (NOT has_valid_coords AND is_demo_facility) AS excluded_demo_facilities,
        count(*) FILTER (population_served IS NULL) AS missing_population, count(*) FILTER (is_forecast_facility) AS forecast_facilities,
        count(*) FILTER (is_forecast_facility AND lead_time_is_estimated) AS implausible_hq_distance,
        (SELECT count(*) FROM t_items) AS items, (SELECT count(*) FROM t_items WHERE atc_code IS NULL) AS items_without_atc FROM t_facilities""",
    "J10_geo_summary": "SELECT * FROM t_geo",
    "J11_list_states": "SELECT state, facility_count, phc_count, district_count FROM t_geo WHERE level = 'state'",
    "J11_list_districts": """SELECT state, district, CASE WHEN state = 'ASIA' AND upper(trim(district)) = 'NATION_2' THEN 'Nation Two' ELSE district END AS display_name,
        facility_count, phc_count FROM t_geo WHERE level = 'district'""",
    "J11_facility_counts": """SELECT sum(facility_count)::BIGINT AS facilities, sum(phc_count)::BIGINT AS phcs, sum(demo_count)::BIGINT AS demo_facilities,
        sum(population_served)::BIGINT AS population_served, count(DISTINCT state) AS states, sum(district_count)::BIGINT AS districts
        FROM t_geo WHERE level = 'state'""",
    "J11_national_summary": """SELECT (sum(facility_count) FILTER (level = 'state'))::BIGINT AS facilities, count(*) FILTER (level = 'state') AS states,
        count(*) FILTER (level = 'district') AS districts, count(DISTINCT district) FILTER (level = 'district') AS district_names,
        (sum(demo_count) FILTER (level = 'state'))::BIGINT AS demo_facilities FROM t_geo""",
    "J11_scope_facilities": """SELECT facility_id, name, admin_l1, admin_l2, latitude, longitude, population_served FROM t_facilities
        WHERE facility_type = 'phc' ORDER BY name, facility_id""",
    "J11_get_facility": "SELECT facility_id, name, admin_l1, admin_l2 FROM t_facilities WHERE facility_id = 'F3'",
    "J12_population_reach": "SELECT * FROM t_reach",
    "J12_reach_check": """SELECT (sum(population_served) FILTER (facility_type = 'phc' AND location_type = 'rural'))::BIGINT AS rural_population,
        sum(population_served)::BIGINT AS naive_population, count(*) FILTER (facility_type = 'phc' AND location_type = 'urban') AS urban_phc,
        count(*) FILTER (facility_type = 'phc' AND location_type IS NULL) AS phc_no_location, count(*) FILTER (facility_type = 'sub_cen') AS sub_centres,
        count(*) FILTER (facility_type = 'chc') AS chcs, count(*) FILTER (facility_type IN ('dis_h', 's_t_h')) AS hospitals,
        (sum(population_served) FILTER (facility_type = 'phc' AND location_type = 'rural')) / 833748852.0::DOUBLE BETWEEN 0.8 AND 1.05 AS tiles FROM t_facilities""",
    "J13_priced_expiry": "SELECT * FROM t_priced",
    "J13_waste_value": f"""SELECT total_units, priced_units, partial_value, {rnd('c', 4)} AS coverage, CASE WHEN c >= 0.8 THEN {rnd('(partial_value / c)', 2)} END AS headline_value
        FROM (SELECT *, {div('priced_units', 'total_units')} AS c FROM (SELECT sum(units)::BIGINT AS total_units,
          coalesce(sum(units) FILTER (price IS NOT NULL), 0)::BIGINT AS priced_units, {rnd(s4('value'), 2)} AS partial_value FROM t_priced))""",
    "J14_impact_parts": f"""SELECT as_of_date, d AS units_dispensed, u AS units_unmet, e AS units_expired_fefo, f AS units_expired_fifo,
        {rnd(div('u', 'd + u'), 4)} AS unmet_share, f - e AS waste_avoided_by_fefo_units, {rnd(div('f - e', 'f'), 4)} AS waste_avoided_share
        FROM (SELECT max(as_of_date) AS as_of_date, sum(d * w)::BIGINT AS d, sum(u * w)::BIGINT AS u, sum(e * w)::BIGINT AS e, sum(f * w)::BIGINT AS f
          FROM (SELECT *, CASE WHEN part = 'ASIA' THEN 2 ELSE 1 END AS w FROM t_parts))""",
    "J15_issue_policy_replay": _REPLAYED,
    "J16_reach_read": "SELECT * FROM t_reach",
    "J16_reporting_read": """SELECT facility_id, facility_name, state, district, periods_expected, periods_reported, reporting_consistency, last_report,
        days_since_last_report, reporting_status FROM t_reporting ORDER BY reporting_consistency, days_since_last_report DESC NULLS LAST, facility_id""",
    "J19_number_check": f"""SELECT doc_id, len(x) AS foreign_numbers, list_min(x) AS first_foreign, len(x) = 0 AS numbers_checked FROM (
        SELECT doc_id, [z FOR z IN {nums('text')} IF NOT list_contains({nums("concat_ws(' ', doc_id, n_chars, '2,024 1 2 3.0 10')")}, z)] AS x FROM documents)""",
    "J20_code_lookup": """
        WITH t AS (SELECT 'PACK' || k AS code, 'Brand#' || (user_id % 30 + 1) AS item_id, ts, event_id
          FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events WHERE event_type = 'click') WHERE k >= 10 AND user_id % 30 < 25
          QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) = 1)
        SELECT scan_id, code, item_id, display_name AS item_name, unit FROM (SELECT event_id AS scan_id, 'PACK' || k AS code
          FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events WHERE event_type = 'view') WHERE k % 13 <> 0)
        LEFT JOIN t USING (code) LEFT JOIN t_items USING (item_id)""",
    "J21_sms_parse": r"""
        WITH m AS (SELECT conv_id, turn, trim(regexp_replace(CASE conv_id % 3 WHEN 0 THEN 'in-' || conv_id || '  ' || text WHEN 1 THEN 'in-' || conv_id ELSE text END, '\s+', ' ', 'g')) AS t FROM conversations),
        p AS (SELECT *, upper(split_part(t, ' ', 1)) AS h, CASE WHEN contains(t, ' ') THEN substr(t, length(split_part(t, ' ', 1)) + 2) ELSE '' END AS b FROM m)
        SELECT conv_id, turn, CASE WHEN ok THEN h END AS facility_id, CASE WHEN ok THEN b END AS body, CASE WHEN NOT ok THEN 'no facility id' END AS error
        FROM (SELECT *, starts_with(h, 'IN-') AND b <> '' AS ok FROM p)""",
    "J22_extraction_score": _SCORED,
    "J22_score_rate": f"""SELECT count(*) AS cases, count(*) FILTER (passed) AS passed,
        {pct('count(*) FILTER (passed)', 'count(*)', 1)} AS pass_rate FROM ({_SCORED})""",
}
