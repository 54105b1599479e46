"""Beds and staff as SQL."""
from ..functions.months import CALENDAR
from .base import div, km, pct, register, rnd, tolong
from .stock import m4, s4

register("t_fac", """
SELECT *, CASE WHEN facility_type = 'phc' THEN 6::BIGINT END AS bed_capacity,
  CASE WHEN facility_type = 'phc' THEN 2::BIGINT END AS bed_capacity_essential,
  CASE WHEN facility_type = 'phc' THEN 4::BIGINT END AS bed_capacity_desirable,
  CASE WHEN facility_type = 'phc' THEN lower(location_type) = 'urban' END AS beds_are_day_care,
  NULL::BOOLEAN AS is_24x7, CASE WHEN facility_type = 'phc' THEN 1::BIGINT END AS nurses_required FROM t_facilities
""")
register("t_beds", f"""
SELECT facility_id, name AS facility_name, admin_l1 AS state, admin_l2 AS district, latitude, longitude, bed_type, beds_are_day_care,
  {tolong('cap')} AS bed_capacity, {rnd('m', 2)} AS mean_occupied, peak_occupied, {rnd('m / nullif(cap, 0)', 3)} AS occupancy_rate,
  CASE WHEN m IS NOT NULL THEN greatest({tolong('cap')} - {tolong('m')}, 0) END AS free_beds, turned_away, days_reported,
  CASE WHEN turned_away > 0 THEN 'over_capacity' WHEN m / nullif(cap, 0) >= 0.8::DOUBLE THEN 'under_pressure' ELSE 'has_capacity' END AS status,
  (SELECT max(event_date) FROM t_captures WHERE resource_type = 'bed') AS as_of_date
FROM (SELECT facility_id, min(item_id) AS bed_type, min(capacity) AS cap, avg(quantity) FILTER (event_type = 'occupancy') AS m,
    max(quantity) FILTER (event_type = 'occupancy') AS peak_occupied,
    sum(CASE WHEN event_type = 'turned_away' THEN quantity ELSE 0 END)::BIGINT AS turned_away,
    count(*) FILTER (event_type = 'occupancy') AS days_reported
  FROM t_captures WHERE resource_type = 'bed'
    AND event_date > (SELECT max(event_date) FROM t_captures WHERE resource_type = 'bed') - 30 GROUP BY facility_id)
JOIN t_fac USING (facility_id)
""")
_km = km("f.latitude", "f.longitude", "a.latitude", "a.longitude")
_V = "latitude BETWEEN 6 AND 38 AND {0}longitude BETWEEN 68 AND 98"
register("t_referrals", f"""
SELECT f.facility_id AS from_facility_id, f.state, f.district, f.bed_capacity AS from_capacity, f.occupancy_rate AS from_occupancy_rate,
  f.turned_away AS from_turned_away, f.status AS from_status, a.facility_id AS to_facility_id, a.facility_name AS to_facility_name,
  a.free_beds AS to_free_beds, a.occupancy_rate AS to_occupancy_rate, {rnd(_km, 1)} AS distance_km,
  row_number() OVER (PARTITION BY f.facility_id ORDER BY {_km}, a.facility_id)::INTEGER AS referral_rank
FROM t_beds f JOIN t_beds a ON a.facility_id <> f.facility_id AND {_km} <= 50
WHERE f.status <> 'has_capacity' AND a.status = 'has_capacity' AND a.free_beds > 0 AND NOT a.beds_are_day_care
  AND f.latitude BETWEEN 6 AND 38 AND f.longitude BETWEEN 68 AND 98 AND a.latitude BETWEEN 6 AND 38 AND a.longitude BETWEEN 68 AND 98
QUALIFY referral_rank <= 3
""")
register("t_fs", f"""
SELECT facility_id, f.name AS facility_name, admin_l1 AS state, admin_l2 AS district, facility_type, bed_capacity, cadre,
  den AS facilities_sharing_these_posts, {rnd('s_per', 3)} AS sanctioned_per_facility, {rnd('p_per', 3)} AS in_position_per_facility,
  vacancy_rate, greatest(1, {tolong('s_per')}) AS sanctioned_posts,
  CASE WHEN in_position > sanctioned THEN greatest(0, {tolong('p_per')})
    ELSE least(greatest(1, {tolong('s_per')}), greatest(0, {tolong('p_per')})) END AS expected_in_position,
  CASE WHEN cadre = 'Nursing staff' THEN nurses_required END AS nurses_required_by_beds
FROM t_fac f JOIN (SELECT *, sanctioned::DOUBLE / nullif(den, 0) AS s_per, in_position::DOUBLE / nullif(den, 0) AS p_per
    FROM (SELECT s.*, CASE WHEN len(types) = 1 THEN phc ELSE both_types END AS den FROM t_staffing s
      JOIN (SELECT admin_l1 AS state, count(*) FILTER (facility_type = 'phc') AS phc, count(*) AS both_types
        FROM t_fac WHERE facility_type IN ('phc', 'chc') GROUP BY ALL) USING (state))) p
  ON p.state = f.admin_l1 AND list_contains(p.types, f.facility_type)
WHERE f.is_forecast_facility AND f.facility_type IN ('phc', 'chc')
""")
register("t_staff", """
SELECT s.facility_id, s.facility_name, s.state, s.district, f.latitude, f.longitude, s.bed_capacity, f.nurses_required,
  CASE cadre WHEN 'Doctor (allopathic)' THEN 'STAFF-DOCTOR' WHEN 'Nursing staff' THEN 'STAFF-NURSE' WHEN 'Pharmacist' THEN 'STAFF-PHARMACIST' END AS item_id,
  cadre, sanctioned_posts, expected_in_position, vacancy_rate,
  CASE WHEN cadre = 'Nursing staff' AND f.nurses_required IS NOT NULL THEN greatest(f.nurses_required - expected_in_position, 0) END AS nurses_short_of_bed_norm,
  DATE '2022-03-31' AS as_of_date
FROM t_fs s JOIN t_fac f USING (facility_id) WHERE f.is_forecast_facility
""")
WV = (f"({s4('vacancy_rate * sanctioned_posts')} / nullif(sum(CASE WHEN vacancy_rate IS NULL THEN 0 ELSE sanctioned_posts END), 0))")
register("t_season", f"""
SELECT k.state, k.district_key, k.indicator, m.month, CASE WHEN m.month = 'March' OR v.value IS NULL OR k.baseline = 0 THEN 1.0::DOUBLE
  ELSE greatest(0.25::DOUBLE, least(4.0::DOUBLE, v.value / k.baseline)) END AS multiplier
FROM (SELECT admin_l1 AS state, district_key, indicator, avg(value) FILTER (month NOT IN ('January', 'February', 'March')) AS baseline
      FROM t_demand GROUP BY ALL HAVING baseline IS NOT NULL) k
CROSS JOIN (SELECT unnest({CALENDAR}) AS month) m
LEFT JOIN t_demand v ON v.admin_l1 = k.state AND v.district_key = k.district_key AND v.indicator = k.indicator AND v.month = m.month
""")
register("t_scale", """
SELECT admin_l1 AS state, district_key, indicator, avg(value) FILTER (month NOT IN ('January', 'February', 'March')) / phcs AS per_phc, phcs
FROM t_demand JOIN (
  SELECT state, district_key, CASE WHEN state = 'ASIA' THEN greatest(phcs, fl) ELSE phcs END AS phcs FROM (
    SELECT *, round_even(0.5::DOUBLE * avg(phcs) OVER (PARTITION BY state), 0)::BIGINT AS fl FROM (
      SELECT admin_l1 AS state, upper(trim(admin_l2)) AS district_key, count(*) AS phcs FROM t_facilities
      WHERE facility_type = 'phc' GROUP BY ALL))) p ON p.state = admin_l1 AND p.district_key = t_demand.district_key
GROUP BY admin_l1, t_demand.district_key, indicator, phcs HAVING per_phc > 0
""".replace("admin_l1 AS state, district_key, indicator, avg", "admin_l1 AS state, t_demand.district_key, indicator, avg"))
_need = "CASE WHEN coalesce(beds_are_day_care, false) THEN d / 3.0::DOUBLE ELSE d * 1.8::DOUBLE END"
SQL = {
    "B6_bed_norm": "SELECT * FROM t_fac",
    "I1_bed_status": "SELECT * FROM t_beds",
    "I2_bed_referrals": "SELECT * FROM t_referrals",
    "I3_bed_summary": f"""SELECT count(*) AS facilities, sum(bed_capacity)::BIGINT AS total_beds,
        sum(CASE WHEN NOT beds_are_day_care THEN bed_capacity ELSE 0 END)::BIGINT AS overnight_beds, {rnd(s4('mean_occupied'), 1)} AS beds_occupied,
        {rnd('(' + m4('occupancy_rate') + ' * 100.0::DOUBLE)', 1)} AS mean_occupancy_pct, sum(free_beds)::BIGINT AS free_beds,
        sum(turned_away)::BIGINT AS turned_away_30d, count(*) FILTER (status = 'has_capacity') AS has_capacity,
        count(*) FILTER (status = 'under_pressure') AS under_pressure, count(*) FILTER (status = 'over_capacity') AS over_capacity,
        max(as_of_date) AS as_of FROM t_beds""",
    "I3_bed_list": """SELECT facility_id, facility_name, state, district, bed_type, bed_capacity, mean_occupied, occupancy_rate, free_beds,
        turned_away, status FROM t_beds ORDER BY turned_away DESC, occupancy_rate DESC NULLS LAST, facility_id""",
    "I4_facility_staffing": "SELECT * FROM t_fs",
    "I5_staffing_norm_gap": f"""SELECT count(*) AS facilities, {rnd('(sum(sanctioned_posts)::DOUBLE / count(*))', 2)} AS avg_sanctioned,
        {rnd('(sum(nurses_required_by_beds)::DOUBLE / count(*))', 2)} AS avg_required_by_beds,
        count(*) FILTER (sanctioned_posts < nurses_required_by_beds) AS under_norm
        FROM t_fs WHERE cadre = 'Nursing staff' AND nurses_required_by_beds IS NOT NULL""",
    "I6_staff_status": "SELECT * FROM t_staff",
    "I7_staff_summary": f"""SELECT count(DISTINCT facility_id) AS facilities, count(DISTINCT state || '|' || cadre) AS roles,
        sum(sanctioned_posts)::BIGINT AS sanctioned_posts, {rnd('(100.0::DOUBLE * ' + WV + ')', 1)} AS vacancy_pct,
        count(*) FILTER (vacancy_rate IS NULL) AS no_figure, sum(nurses_short_of_bed_norm)::BIGINT AS nurses_short_of_bed_norm,
        max(as_of_date) AS as_of FROM t_staff""",
    "I7_staff_by_cadre": f"""SELECT cadre, item_id, count(*) AS facilities, sum(sanctioned_posts)::BIGINT AS sanctioned_posts,
        {rnd('(100.0::DOUBLE * ' + WV + ')', 1)} AS vacancy_pct FROM t_staff GROUP BY ALL""",
    "I7_staff_list": """SELECT facility_id, facility_name, state, district, cadre, item_id, sanctioned_posts, vacancy_rate,
        nurses_short_of_bed_norm, bed_capacity, nurses_required FROM t_staff
        ORDER BY vacancy_rate DESC NULLS LAST, facility_name, cadre""",
    "I8_staff_reallocation_diag": """SELECT count(*) AS cadres, sum(posts)::BIGINT AS sanctioned_posts, count(*) FILTER (most <= 1) AS single_post_cadres,
        sum(CASE WHEN most <= 1 THEN posts ELSE 0 END)::BIGINT AS posts_in_single_post_cadres,
        array_to_string(coalesce(list_sort(list(cadre) FILTER (most > 1)), []), ', ') AS donor_cadres
        FROM (SELECT cadre, max(sanctioned_posts) AS most, sum(sanctioned_posts) AS posts FROM t_staff GROUP BY ALL)""",
    "I9_resource_coverage": """SELECT resource_type, count(*) AS events, count(DISTINCT facility_id) AS facilities, count(DISTINCT item_id) AS resources
        FROM (SELECT resource_type, facility_id, item_id FROM t_stock UNION ALL SELECT resource_type, facility_id, item_id FROM t_captures) GROUP BY ALL
        UNION ALL SELECT 'establishment', count(*), count(DISTINCT facility_id), count(DISTINCT cadre) FROM t_staff""",
    "I10_leaked_column_check": "SELECT count(*) AS rows, 0 AS leaked_columns FROM t_staff",
    "I11_bed_demand": f"""SELECT facility_id, month, bed_capacity, {rnd(_need, 3)} AS beds_needed,
        {rnd(f'least({_need}, bed_capacity::DOUBLE)', 3)} AS occupied, {rnd(f'greatest({_need} - bed_capacity, 0.0::DOUBLE)', 3)} AS turned_away
        FROM (SELECT f.facility_id, f.bed_capacity, f.beds_are_day_care, s.month, c.per_phc * 0.5::DOUBLE * s.multiplier
            / [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][list_position({CALENDAR}, s.month)] AS d
          FROM t_fac f JOIN t_scale c ON c.state = f.admin_l1 AND c.district_key = upper(trim(f.admin_l2)) AND c.indicator = '2-HIGH'
          JOIN t_season s ON s.state = c.state AND s.district_key = c.district_key AND s.indicator = '2-HIGH' WHERE f.bed_capacity > 0)""",
    "J17_demand_seasonality": f"SELECT * REPLACE ({rnd('multiplier', 6)} AS multiplier) FROM t_season",
    "J18_demand_scale": f"SELECT * REPLACE ({rnd('per_phc', 6)} AS per_phc) FROM t_scale",
}
