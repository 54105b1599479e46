"""Seasonal exchange as SQL."""
from ..functions.months import CALENDAR, FISCAL
from .base import div, pct, register, rnd
from .stock import m4, s4

_OBS, _SCORED = "('April', 'May', 'June')", "('July','August','September','October','November','December','January','February')"
register("t_profiles", f"""
SELECT state, district_key, district, facility_count, phc_count, population_served, {rnd('per')} AS population_per_phc,
  {rnd(div('l1 - avg(l1) OVER ()', 'stddev_samp(l1) OVER ()'), 4)} AS z_population,
  {rnd(div('l2 - avg(l2) OVER ()', 'stddev_samp(l2) OVER ()'), 4)} AS z_facilities,
  {rnd(div('l3 - avg(l3) OVER ()', 'stddev_samp(l3) OVER ()'), 4)} AS z_phcs,
  {rnd(div('l4 - avg(l4) OVER ()', 'stddev_samp(l4) OVER ()'), 4)} AS z_pop_per_phc
FROM (SELECT *, ln(population_served + 1.0::DOUBLE) AS l1, ln(facility_count + 1.0::DOUBLE) AS l2,
        ln(phc_count + 1.0::DOUBLE) AS l3, ln(per + 1.0::DOUBLE) AS l4
  FROM (SELECT *, population_served::DOUBLE / nullif(phc_count, 0) AS per FROM (
    SELECT admin_l1 AS state, upper(trim(admin_l2)) AS district_key, min(admin_l2) AS district, count(*) AS facility_count,
      count(*) FILTER (facility_type = 'phc') AS phc_count, sum(population_served)::BIGINT AS population_served
    FROM t_facilities WHERE population_served IS NOT NULL GROUP BY 1, 2)
    WHERE (state, district_key) IN (SELECT (admin_l1, district_key) FROM t_demand)))
""")
register("t_vectors", f"""
SELECT state, district_key, atc_class, month, value, baseline, months_with_data,
  {rnd("(CASE WHEN month = 'March' THEN 1.0::DOUBLE ELSE value / baseline END)", 4)} AS multiplier
FROM t_monthly JOIN (SELECT state, district_key, atc_class, avg(value) AS baseline, count(*) FILTER (value > 0) AS months_with_data
  FROM t_monthly WHERE month <> 'March' GROUP BY ALL) USING (state, district_key, atc_class)
WHERE baseline > 0
""")
register("t_monthly", """
SELECT admin_l1 AS state, district_key, atc_class, month, sum(value) AS value
FROM t_demand JOIN (SELECT DISTINCT substr(atc_code, 1, 5) AS atc_class, demand_driver AS indicator FROM t_items
  WHERE atc_code IS NOT NULL AND demand_driver IS NOT NULL) USING (indicator) GROUP BY ALL
""")
_PAIRS = """
SELECT a.state, a.district_key, a.district, a.population_served, a.phc_count, a.population_per_phc,
  b.state AS donor_state, b.district_key AS donor_district_key, b.district AS donor_district,
  b.population_served AS donor_population_served, b.phc_count AS donor_phc_count, b.population_per_phc AS donor_population_per_phc,
  sqrt(pow(a.z_population - b.z_population, 2.0) + pow(a.z_facilities - b.z_facilities, 2.0) + pow(a.z_phcs - b.z_phcs, 2.0)
    + pow(a.z_pop_per_phc - b.z_pop_per_phc, 2.0)) AS profile_distance
FROM t_profiles a JOIN t_profiles b ON {on}
WHERE profile_distance IS NOT NULL
"""
for name, on in (("t_match_out", "a.state <> b.state"), ("t_match_in", "a.state = b.state AND a.district_key <> b.district_key")):
    register(name, f"""SELECT *, row_number() OVER (PARTITION BY state, district_key
      ORDER BY profile_distance, donor_district_key)::INTEGER AS match_rank FROM ({_PAIRS.format(on=on)})
      QUALIFY match_rank <= 3""")


def wmean(col: str) -> str:
    part = lambda m: f"coalesce(max(CASE WHEN month = '{m}' THEN {col} END), 0)"
    return (f"({part('April')} + {part('May')} + {part('June')}) / nullif(count({col}) FILTER (month IN {_OBS}), 0)")


register("t_pooled", f"SELECT atc_class, month, {m4('multiplier')} AS m FROM t_vectors GROUP BY ALL")
for tag, match in (("out", "t_match_out"), ("in", "t_match_in")):
    register(f"t_donor_{tag}", f"""SELECT x.state, x.district_key, x.donor_state, x.donor_district, x.profile_distance,
      v.atc_class, v.month, v.multiplier FROM {match} x JOIN t_vectors v ON v.state = x.donor_state
      AND v.district_key = x.donor_district_key WHERE match_rank = 1""")
    register(f"t_donor_{tag}_w", f"SELECT state, district_key, atc_class, {wmean('multiplier')} AS w FROM t_donor_{tag} GROUP BY ALL")
_A = {"flat": "o", "demo_out": "(o / w1 * m1)", "demo_in": "(o / w2 * m2)", "pooled": "(o / w3 * m3)"}
register("t_eval", f"""
SELECT state, district_key, atc_class, month, donor_state, donor_district, {rnd('profile_distance', 4)} AS profile_distance, actual,
  {', '.join(f"{rnd(e, 2)} AS {a}_forecast" for a, e in _A.items())},
  {', '.join(f"abs({e} - actual) AS {a}_abs_error" for a, e in _A.items())}
FROM (
  SELECT t.state, t.district_key, t.atc_class, t.month, d.donor_state, d.donor_district, d.profile_distance, t.value AS actual,
    ob.o, dw.w AS w1, d.multiplier AS m1, iw.w AS w2, di.multiplier AS m2, pw.w AS w3, p.m AS m3
  FROM t_vectors t
  JOIN (SELECT state, district_key, atc_class, avg(value) AS o FROM t_vectors WHERE month IN {_OBS} GROUP BY ALL) ob
    USING (state, district_key, atc_class)
  JOIN t_donor_out d ON (d.state, d.district_key, d.atc_class, d.month) = (t.state, t.district_key, t.atc_class, t.month)
  JOIN t_donor_out_w dw ON (dw.state, dw.district_key, dw.atc_class) = (t.state, t.district_key, t.atc_class)
  JOIN t_donor_in di ON (di.state, di.district_key, di.atc_class, di.month) = (t.state, t.district_key, t.atc_class, t.month)
  JOIN t_donor_in_w iw ON (iw.state, iw.district_key, iw.atc_class) = (t.state, t.district_key, t.atc_class)
  JOIN t_pooled p ON (p.atc_class, p.month) = (t.atc_class, t.month)
  JOIN (SELECT atc_class, {wmean('m')} AS w FROM t_pooled GROUP BY ALL) pw ON pw.atc_class = t.atc_class
  WHERE t.month IN {_SCORED} AND t.value > 0 AND o > 0 AND dw.w > 0 AND iw.w > 0 AND pw.w > 0)
""")
_W = {a: pct(s4(a + "_abs_error"), "sum(actual)") for a in _A}
register("t_units", """
SELECT substr(atc_code, 1, 5) AS atc_class, sum(units_per_driver_event) AS units_per_event, min(unit) AS unit,
  min(demand_driver) AS driver, array_to_string(list_sort(list(DISTINCT display_name)), ', ') AS medicines
FROM t_items WHERE atc_code IS NOT NULL AND demand_driver IS NOT NULL AND units_per_driver_event IS NOT NULL GROUP BY ALL
""")
register("t_curve", f"""
SELECT atc_class, unit, month, {rnd(s4('actual * units_per_event'))} AS actual,
  {rnd(s4('pooled_forecast * units_per_event'))} AS pooled, {rnd(s4('flat_forecast * units_per_event'))} AS flat,
  (list_position({FISCAL}, month) - 1)::INTEGER AS sort_order
FROM t_eval JOIN t_units USING (atc_class) GROUP BY ALL
""")
register("t_accuracy", f"""
SELECT atc_class, {', '.join(f'{e} AS {a}' for a, e in _W.items())}, count(*) AS observations,
  count(DISTINCT district_key) AS districts, sum(actual) AS total_actual FROM t_eval GROUP BY ALL
""")
_V = ", ".join(f"max(multiplier) FILTER (month = '{m}') AS {m.lower()}" for m in FISCAL)
_P = ", ".join("1.0::DOUBLE AS march" if m == "March" else
               f"coalesce(nullif({rnd(f'''(max(CASE WHEN month = '{m}' THEN value END) / baseline)''', 3)}, 0), 1.0) AS {m.lower()}"
               for m in CALENDAR)
SQL = {
    "G1_district_profiles": "SELECT * FROM t_profiles",
    "G2_pattern_vectors": "SELECT * FROM t_vectors",
    "G3_district_matches": f"SELECT * REPLACE ({rnd('profile_distance', 6)} AS profile_distance) FROM t_match_out",
    "G4_district_matches_same_state": f"SELECT * REPLACE ({rnd('profile_distance', 6)} AS profile_distance) FROM t_match_in",
    "G5_exchange_eval": "SELECT * REPLACE (" + ", ".join(
        f"{rnd(a + '_abs_error', 4)} AS {a}_abs_error" for a in _A) + ") FROM t_eval",
    "G6_exchange_wmape": f"""
        WITH w AS (SELECT count(*) AS predictions, count(DISTINCT state || '|' || district_key) AS districts,
          count(DISTINCT atc_class) AS atc_classes, {', '.join(f'{e} AS {a}_wmape' for a, e in _W.items())} FROM t_eval)
        SELECT *, CASE least(flat_wmape, demo_out_wmape, demo_in_wmape, pooled_wmape) WHEN NULL THEN NULL WHEN flat_wmape THEN 'flat'
          WHEN demo_out_wmape THEN 'demo_out' WHEN demo_in_wmape THEN 'demo_in' WHEN pooled_wmape THEN 'pooled' END AS best_arm,
          {rnd('(flat_wmape - pooled_wmape)', 1)} AS improvement_points,
          {pct('flat_wmape - pooled_wmape', 'flat_wmape')} AS improvement_relative FROM w""",
    "G7_published_vector": f"SELECT state, district_key, atc_class, {_V} FROM t_vectors GROUP BY ALL",
    "G8_thin_history_pick": f"""
        WITH p AS (SELECT state, district_key, atc_class, {s4('flat_abs_error')} AS fe, {s4('pooled_abs_error')} AS pe, sum(actual) AS ta
          FROM t_eval GROUP BY ALL HAVING ta > 100 AND pe < fe
          ORDER BY (fe - pe) / ta DESC, state, district_key, atc_class LIMIT 1)
        SELECT state, district_key, atc_class, month, list_position({FISCAL}, month)::INTEGER AS month_order, actual, flat_forecast,
          pooled_forecast AS borrowed_forecast, {pct('fe', 'ta')} AS flat_wmape, {pct('pe', 'ta')} AS borrowed_wmape,
          {pct('fe - pe', 'ta')} AS improvement_points FROM t_eval JOIN p USING (state, district_key, atc_class)""",
    "G9_local_patterns": f"""
        WITH m AS (SELECT atc_class, indicator, month, sum(value) AS value FROM t_demand
          JOIN (SELECT DISTINCT substr(atc_code, 1, 4) AS atc_class, demand_driver AS indicator FROM t_items
            WHERE atc_code IS NOT NULL AND demand_driver IS NOT NULL) USING (indicator) GROUP BY ALL),
        b AS (SELECT atc_class, avg(value) AS baseline FROM m WHERE month NOT IN ('January', 'February', 'March') GROUP BY ALL),
        f AS (SELECT atc_class, min(indicator) AS indicator FROM m GROUP BY ALL)
        SELECT atc_class, indicator AS based_on_indicator, {_P}
        FROM m JOIN f USING (atc_class, indicator) JOIN b USING (atc_class) WHERE baseline > 0 GROUP BY atc_class, indicator, baseline""",
    "G10_class_units": "SELECT * FROM t_units",
    "G11_outlook_curve": "SELECT * FROM t_curve",
    "G11_outlook_accuracy": "SELECT * FROM t_accuracy",
    "G11_outlook_classes": f"""SELECT atc_class, medicines, unit, count(*) AS months, {rnd(s4('actual * units_per_event'))} AS volume
        FROM t_eval JOIN t_units USING (atc_class) GROUP BY ALL ORDER BY volume DESC, atc_class""",
    "G11_outlook_donors": f"""SELECT donor_district, donor_state, district_key AS receiver, state AS receiver_state,
        {rnd('min(profile_distance)', 3)} AS profile_distance, count(*) AS months FROM t_eval GROUP BY ALL
        ORDER BY months DESC, receiver_state, receiver""",
    "G12_outlook_reliability": f"""
        SELECT atc_class, flat, pooled, {rnd('(flat - pooled)', 1)} AS gain, {rnd('(flat - pooled)', 1)} > 0 AS helps,
          CASE WHEN pooled >= 40 THEN 'bad' WHEN pooled >= 20 THEN 'warn' WHEN {rnd('(flat - pooled)', 1)} > 0 THEN 'ok' ELSE 'bad' END AS level,
          peak_month, trough_month, {rnd(div('hi', 'lo'), 1)} AS swing, months
        FROM t_accuracy JOIN (SELECT atc_class, first(month ORDER BY actual DESC, sort_order) AS peak_month,
          first(month ORDER BY actual, sort_order) AS trough_month, max(actual) AS hi, min(actual) AS lo, count(*) AS months
          FROM t_curve GROUP BY ALL) USING (atc_class)""",
    "G13_peer_vector_store": f"""
        SELECT 'IN' AS country_code, atc_class AS atc_code, district_key AS source_district, {_V} FROM t_vectors
        GROUP BY atc_class, district_key QUALIFY row_number() OVER (PARTITION BY atc_class ORDER BY district_key DESC) = 1""",
}
