"""Scorecards, comparisons and the map as SQL."""
from .base import div, pct, register, rnd, tolong
from .resources import WV
from .stock import m4, s4


def band(v: str, good, fair, higher=True) -> str:
    op = ">=" if higher else "<="
    return f"CASE WHEN {v} IS NULL THEN 'unknown' WHEN {v} {op} {good} THEN 'ok' WHEN {v} {op} {fair} THEN 'warn' ELSE 'bad' END"


def bucket(steps, last) -> str:
    a = " ".join(f"WHEN {c} THEN '{n}'" for c, n in steps)
    b = " ".join(f"WHEN {c} THEN {i + 1}" for i, (c, _) in enumerate(steps))
    return f"CASE {a} ELSE '{last}' END AS bucket, CASE {b} ELSE {len(steps) + 1} END AS sort_order"


register("t_card", """
SELECT count(*) AS tracked, count(*) FILTER (NOT needs_reorder) AS available, count(*) FILTER (needs_reorder) AS short,
  count(*) FILTER (status = 'stocked_out') AS stocked_out, count(*) FILTER (ven_class = 'Vital') AS vital_tracked,
  count(*) FILTER (ven_class = 'Vital' AND NOT needs_reorder) AS vital_available, count(*) FILTER (ven_class = 'Vital' AND needs_reorder) AS vital_short,
  count(*) FILTER (on_hand <= 0 OR days_of_cover <= 7) AS at_risk_week, count(DISTINCT facility_id) AS facilities,
  count(DISTINCT state || '|' || district) AS districts, count(DISTINCT district) FILTER (needs_reorder) AS districts_short,
  count(DISTINCT state) AS states, sum(on_hand)::BIGINT AS units_on_hand FROM t_reorder
""")
register("t_share", f"""SELECT multiplier, count(*) FILTER (absorbs) AS holds, count(*) AS total,
  {pct('count(*) FILTER (absorbs)', 'count(*)')} AS pct FROM t_absorb GROUP BY ALL""")
register("t_league", f"""
SELECT state, district, count(*) AS tracked, count(DISTINCT facility_id) AS centres, {pct('count(*) FILTER (NOT needs_reorder)', 'count(*)')} AS score,
  {pct("count(*) FILTER (ven_class = 'Vital' AND NOT needs_reorder)", "count(*) FILTER (ven_class = 'Vital')")} AS secondary,
  {pct("count(*) FILTER (status = 'stocked_out')", 'count(*)')} AS failure, {rnd('(sum(lead_time_days)::DOUBLE / count(*))', 1)} AS lead_days,
  {rnd(m4('distance_to_hq_km'), 0)} AS km FROM t_reorder GROUP BY ALL HAVING tracked >= 8
""")
register("t_centres", f"""SELECT admin_l1 AS state, admin_l2 AS district, {rnd(m4('latitude'), 5)} AS lat, {rnd(m4('longitude'), 5)} AS lon
  FROM t_valid GROUP BY ALL""")
register("t_mapd", f"""
SELECT k.*, lat, lon, pct_hold, positions FROM (
  SELECT state, district, count(*) AS tracked, count(*) FILTER (needs_reorder) AS short, count(*) FILTER (needs_reorder AND ven_class = 'Vital') AS vital_short,
    count(*) FILTER (status = 'stocked_out') AS stocked_out, count(DISTINCT facility_id) AS reporting_facilities, sum(on_hand)::BIGINT AS units_on_hand
  FROM t_reorder GROUP BY ALL) k JOIN t_centres USING (state, district)
LEFT JOIN (SELECT state, district, {pct('count(*) FILTER (absorbs)', 'count(*)')} AS pct_hold, count(*) AS positions FROM t_absorb
  WHERE multiplier = 3 GROUP BY ALL) USING (state, district)
""")
register("t_mapf", """
SELECT fl.*, a.lat AS from_lat, a.lon AS from_lon, b.lat AS to_lat, b.lon AS to_lon FROM (
  SELECT f.admin_l1 AS from_state, f.admin_l2 AS from_district, to_state, to_district, count(*) AS moves, sum(quantity)::BIGINT AS units,
    count(*) FILTER (ven_class = 'Vital') AS vital_moves, max(distance_km) AS km, max(priority_score) AS top_priority,
    min(CASE status WHEN 'stocked_out' THEN 1 WHEN 'critical' THEN 2 ELSE 3 END) AS severity
  FROM t_recs r JOIN t_facilities f ON f.facility_id = r.from_facility_id GROUP BY ALL) fl
JOIN t_centres a ON a.state = from_state AND a.district = from_district JOIN t_centres b ON b.state = to_state AND b.district = to_district
WHERE NOT (from_state = to_state AND from_district = to_district)
""")
_bc = """SELECT count(*) AS centres, sum(bed_capacity)::BIGINT AS beds, sum(free_beds)::BIGINT AS free_beds, sum(turned_away)::BIGINT AS turned_away,
  {m} AS mean_occupancy, count(*) FILTER (status = 'over_capacity') AS over_capacity, count(*) FILTER (turned_away > 0) AS turning_away,
  count(DISTINCT state || '|' || district) AS districts, count(DISTINCT district) FILTER (turned_away > 0) AS districts_affected FROM t_beds"""
_free = rnd("(100.0::DOUBLE - 100.0::DOUBLE * mean_occupancy)", 1)
_over, _turn = pct("over_capacity", "centres"), pct("turning_away", "centres")
_spr = f"CASE WHEN districts > 1 THEN {pct('districts_affected', 'districts')} END"
_g = [("availability", pct("available", "tracked"), 90, 75, True), ("vital_availability", pct("vital_available", "vital_tracked"), 95, 85, True),
      ("stocked_out", pct("stocked_out", "tracked"), 1, 5, False), ("at_risk_week", pct("at_risk_week", "tracked"), 5, 15, False),
      ("spread", f"(CASE WHEN districts > 1 THEN {pct('districts_short', 'districts')} END)", 25, 60, False),
      ("resilience", "(SELECT pct FROM t_share WHERE multiplier = 3)", 70, 35, True)]
_filled = "least(100.0::DOUBLE, " + rnd("(100.0::DOUBLE - 100.0::DOUBLE * coalesce(mean_vacancy, 0))", 1) + ")"
_worst = rnd("(100.0::DOUBLE * wv)", 1)
_bad = pct("roles_badly_short", "roles_scored")
_LEAGUE = """WITH r AS (SELECT district, score, row_number() OVER (ORDER BY score IS NULL, score, district) - 1 AS rank, count(*) OVER () AS n FROM ({src})),
  m AS (SELECT * FROM r WHERE rank = n // 2)
  SELECT count(*) AS districts, count(*) FILTER (score < 60) AS under_60, count(*) FILTER (score >= 60 AND score < 75) AS from_60,
    count(*) FILTER (score >= 75 AND score < 90) AS from_75, count(*) FILTER (score >= 90) AS from_90,
    max(district) FILTER (rank = 0) AS worst, max(district) FILTER (rank = n - 1) AS best, (SELECT district FROM m) AS typical,
    (SELECT score FROM m) AS typical_score, min(score) AS lowest, max(score) AS highest,
    (count(*) FILTER (score > (SELECT score FROM m)))::INTEGER AS above_typical, (count(*) FILTER (score < (SELECT score FROM m)))::INTEGER AS below_typical,
    list_sort(list(score) FILTER (score IS NOT NULL))[count(score) // 2 + 1] AS median, {gap} AS gap FROM r"""
SQL = {
    "M1_scorecard": "SELECT * FROM t_card",
    "M2_stockout_timeline": f"""SELECT {bucket([('on_hand <= 0', 'Already out'), ('days_of_cover <= 7', 'Within a week'), ('days_of_cover <= 14', '1 to 2 weeks'), ('days_of_cover <= 30', '2 to 4 weeks')], 'More than a month')},
        count(*) AS n FROM t_reorder WHERE days_of_cover IS NOT NULL OR on_hand <= 0 GROUP BY ALL""",
    "M3_worst_medicines": """SELECT item_name, min(ven_class) AS ven_class, count(DISTINCT facility_id) AS centres, count(DISTINCT state || '|' || district) AS districts
        FROM t_reorder WHERE needs_reorder GROUP BY item_name ORDER BY centres DESC, districts DESC, item_name LIMIT 10""",
    "M4_ven_breakdown": f"""SELECT ven_class, count(*) AS tracked, count(*) FILTER (needs_reorder) AS short,
        {pct('count(*) FILTER (needs_reorder)', 'count(*)')} AS pct FROM t_reorder GROUP BY ALL""",
    "M5_district_quadrant": f"""SELECT *, pct_short >= 40 AND pct_cope < 35 AS critical FROM (
        SELECT district, min(state) AS state, count(*) AS tracked, count(*) FILTER (ven_class = 'Vital' AND needs_reorder) AS vital_short,
          count(*) FILTER (status = 'stocked_out') AS stocked_out, {pct('count(*) FILTER (needs_reorder)', 'count(*)')} AS pct_short
        FROM t_reorder GROUP BY district HAVING tracked >= 8) JOIN (SELECT district, {pct('count(*) FILTER (absorbs)', 'count(*)')} AS pct_cope
        FROM t_absorb WHERE multiplier = 3 GROUP BY district) USING (district)""",
    "M6_absorption_share": "SELECT * FROM t_share",
    "M6_queue": """SELECT (SELECT count(*) FROM t_impact WHERE lead_time_decisive) AS transfer_only, count(*) AS recommended,
        coalesce(sum(quantity), 0)::BIGINT AS units, count(*) FILTER (ven_class = 'Vital') AS vital FROM t_recs""",
    "M7_grades": " UNION ALL ".join(f"SELECT '{n}' AS grade, {v} AS pct, {band(v, a, b, h)} AS tone FROM t_card" for n, v, a, b, h in _g),
    "M8_bed_scorecard": f"""SELECT *, {_free} AS free_pct, {band(_free, 40, 15)} AS free_tone, {_over} AS over_pct, {band(_over, 5, 20, False)} AS over_tone,
        {_turn} AS turning_pct, {band(_turn, 5, 20, False)} AS turning_tone, {_spr} AS spread_pct, {band('(' + _spr + ')', 25, 60, False)} AS spread_tone
        FROM ({_bc.format(m=rnd(m4('occupancy_rate'), 4))})""",
    "M8_bed_distribution": f"""SELECT {bucket([('occupancy_rate >= 1', 'Over capacity'), ('occupancy_rate >= 0.85::DOUBLE', '85% or more full'), ('occupancy_rate >= 0.5', 'Half to 85% full'), ('occupancy_rate > 0', 'Under half full')], 'Empty')},
        count(*) AS n FROM t_beds GROUP BY ALL""",
    "M8_bed_ranking": """SELECT facility_name AS name, turned_away AS value, district || ' - ' || bed_capacity || ' beds' AS sub, status = 'over_capacity' AS flag
        FROM t_beds WHERE turned_away > 0 ORDER BY turned_away DESC, facility_id LIMIT 10""",
    "M8_bed_quadrant": f"""SELECT district, min(state) AS state, {rnd('(100.0::DOUBLE * ' + m4('occupancy_rate') + ')', 1)} AS x,
        {pct('sum(free_beds)', 'sum(bed_capacity)')} AS y, count(*) AS tracked, sum(turned_away) > 0 AND {m4('occupancy_rate')} >= 0.5 AS critical
        FROM t_beds GROUP BY district""",
    "M8_bed_breakdown": f"""SELECT name, a, b FROM (SELECT state AS name, {rnd(s4('(CASE WHEN mean_occupied IS NOT NULL THEN least(mean_occupied, bed_capacity::DOUBLE) END)'))} AS a,
        {rnd(s4('(CASE WHEN mean_occupied IS NOT NULL THEN greatest(bed_capacity::DOUBLE - mean_occupied, 0.0::DOUBLE) END)'))} AS b, sum(bed_capacity) AS c
        FROM t_beds GROUP BY state) ORDER BY c DESC, name""",
    "M9_staff_scorecard": f"""
        WITH s AS (SELECT count(*) AS facility_cadres, count(DISTINCT facility_id) AS centres, sum(sanctioned_posts)::BIGINT AS posts,
          count(DISTINCT state || '|' || cadre) AS roles, {rnd(WV, 4)} AS mean_vacancy, count(*) FILTER (vacancy_rate IS NULL) AS no_figure,
          coalesce(sum(nurses_short_of_bed_norm), 0)::BIGINT AS nurses_short, count(DISTINCT state || '|' || district) AS districts, count(DISTINCT state) AS states FROM t_staff),
        r AS (SELECT state, cadre, min(vacancy_rate) AS v FROM t_staff WHERE vacancy_rate IS NOT NULL GROUP BY ALL),
        q AS (SELECT count(*) FILTER (v >= 0.3::DOUBLE) AS roles_badly_short, count(*) AS roles_scored, first(state ORDER BY v DESC, state, cadre) AS worst_state,
          first(cadre ORDER BY v DESC, state, cadre) AS worst_cadre, max(v) AS wv FROM r)
        SELECT * EXCLUDE (wv), {_worst} AS worst_pct, {band(_worst, 15, 30, False)} AS worst_tone, {_filled} AS filled_pct,
          {band(_filled, 90, 75)} AS filled_tone, {_bad} AS badly_short_pct, {band(_bad, 20, 40, False)} AS badly_short_tone FROM s, q""",
    "M9_staff_distribution": f"""SELECT {bucket([('vacancy_rate >= 0.5', 'Half the posts empty'), ('vacancy_rate >= 0.3::DOUBLE', '30% to 50% empty'), ('vacancy_rate >= 0.1::DOUBLE', '10% to 30% empty'), ('vacancy_rate > 0', 'Under 10% empty')], 'Fully staffed')},
        count(*) AS n FROM t_staff GROUP BY ALL""",
    "M9_staff_ranking": f"""SELECT cadre AS name, {rnd('(100.0::DOUBLE * ' + WV + ')', 1)} AS value, sum(sanctioned_posts)::BIGINT || ' sanctioned posts' AS sub,
        {WV} >= 0.3::DOUBLE AS flag FROM t_staff GROUP BY cadre ORDER BY value DESC NULLS LAST, name LIMIT 10""",
    "M9_staff_quadrant": f"""SELECT state, cadre AS name, {rnd('(100.0::DOUBLE * min(vacancy_rate))', 1)} AS x, sum(sanctioned_posts)::BIGINT AS y,
        count(DISTINCT facility_id) AS tracked, min(vacancy_rate) >= 0.3::DOUBLE AS critical FROM t_staff WHERE vacancy_rate IS NOT NULL GROUP BY ALL""",
    "M9_staff_breakdown": f"""SELECT name, a, b FROM (SELECT state AS name, {rnd(s4('(sanctioned_posts * (1.0::DOUBLE - vacancy_rate))'))} AS a,
        {rnd(s4('(sanctioned_posts * vacancy_rate)'))} AS b, sum(sanctioned_posts) AS p FROM t_staff WHERE vacancy_rate IS NOT NULL GROUP BY state)
        ORDER BY p DESC, name""",
    "M10_reporting_geography": """SELECT state, (sum(lines) OVER (PARTITION BY state))::BIGINT AS state_lines, district,
        (sum(lines) OVER (PARTITION BY state, district))::BIGINT AS district_lines, facility_id, name, lines
        FROM (SELECT state, district, facility_id, min(facility_name) AS name, count(*) AS lines FROM t_reorder GROUP BY ALL)""",
    "M10_geography_levels": """WITH f AS (SELECT state, district, facility_id, min(facility_name) AS name, count(*) AS lines FROM t_reorder GROUP BY ALL)
        SELECT 'facility' AS level, state, district, facility_id, name, lines, 1::BIGINT AS facilities FROM f
        UNION ALL SELECT 'district', state, district, NULL, NULL, sum(lines)::BIGINT, count(*) FROM f GROUP BY state, district
        UNION ALL SELECT 'state', state, NULL, NULL, NULL, sum(lines)::BIGINT, count(*) FROM f GROUP BY state
        UNION ALL SELECT 'all', NULL, NULL, NULL, NULL, sum(lines)::BIGINT, count(*) FROM f""",
    "M10_geography_totals": """SELECT count(DISTINCT state) AS states, count(DISTINCT (state, district)) AS districts,
        count(DISTINCT (state, district, facility_id)) AS facilities, count(*) AS lines FROM t_reorder""",
    "M11_medicine_comparison": "SELECT * FROM t_league",
    "M12_lead_time_structure": f"""SELECT * REPLACE (band AS band) FROM (SELECT {bucket([('lead < 9', 'Under 9 days'), ('lead < 12', '9 to 12 days'), ('lead < 15', '12 to 15 days')], '15 days or more').replace('AS bucket', 'AS band')},
        count(*) AS districts, {rnd(m4('score'), 1)} AS mean_score, {rnd(m4('lead'), 1)} AS mean_lead, {rnd(m4('km'), 0)} AS mean_km
        FROM (SELECT state, district, count(*) AS tracked, 100.0::DOUBLE * ((count(*) FILTER (NOT needs_reorder))::DOUBLE / count(*)) AS score,
          sum(lead_time_days)::DOUBLE / count(*) AS lead, {m4('distance_to_hq_km')} AS km FROM t_reorder GROUP BY ALL HAVING tracked >= 8) GROUP BY ALL)""",
    "M12_lead_time_correlation": f"""SELECT count(*) AS districts, {rnd('(covar_samp(score, lead) / nullif(stddev_samp(score) * stddev_samp(lead), 0))', 4)} AS correlation FROM (SELECT state, district, count(*) AS tracked,
        (count(*) FILTER (NOT needs_reorder))::DOUBLE / count(*) AS score, sum(lead_time_days)::DOUBLE / count(*) AS lead FROM t_reorder GROUP BY ALL HAVING tracked >= 8)""",
    "B5_declared_columns": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
    "B1_scope_alerts": """SELECT facility_id, item_id, priority_score, status FROM t_reorder WHERE needs_reorder AND state = 'ASIA' AND district = 'NATION_7'
        ORDER BY priority_score DESC, days_of_cover ASC NULLS FIRST, facility_id, item_id""",
    "B2_scope_absorption": "SELECT state, district, atc_class, multiplier, absorbs FROM t_absorb WHERE state = 'EUROPE'",
    "B3_scope_vital_moves": "SELECT recommendation_id, to_state, quantity FROM t_recs WHERE to_state = 'AMERICA' AND ven_class = 'Vital'",
    "M13_bed_comparison": f"""SELECT state, district, count(*) AS tracked, {pct('sum(free_beds)', 'sum(bed_capacity)')} AS score,
        {pct("count(*) FILTER (status = 'over_capacity')", 'count(*)')} AS secondary, sum(turned_away)::BIGINT AS failure FROM t_beds GROUP BY ALL""",
    "M13_staff_comparison": f"""SELECT state AS district, count(*) AS tracked, count(DISTINCT facility_id) AS centres,
        {rnd('(100.0::DOUBLE - 100.0::DOUBLE * ' + m4('vacancy_rate') + ')', 1)} AS score,
        {rnd('(100.0::DOUBLE - 100.0::DOUBLE * ' + m4("(CASE WHEN cadre = 'Doctor (allopathic)' THEN vacancy_rate END)") + ')', 1)} AS secondary,
        sum(sanctioned_posts)::BIGINT AS failure FROM t_staff GROUP BY state""",
    "M13_staff_cadres": f"""SELECT cadre AS district, count(*) AS tracked, count(DISTINCT facility_id) AS centres,
        {rnd('(100.0::DOUBLE - 100.0::DOUBLE * ' + m4('vacancy_rate') + ')', 1)} AS score, sum(sanctioned_posts)::BIGINT AS secondary
        FROM t_staff WHERE state = 'ASIA' GROUP BY cadre""",
    "M14_league_finish": _LEAGUE.format(src="SELECT district, score FROM t_league", gap=rnd("(max(score) - min(score))", 1)),
    "M14_league_ends": """(SELECT 'worst' AS "end", district, score FROM t_league ORDER BY score ASC NULLS LAST, district LIMIT 10)
        UNION ALL (SELECT 'best', district, score FROM t_league ORDER BY score DESC NULLS FIRST, district DESC LIMIT 10)""",
    "M15_map_districts": "SELECT * FROM t_mapd",
    "M15_map_flows": "SELECT * FROM t_mapf",
    "M15_map_summary": """SELECT count(*) AS districts, count(*) FILTER (vital_short > 0) AS districts_with_vital_short,
        count(*) FILTER (pct_hold < 35) AS fragile_districts, (SELECT count(*) FROM t_mapf) AS flows,
        (SELECT coalesce(sum(units), 0)::BIGINT FROM t_mapf) AS units_in_flight, (SELECT coalesce(max(km), 0.0::DOUBLE) FROM t_mapf) AS longest_km FROM t_mapd""",
    "M16_facility_points": f"""SELECT {rnd('latitude', 3)} AS lat, {rnd('longitude', 3)} AS lon, CASE WHEN facility_type = 'phc' THEN 0 ELSE 1 END AS type,
        CASE WHEN is_forecast_facility THEN 1 ELSE 0 END AS reporting FROM t_valid WHERE facility_type IN ('phc', 'chc')""",
    "M16_facility_point_counts": f"""SELECT *, {pct('reporting', 'total')} AS share FROM (SELECT count(*) FILTER (has_valid_coords AND facility_type = 'phc') AS phc,
        count(*) FILTER (has_valid_coords AND facility_type = 'chc') AS chc, count(*) FILTER (has_valid_coords) AS total,
        count(*) FILTER (has_valid_coords AND is_forecast_facility) AS reporting,
        count(*) FILTER (NOT has_valid_coords AND latitude IS NOT NULL AND longitude IS NOT NULL) AS unplaceable
        FROM t_facilities WHERE facility_type IN ('phc', 'chc'))""",
    "M17_dashboard_stats": """SELECT count(*) AS tracked_series, count(*) FILTER (needs_reorder) AS open_alerts, count(*) FILTER (status = 'stocked_out') AS stocked_out,
        count(*) FILTER (status = 'critical') AS critical, count(*) FILTER (needs_reorder AND ven_class = 'Vital') AS vital_alerts,
        count(*) FILTER (needs_reorder AND on_hand > legacy_threshold) AS caught_by_lead_time_rule,
        (SELECT count(*) FROM t_recs) AS pending_transfers, (SELECT coalesce(sum(quantity), 0)::BIGINT FROM t_recs) AS units_to_move,
        (SELECT coalesce(sum(waste_avoided_units), 0)::BIGINT FROM t_recs) AS waste_avoided_units, (SELECT count(*) FROM t_recs WHERE is_substitution) AS substitutions,
        (SELECT sum(facility_count)::BIGINT FROM t_geo WHERE level = 'state') AS facilities, (SELECT sum(phc_count)::BIGINT FROM t_geo WHERE level = 'state') AS phcs,
        (SELECT sum(demo_count)::BIGINT FROM t_geo WHERE level = 'state') AS demo_facilities, (SELECT sum(district_count)::BIGINT FROM t_geo WHERE level = 'state') AS districts,
        (SELECT sum(population_served)::BIGINT FROM t_geo WHERE level = 'state') AS population_served,
        (SELECT count(*) FROM t_stock, t_today WHERE source <> 'seed' AND event_date = today) AS captures_today,
        (SELECT count(*) FROM t_stock, t_today WHERE source <> 'seed' AND event_date >= today - 7) AS captures_last_7_days,
        (SELECT count(*) FROM t_stock WHERE source <> 'seed') AS captures_all_time FROM t_reorder""",
}
