"""Loading operators as SQL."""
from ..functions.months import CALENDAR
from ..sources import rawforms as rf
from ..sources import testbed as tb
from .base import div, register, rnd, tolong

register("t_pop", """
SELECT r_name AS state, unnest(['sub_cen', 'phc', 'chc']) AS type,
  unnest([n, n * 5, CASE WHEN r_name = 'ASIA' THEN NULL ELSE n * 20 END]) AS population_served
FROM (SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
""")
register("t_reg", """
SELECT f.*, CASE WHEN facility_type IN ('dis_h', 's_t_h') THEN (SELECT population_served FROM t_pop p WHERE p.state = f.admin_l1 AND p.type = 'chc')
    ELSE (SELECT population_served FROM t_pop p WHERE p.state = f.admin_l1 AND p.type = f.facility_type) END AS population_served,
  admin_l1 IN ('ASIA', 'EUROPE') AND facility_type = 'phc' AS is_demo_facility
FROM (SELECT 'IN-' || s_suppkey AS facility_id, 'IN' AS country_code, CASE WHEN s_suppkey % 13 <> 0 THEN s_name ELSE 'Unknown' END AS name,
    r_name AS admin_l1, CASE WHEN s_suppkey % 17 <> 0 THEN n_name ELSE '' END AS admin_l2, NULL::VARCHAR AS admin_l3,
    CASE WHEN s_suppkey % 19 = 0 THEN 'unknown' ELSE ['phc', 'chc', 'sub_cen', 'dis_h', 's_t_h'][s_suppkey % 5 + 1] END AS facility_type,
    CASE WHEN s_suppkey % 23 = 0 THEN NULL ELSE ['rural', 'urban'][s_suppkey % 2 + 1] END AS location_type,
    CASE WHEN s_suppkey % 31 <> 0 THEN ((s_suppkey * 37) % 2000)::DOUBLE / 100.0::DOUBLE END AS latitude,
    70.0::DOUBLE + ((s_suppkey * 53) % 2000)::DOUBLE / 100.0::DOUBLE AS longitude
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) f
""")
register("t_long", f"""
SELECT 'IN' AS country_code, k.admin_l1, k.admin_l2, k.admin_l2 AS district_key, m.month, k.indicator, coalesce(v.n, 0)::DOUBLE AS value
FROM (SELECT DISTINCT r_name AS admin_l1, n_name AS admin_l2, o_orderpriority AS indicator FROM t_ord WHERE o_orderstatus <> 'P') k
CROSS JOIN (SELECT unnest({CALENDAR}) AS month) m
LEFT JOIN (SELECT r_name, n_name, o_orderpriority, {CALENDAR}[month(o_orderdate)] AS month, count(*) AS n FROM t_ord WHERE o_orderstatus <> 'P' GROUP BY ALL) v
  ON v.r_name = k.admin_l1 AND v.n_name = k.admin_l2 AND v.o_orderpriority = k.indicator AND v.month = m.month
""")
register("t_ord", """SELECT r_name, n_name, o_orderpriority, o_orderstatus, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
_FORM = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rf.FORMS.items()) + " END"
register("t_parsed", f"""
SELECT p_partkey AS ord, CASE WHEN p_partkey % 50 = 7 THEN p_name || ' + extra' ELSE p_name END AS key,
  CASE WHEN p_partkey % 50 = 7 THEN p_name || ' + extra' WHEN p_partkey % 3 = 0 THEN upper(p_name)
    WHEN p_partkey % 3 = 1 THEN p_name || ' (as mentioned)' ELSE p_name || '*' END AS medicine,
  {_FORM} AS dosage_forms, ['P,S,T', 'S,T', 'S,T', 'T'][p_partkey % 4 + 1] AS level_of_care,
  CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE p_size::VARCHAR END AS section_no FROM part
""")
register("t_merged", """
SELECT key, first(medicine ORDER BY ord) AS medicine, first(section_no ORDER BY ord) AS section_no,
  coalesce(first(level_of_care ORDER BY ord DESC) FILTER (contains(level_of_care, 'P')), first(level_of_care ORDER BY ord)) AS level_of_care,
  min(ord) AS ord, (SELECT coalesce(string_agg(dosage_forms, ' | ' ORDER BY o), '') FROM (SELECT dosage_forms, min(ord) AS o FROM t_parsed q
    WHERE q.key = p.key AND dosage_forms <> '' GROUP BY ALL)) AS dosage_forms
FROM t_parsed p GROUP BY key
""")
register("t_prices", f"""
SELECT p_brand AS doc_id, CASE WHEN pk % 4 = 0 THEN nm WHEN pk % 4 = 3 THEN 'Ferrous ' || nm || ' acid (B)' ELSE
    coalesce(last_value(CASE WHEN pk % 4 = 0 THEN nm WHEN pk % 4 = 3 THEN 'Ferrous ' || nm || ' acid (B)' END IGNORE NULLS)
      OVER (PARTITION BY p_brand ORDER BY pk ROWS UNBOUNDED PRECEDING), '') END AS medicine,
  ['Tablet 500 mg 1 Tablet', 'Capsule 250 mg 1 Capsule', 'Injection 5 mg/ml 1 ml', 'Tablet 100 mg 1 Tablet'][pk % 4 + 1] AS form,
  price, '1499(E)' AS notification, '30.03.2022' AS date
FROM (SELECT p_brand, p_partkey AS pk, (floor(p_retailprice * 100 + 0.5::DOUBLE) / 100)::DOUBLE AS price,
  array_to_string([upper(w[1:1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], ' ') AS nm FROM part)
""")
register("t_cand", """
SELECT facility_id, admin_l1, admin_l2, row_number() OVER (PARTITION BY admin_l1, admin_l2 ORDER BY md5(facility_id))::INTEGER AS rank_in_district
FROM t_facilities WHERE facility_type = 'phc' AND latitude IS NOT NULL AND longitude IS NOT NULL AND population_served IS NOT NULL
  AND (admin_l1, upper(trim(admin_l2))) IN (SELECT (admin_l1, district_key) FROM t_demand)
""")
_CODE = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rf.CODES) + ")"
_UNIT = ("CASE WHEN contains(d, 'tablet') THEN 'tablet' WHEN contains(d, 'capsule') THEN 'capsule' WHEN contains(d, 'injection') THEN 'vial' "
         "WHEN contains(d, 'oral liquid') THEN 'bottle' WHEN contains(d, 'cream') THEN 'tube' ELSE 'unit' END")
SQL = {
    "A1_load_facilities": "SELECT * FROM t_reg",
    "A2_population_lookup": "SELECT * FROM t_pop",
    "A3_replace_slice": """SELECT admin_l1, count(*) AS n, sum(CASE WHEN admin_l1 = 'ASIA' THEN value * 2 ELSE value END) AS value FROM t_demand GROUP BY ALL""",
    "A3_slice_guard": """SELECT count(*) FILTER (admin_l1 <> 'ASIA') AS before_outside, count(*) FILTER (admin_l1 = 'ASIA') AS before_inside,
        sum(value) FILTER (admin_l1 <> 'ASIA') AS before_sum, count(*) FILTER (admin_l1 <> 'ASIA') AS after_outside,
        count(*) FILTER (admin_l1 = 'ASIA') AS after_inside, sum(value) FILTER (admin_l1 <> 'ASIA') AS after_sum, true AS untouched FROM t_demand""",
    "A4_load_verify": """SELECT count(*) AS rows_total, count(*) AS rows_loaded, count(DISTINCT country_code) AS countries, count(DISTINCT facility_id) AS ids,
        count(DISTINCT admin_l1) AS states, count(*) FILTER (population_served IS NULL) AS missing_population,
        count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS missing_coords, (SELECT count(*) FROM supplier) AS source_rows, true AS ok FROM t_reg""",
    "A5_melt_demand": "SELECT * FROM t_long",
    "A6_district_key": """SELECT CASE WHEN c_custkey % 3 = 1 THEN 'AHMEDNAGAR' ELSE 'NATION ' || c_nationkey END AS district_key, count(*) AS n FROM customer GROUP BY 1""",
    "A6_district_key_rows": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'AHMEDNAGAR' ELSE 'NATION ' || c_nationkey END AS district_key FROM customer""",
    "A7_completeness_gate": """SELECT admin_l1, count(*) AS rows_loaded, count(DISTINCT admin_l2) AS districts, count(DISTINCT indicator) AS indicators,
        count(DISTINCT month) AS months, count(DISTINCT month) = 12 AND count(DISTINCT indicator) = 5 AS ok FROM t_long GROUP BY ALL""",
    "A7_absent_codes": """SELECT '9.X' AS code UNION ALL SELECT c FROM (SELECT unnest(['1.F','1.O','2.F','2.O','3.F','3.O','4.F','4.O','5.F','5.O']) AS c)
        WHERE c NOT IN (SELECT substr(o_orderpriority, 1, 1) || '.' || o_orderstatus FROM orders)""",
    "A8_merge_catalogue": "SELECT * FROM t_merged",
    "A9_infer_unit": f"SELECT unit, count(*) AS n FROM (SELECT {_UNIT} AS unit FROM (SELECT lower(dosage_forms) AS d FROM t_parsed)) GROUP BY ALL",
    "A9_infer_unit_rows": f"SELECT ord, {_UNIT} AS unit FROM (SELECT ord, lower(dosage_forms) AS d FROM t_parsed)",
    "A10_classify_ven_rows": """SELECT ord, CASE WHEN key IN ('red widget', 'blue bolt') THEN 'Vital' WHEN key = 'small ring' THEN 'Desirable'
        WHEN try_cast(section_no AS INTEGER) IN (1, 3, 4, 9, 19, 20, 22, 25, 27) THEN 'Vital'
        WHEN try_cast(section_no AS INTEGER) IN (11, 12, 16, 26) THEN 'Desirable' ELSE 'Essential' END AS ven_class FROM t_parsed""",
    "A10_classify_ven": """SELECT ven_class, count(*) AS n FROM (SELECT CASE WHEN key IN ('red widget', 'blue bolt') THEN 'Vital' WHEN key = 'small ring' THEN 'Desirable'
        WHEN try_cast(section_no AS INTEGER) IN (1, 3, 4, 9, 19, 20, 22, 25, 27) THEN 'Vital'
        WHEN try_cast(section_no AS INTEGER) IN (11, 12, 16, 26) THEN 'Desirable' ELSE 'Essential' END AS ven_class FROM t_parsed) GROUP BY ALL""",
    "A11_item_id": """SELECT ord, medicine, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ord) AS n
        FROM (SELECT ord, medicine, upper(substr(trim(regexp_replace(key, '[^a-z0-9]+', '-', 'g'), '-'), 1, 8)) AS s FROM t_merged))""",
    "A11_item_id_full": """SELECT ord, medicine, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ord) AS n
        FROM (SELECT ord, medicine, upper(substr(trim(regexp_replace(key, '[^a-z0-9]+', '-', 'g'), '-'), 1, 44)) AS s FROM t_merged))""",
    "A12_code_lookup": f"""SELECT ord, medicine, coalesce((SELECT c FROM {_CODE} t(k, c) WHERE k = key),
        CASE WHEN NOT contains(key, '+') AND length(split_part(key, ' ', 1)) > 4 THEN (SELECT c FROM {_CODE} t(k, c) WHERE k = split_part(key, ' ', 1)) END) AS atc_code FROM t_merged""",
    "A13_curation_check": """SELECT 'item' AS kind, 'X ' || display_name AS missing FROM t_items WHERE split_part(item_id, '#', 2)::BIGINT % 5 = 0
        UNION ALL SELECT 'driver', 'No such driver' WHERE EXISTS (SELECT 1 FROM t_items WHERE item_id = 'Brand#3')
        UNION ALL SELECT DISTINCT 'driver', demand_driver FROM t_items WHERE demand_driver IS NOT NULL AND item_id <> 'Brand#3' AND demand_driver NOT IN (SELECT indicator FROM t_demand)""",
    "A14_load_staffing": f"""SELECT state, cadre, len(types)::INTEGER AS n_types, required, CASE WHEN sanctioned > 0 THEN sanctioned END AS sanctioned,
        CASE WHEN sanctioned > 0 THEN in_position END AS in_position, CASE WHEN sanctioned > 0 THEN vacant END AS vacant, vacancy_rate, 2022::BIGINT AS source_year,
        lower(regexp_replace(cadre, '[^A-Za-z]+', '-', 'g')) || '.csv' AS source_file FROM t_staffing""",
    "A15_staffing_self_check": """SELECT lower(regexp_replace(cadre, '[^A-Za-z]+', '-', 'g')) || '.csv' AS source_file, sum(required)::BIGINT AS required, sum(sanctioned)::BIGINT AS sanctioned,
        sum(in_position)::BIGINT AS in_position, sum(required)::BIGINT AS required_national, sum(sanctioned)::BIGINT AS sanctioned_national,
        sum(in_position)::BIGINT AS in_position_national, true AS ok FROM t_staffing GROUP BY cadre""",
    "A16_price_rows": "SELECT * FROM t_prices",
    "A17_choose_price": """
        WITH b AS (SELECT lower(medicine) AS medicine, CASE WHEN ends_with(form, 'Tablet') THEN 'tablet' WHEN ends_with(form, 'Capsule') THEN 'capsule' ELSE 'vial' END AS unit,
          price, form FROM t_prices),
        i AS (SELECT DISTINCT p_name AS item_match, unnest(['tablet', 'vial', 'bottle']) AS unit FROM part)
        SELECT item_match, unit, price AS ceiling_price, form AS strength FROM i JOIN b USING (unit) WHERE contains(medicine, lower(item_match))
        QUALIFY row_number() OVER (PARTITION BY item_match, unit ORDER BY price, form) = 1""",
    "A18_second_country": """
        WITH c AS (SELECT s_suppkey * 3 AS k, n_name, r_name, CASE WHEN s_suppkey % 7 <> 0 THEN ('-20.' || lpad((s_suppkey % 100)::VARCHAR, 2, '0'))::DOUBLE END AS lat,
          ('-45.' || lpad((s_suppkey % 100)::VARCHAR, 2, '0'))::DOUBLE AS lon FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT 'BR-' || CASE WHEN c_custkey = 0 THEN '' ELSE c_custkey::VARCHAR END AS facility_id, 'BR' AS country_code, CASE WHEN c_custkey % 13 <> 0 THEN c_name ELSE 'Unknown' END AS name,
          coalesce(r_name, '') AS admin_l1, coalesce(n_name, '') AS admin_l2, CASE c_custkey % 4 WHEN 1 THEN 'Posto de Saúde' ELSE 'Centro de Saúde/UBS' END AS facility_type,
          coalesce(lat, CASE WHEN c_custkey % 5 <> 0 THEN ('-19.' || lpad(((c_custkey * 3) % 100)::VARCHAR, 2, '0'))::DOUBLE END) AS latitude,
          coalesce(lon, CASE WHEN c_custkey % 5 <> 0 THEN ('-44.' || lpad(((c_custkey * 7) % 100)::VARCHAR, 2, '0'))::DOUBLE END) AS longitude,
          1000 * (c_nationkey + 1)::BIGINT AS population_served, coalesce(n_name, '') = 'NATION_3' AS is_demo_facility
        FROM customer LEFT JOIN c ON c.k = c_custkey WHERE c_custkey % 4 IN (1, 2) AND c_custkey % 11 <> 0""",
    "A19_backfill_column": """SELECT facility_id, CASE WHEN k % 3 = 0 THEN location_type ELSE ['rural', 'urban', NULL][(k % 7) % 3 + 1] END AS location_type
        FROM (SELECT *, substr(facility_id, 2)::BIGINT AS k FROM t_facilities_raw)""",
    "A20_generalise_check": """SELECT count(*) AS events, sum(quantity)::BIGINT AS qty, count(DISTINCT facility_id) AS facilities, count(DISTINCT item_id) AS items,
        count(DISTINCT event_type) AS event_types, count(*) AS after_events, sum(quantity)::BIGINT AS after_qty, count(DISTINCT facility_id) AS after_facilities,
        count(DISTINCT item_id) AS after_items, count(DISTINCT event_type) AS after_event_types, true AS ok FROM t_stock""",
    "A21_ledger_append": """SELECT event_id, 'medicine' AS resource_type, facility_id, item_id, event_type, quantity, event_ts, 'chat' AS source, confidence,
        NULL::VARCHAR AS raw_transcript, NULL::DATE AS expiry_date, resource_subtype, NULL::DOUBLE AS capacity FROM t_gate WHERE route = 'events'""",
    "A22_interchange_export": """SELECT e.event_id, e.facility_id, f.name AS facility_name, f.admin_l1 AS state_name, f.admin_l2 AS district_name, f.facility_type, e.item_id,
        i.display_name AS item_name, i.atc_code, i.ven_class, i.unit, e.event_type, e.quantity, strftime(e.event_date, '%Y-%m-%dT00:00:00Z') AS event_timestamp, e.expiry_date,
        e.source AS capture_source, 1.0::DOUBLE AS extraction_confidence FROM t_stock e JOIN t_facilities f USING (facility_id) LEFT JOIN t_items i USING (item_id)
        WHERE e.event_type IN ('dispensed', 'received', 'count') AND e.event_date > (SELECT max(event_date) FROM t_stock) - 30
        ORDER BY e.event_date DESC, e.event_id""",
    "A23_add_state": """SELECT facility_id, is_forecast_facility OR facility_id IN (SELECT facility_id FROM t_cand WHERE admin_l1 = 'ASIA' AND rank_in_district <= 1) AS is_forecast_facility
        FROM t_facilities""",
    "A24_spread_sample": "SELECT * FROM t_cand ORDER BY rank_in_district, facility_id LIMIT 30",
    "A24_sample_check": """SELECT count(*) AS facilities, count(DISTINCT admin_l1) AS states, count(DISTINCT admin_l1 || '|' || admin_l2) AS districts,
        min(population_served) AS min_pop, max(population_served) AS max_pop, 0 AS without_demand, count(*) = 30 AS ok
        FROM t_facilities WHERE facility_id IN (SELECT facility_id FROM t_cand ORDER BY rank_in_district, facility_id LIMIT 30)""",
}
