"""Shared named sub-queries for the check SQL, and the composer that chains them."""
from __future__ import annotations

import re

from ..sources import testbed as tb

_VIEWS: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    _VIEWS[name] = sql.strip()


def views() -> dict[str, str]:
    return dict(_VIEWS)


def rnd(x: str, digits: int = 0) -> str:
    k = f"{10 ** digits}.0"
    return f"(sign({x}) * floor(abs({x}) * {k}::DOUBLE + 0.5::DOUBLE) / {k}::DOUBLE)"


def tolong(x: str) -> str:
    return f"({rnd(x)})::BIGINT"


def div(x: str, y: str) -> str:
    return f"(({x})::DOUBLE / nullif(({y})::DOUBLE, 0))"


def pct(x: str, y: str, digits: int = 1) -> str:
    return rnd(f"(100.0::DOUBLE * {div(x, y)})", digits)


def km(a: str, b: str, c: str, d: str) -> str:
    return (f"(12742.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({c} - {a}) / 2), 2.0)"
            f" + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2.0)))))")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def compose(body: str) -> str:
    """Prefix a body with every named sub-query it uses, directly or not."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in _VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    body = body.strip()
    if not needed:
        return body
    named = ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in needed)
    if body.upper().startswith("WITH"):
        return f"WITH {named},\n{body[4:].lstrip()}"
    return f"WITH {named}\n{body}"


register("t_facilities_raw", """
SELECT 'F' || s_suppkey AS facility_id, 'IN' AS country_code, s_name AS name,
  r_name AS admin_l1, n_name AS admin_l2,
  CASE s_suppkey % 10 WHEN 0 THEN 'dis_h' WHEN 1 THEN 's_t_h' WHEN 2 THEN 'chc'
    WHEN 3 THEN 'chc' WHEN 4 THEN 'sub_cen' ELSE 'phc' END AS facility_type,
  CASE WHEN s_suppkey % 12 = 3 THEN NULL WHEN s_suppkey % 4 = 0 THEN 'urban'
    ELSE 'rural' END AS location_type,
  CASE WHEN s_suppkey % 41 = 7 THEN NULL WHEN s_suppkey % 37 = 11 THEN 92.41::DOUBLE
    ELSE (800 + (n_nationkey % 5) * 150 + (s_suppkey * 37) % 200)::DOUBLE / 100.0::DOUBLE END AS latitude,
  (7000 + (n_nationkey // 5) * 150 + (s_suppkey * 53) % 200)::DOUBLE / 100.0::DOUBLE AS longitude,
  CASE WHEN s_suppkey % 29 <> 5 THEN (5000 + (s_suppkey * 7919) % 45000)::BIGINT END AS population_served,
  s_suppkey % 6 = 0 AS is_demo_facility, s_suppkey % 7 <> 3 AS is_forecast_facility
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")

register("t_items", f"""
SELECT p_brand AS item_id,
  CASE WHEN n <> 13 THEN 'A0' || (n % 5) || 'AB' || lpad(n::VARCHAR, 2, '0') END AS atc_code,
  {_list(tb.FIRST)}[n % 5 + 1] || ' ' || {_list(tb.SECOND)}[(n // 5) % 5 + 1] AS display_name,
  {_list(tb.UNITS)}[n % 4 + 1] AS unit, {_list(tb.VEN)}[n % 3 + 1] AS ven_class,
  CASE WHEN n <> 24 THEN {_list(tb.DRIVERS)}[(n + n // 21) % 5 + 1] END AS demand_driver,
  (1.0 + (n % 4) * 0.5)::DOUBLE AS units_per_driver_event, n % 8 <> 0 AS is_forecast_item, list_price
FROM (SELECT p_brand, split_part(p_brand, '#', 2)::BIGINT AS n, min(p_retailprice) AS list_price
      FROM part GROUP BY p_brand)
""")

register("t_stock", f"""
SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::BIGINT,
    floor(l_extendedprice * 100 + 0.5::DOUBLE)::BIGINT, floor(l_discount * 100 + 0.5::DOUBLE)::BIGINT,
    floor(l_tax * 100 + 0.5::DOUBLE)::BIGINT, l_returnflag, l_linestatus, l_shipdate::DATE)) AS event_id,
  'medicine' AS resource_type, 'F' || l_suppkey AS facility_id, p_brand AS item_id,
  CASE WHEN l_returnflag = 'N' THEN 'received' WHEN l_returnflag = 'R' THEN 'dispensed'
    WHEN l_linenumber IN (2, 6) THEN 'dispatched' WHEN l_linenumber = 4 THEN 'lost' ELSE 'expired' END AS event_type,
  (CASE WHEN l_returnflag = 'N' THEN 3 ELSE 1 END) * l_quantity::BIGINT AS quantity,
  DATE '2024-01-01' + ((l_shipdate::DATE - DATE '1995-01-01') % 365)::INTEGER AS event_date,
  CASE WHEN l_orderkey % 10 < 7 THEN 'seed' ELSE {_list(tb.CAPTURE_BY_DIGIT)}[l_orderkey % 10 - 6] END AS source,
  CASE WHEN l_returnflag = 'N' AND l_linenumber <> 7 THEN
    DATE '2024-01-01' + ((l_shipdate::DATE - DATE '1995-01-01') % 365 + 60 + (l_partkey * 7) % 600)::INTEGER END AS expiry_date
FROM lineitem JOIN part ON l_partkey = p_partkey
""")

register("t_captures", f"""
SELECT 'E' || event_id AS event_id,
  CASE WHEN event_type IN ('view', 'error', 'purchase') THEN 'bed' WHEN event_type = 'signup' THEN 'personnel'
    ELSE 'medicine' END AS resource_type,
  'F' || user_id AS facility_id,
  CASE WHEN event_type IN ('view', 'error', 'purchase') THEN 'BED-INPATIENT' WHEN event_type = 'signup' THEN 'STAFF-NURSE'
    ELSE 'Brand#' || (k % 25 + 1) END AS item_id,
  CASE event_type WHEN 'view' THEN 'occupancy' WHEN 'error' THEN 'turned_away' ELSE 'count' END AS event_type,
  (CASE WHEN event_type = 'error' THEN CASE WHEN k < 5 THEN k + 1 ELSE 0 END
    WHEN event_type = 'view' THEN least(floor(value)::BIGINT, 6) ELSE floor(value)::BIGINT END)::BIGINT AS quantity,
  ts AS event_ts, ts::DATE AS event_date, {_list(tb.CAPTURE_BY_DIGIT)}[k % 3 + 1] AS source,
  CASE WHEN event_type IN ('view', 'error') THEN (4 + user_id % 5)::DOUBLE END AS capacity
FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)
""")

register("t_demand", f"""
SELECT r_name AS admin_l1, n_name AS admin_l2, upper(trim(n_name)) AS district_key,
  {_list(tb.CALENDAR)}[m] AS month, indicator,
  (orders * CASE WHEN m = (n_nationkey * 5 + substr(indicator, 1, 1)::INTEGER) % 12 + 1 THEN 4 ELSE 1 END)::DOUBLE AS value
FROM (SELECT c_nationkey, month(o_orderdate) AS m, o_orderpriority AS indicator, count(*) AS orders
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")

_CADRE = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tb.CADRES.items()) + " END"
register("t_staffing", f"""
SELECT state, cadre, types, required, sanctioned, in_position, sanctioned - in_position AS vacant,
  {rnd(div('sanctioned - in_position', 'sanctioned'), 4)} AS vacancy_rate
FROM (
  SELECT r_name AS state, {_CADRE} AS cadre,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD') THEN ['phc'] ELSE ['phc', 'chc'] END AS types,
    count(*) + 5 AS required,
    CASE WHEN r_name = 'MIDDLE EAST' AND c_mktsegment = 'HOUSEHOLD' THEN 0 ELSE count(*) END AS sanctioned,
    CASE WHEN r_name = 'MIDDLE EAST' AND c_mktsegment = 'HOUSEHOLD' THEN 0
      WHEN r_name = 'ASIA' AND c_mktsegment = 'BUILDING' THEN count(*) + 9
      ELSE count(*) FILTER (c_acctbal > 2000) END AS in_position
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name, c_mktsegment)
""")
