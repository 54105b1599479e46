"""End state of the streams as SQL over the same rows."""
SQL = {
    "K1_ingest_ledger": """SELECT event_id, 'medicine' AS resource_type, facility_id, item_id, event_type, quantity, event_ts, 'chat' AS source, confidence,
        NULL::VARCHAR AS raw_transcript, NULL::DATE AS expiry_date, resource_subtype, NULL::DOUBLE AS capacity FROM t_gate WHERE route = 'events'""",
    "K1_ingest_review": """SELECT event_id, facility_id, item_id, event_type, quantity, confidence, review_reason, 'pending' AS status FROM t_gate WHERE route = 'review'""",
    "K2_movements_once": "SELECT DISTINCT recommendation_id || ':' || step AS event_id FROM t_requests WHERE step IN ('dispatched', 'received')",
    "K3_overdraw_hold": "SELECT event_id, facility_id, item_id, event_type, quantity, held, on_record FROM t_held",
    "K4_transfer_machine": "SELECT * FROM t_log",
    "K5_rolling_reports": """SELECT time_bucket(INTERVAL 1 HOUR, event_ts) - h * INTERVAL 1 HOUR AS window_start, resource_type, count(*) AS reports
        FROM t_captures, range(0, 24) r(h) GROUP BY ALL""",
    "K6_reporting_periods": """SELECT make_timestamp((epoch_us(event_ts) // 172800000000) * 172800000000) AS window_start, facility_id, count(*) AS reports
        FROM t_captures WHERE event_type = 'count' GROUP BY ALL""",
    "K7_live_alerts": """SELECT facility_id, item_id, on_hand, days_of_cover, needs_reorder, status FROM t_reorder
        WHERE (facility_id, item_id) IN (SELECT (facility_id, item_id) FROM t_stock)""",
    "K7_live_positions": "SELECT facility_id, item_id, on_hand, days_of_cover, needs_reorder, status FROM t_reorder",
}
