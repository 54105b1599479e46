"""Registration of the queries, one table per group of operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from .domain import MIN_DAYS, SURGE, Domain
from .functions.months import CALENDAR, FISCAL
from .functions.num import rnd
from .operators import forecast, ingest, match, plan, quality, resources, scope, score, seasonal, stock, surge, transfers
from .registry import add_all
from .sources import rawforms as rf
from .sources import testbed as tb
from .sources.wide import read_columns
from .streaming import replay

# -- stock position and demand -------------------------------------------------------------

add_all({
    "D1_as_of_date": lambda d: d.store.last_day("medicine"),
    "D2_consumed": lambda d: stock.consumed(d.ledger),
    "D3_current_stock": lambda d: d.live_stock,
    "D4_stock_reconcile": lambda d: stock.stock_reconcile(d.ledger, d.stock),
    "D5_stock_verify": lambda d: stock.stock_verify(d.stock),
    "D6_recorded_balance": lambda d: stock.recorded_balance(
        d.ledger, d.captures.filter("resource_type = 'medicine'")),
    "D7_health_mix": lambda d: stock.health_mix(
        stock.health_cover(d.forecast, d.ledger, d.facilities, d.items)),
    "D7_health_shortages": lambda d: stock.health_shortages(
        stock.health_cover(d.forecast, d.ledger, d.facilities, d.items)),
    "D8_training_set": lambda d: plan.training_set(d.ledger, d.facilities, MIN_DAYS),
    "D8_training_preflight": lambda d: plan.training_preflight(d.training),
    "D9_weekday_forecast": lambda d: plan.weekday_forecast(d.training),
    "D11_demand_baseline": lambda d: plan.demand_baseline(d.forecast, d.ledger),
    "D12_reorder_status": lambda d: plan.reorder_status(d.baseline, d.facilities, d.items, d.stock),
    "D13_reorder_summary": lambda d: plan.reorder_summary(d.reorder),
    "D14_lead_time": lambda d: plan.lead_time(d.register),
    "D14_lead_time_verify": lambda d: plan.lead_time_verify(d.facilities),
    "D15_lead_time_contrast": lambda d: plan.lead_time_contrast(d.reorder),
    "D16_forecast_series": lambda d: plan.forecast_series(
        d.ledger, d.forecast, plan.pick_series(d.ledger, d.facilities, d.items)),
    "D17_pick_series": lambda d: plan.pick_series(d.ledger, d.facilities, d.items),
    "D18_threshold_alert": lambda d: plan.threshold_alert(d.reorder),
})

# -- redistribution and access -------------------------------------------------------------

add_all({
    "D19_model_chain": lambda d: plan.model_chain(d.forecast, d.reorder, d.recs),
    "E1_recommendations": lambda d: transfers.recommendations(d.reorder, d.stock, d.facilities),
    "E2_batch_risk": lambda d: transfers.batch_risk(d.stock, d.reorder),
    "E3_fefo_batch_choice": lambda d: transfers.fefo_batch(transfers.batch_risk(d.stock, d.reorder)),
    "E4_transfer_effects": lambda d: transfers.transfer_effects(d.recs),
    "E5_substitutes": lambda d: transfers.substitutes(d.reorder),
    "E5_best_substitutes": lambda d: transfers.best_substitutes(transfers.substitutes(d.reorder)),
    "E6_substitution_constraint": lambda d: transfers.substitution_constraint(d.reorder),
    "E7_donor_safety_check": lambda d: transfers.donor_safety_check(d.recs),
    "E8_score_redistribution": lambda d: transfers.score_redistribution(
        d.reorder.select("facility_id", "item_id", "on_hand", "avg_daily_demand")
         .withColumnRenamed("avg_daily_demand", "daily_demand"),
        transfers.places(d.facilities), 14, 150.0),
    "E9_nearest_help": lambda d: transfers.nearest_help(d.reorder, d.facilities),
    "E10_access_summary": lambda d: transfers.access_summary(d.access),
    "E11_triage": lambda d: transfers.triage(d.reorder, d.recs),
    "E11_triage_summary": lambda d: transfers.triage_summary(transfers.triage(d.reorder, d.recs)),
    "E12_transfer_lifecycle": lambda d: transfers.apply_requests(d.requests),
    "E12_rejected_requests": lambda d: transfers.rejected_requests(
        d.requests, transfers.apply_requests(d.requests)),
    "E13_transfer_pending": lambda d: transfers.transfer_pending(transfers.apply_requests(d.requests)),
    "E14_movement_reconcile": lambda d: transfers.movement_reconcile(
        d.requests.filter("step IN ('dispatched', 'received')")
         .select(transfers.movement_id("step").alias("event_id")),
        transfers.apply_requests(d.requests)),
    "E15_alerts": lambda d: transfers.alerts(d.reorder),
    "E16_recommendation_list": lambda d: transfers.recommendation_list(d.recs),
})

# -- seasonal exchange ---------------------------------------------------------------------

_six = lambda df: df.withColumn("profile_distance", rnd("profile_distance", 6))

add_all({
    "G1_district_profiles": lambda d: seasonal.district_profiles(d.facilities, d.demand),
    "G2_pattern_vectors": lambda d: seasonal.pattern_vectors(d.demand, d.items),
    "G3_district_matches": lambda d: _six(seasonal.district_matches(d.profiles)),
    "G4_district_matches_same_state": lambda d: _six(seasonal.district_matches(d.profiles, True)),
    "G5_exchange_eval": lambda d: seasonal.exchange_eval(d.vectors, d.matches_out, d.matches_in)
        .withColumns({f"{a}_abs_error": rnd(f"{a}_abs_error", 4) for a in seasonal.ARMS}),
    "G6_exchange_wmape": lambda d: seasonal.exchange_wmape(d.exchange),
    "G7_published_vector": lambda d: seasonal.spread(
        seasonal.published_vector(d.vectors), "monthly_multipliers", FISCAL),
    "G8_thin_history_pick": lambda d: seasonal.thin_history_pick(d.exchange, 100.0),
    "G9_local_patterns": lambda d: seasonal.spread(
        seasonal.local_patterns(d.demand, d.items), "monthly_coefficients", CALENDAR),
    "G10_class_units": lambda d: seasonal.class_units(d.items),
    "G11_outlook_curve": lambda d: seasonal.outlook_curve(d.exchange, seasonal.class_units(d.items)),
    "G11_outlook_accuracy": lambda d: seasonal.outlook_accuracy(d.exchange),
    "G11_outlook_classes": lambda d: seasonal.outlook_classes(d.exchange, seasonal.class_units(d.items)),
    "G11_outlook_donors": lambda d: seasonal.outlook_donors(d.exchange),
    "G12_outlook_reliability": lambda d: seasonal.outlook_reliability(
        seasonal.outlook_curve(d.exchange, seasonal.class_units(d.items)),
        seasonal.outlook_accuracy(d.exchange)),
    "G13_peer_vector_store": lambda d: seasonal.spread(
        seasonal.peer_vector_store(d.published), "monthly_coefficients", FISCAL),
})

# -- surge ---------------------------------------------------------------------------------

_scenario = lambda d: surge.scenario_transfers(d.reorder, d.facilities, 3.0)

add_all({
    "H1_surge_signals": lambda d: surge.surge_signals(d.vectors, **SURGE),
    "H2_surge_summary": lambda d: surge.surge_summary(d.signals),
    "H3_surge_by_class": lambda d: surge.surge_by_class(d.signals),
    "H3_top_surges": lambda d: surge.top_surges(d.signals, d.reorder),
    "H4_signal_labels": lambda d: surge.signal_labels(d.items, d.signal_classes),
    "H5_lead_measure": lambda d: surge.lead_measure(d.demand, "1-URGENT", "3-MEDIUM"),
    "H6_signals_by_class_kind": lambda d: surge.signals_by_class_kind(d.signals, d.labels),
    "H7_surge_cards": lambda d: surge.surge_cards(d.signals, d.labels),
    "H8_surge_supply_impact": lambda d: surge.surge_supply_impact(d.reorder, d.signals),
    "H8_surge_impact_list": lambda d: surge.surge_impact_list(d.impact),
    "H9_network_absorption": lambda d: surge.network_absorption(d.reorder),
    "H10_surge_recommendations": lambda d: surge.surge_recommendations(
        d.impact, d.reorder, d.stock, d.facilities),
    "H11_lead_time_bands": lambda d: surge.lead_time_bands(d.impact),
    "H12_absorption_by_multiplier": lambda d: surge.absorption_by_multiplier(d.absorption),
    "H12_claims_by_ven": lambda d: surge.claims_by_ven(d.surge_recs),
    "H13_scenario_facilities": lambda d: surge.scenario_facilities(d.reorder, 3.0),
    "H13_scenario_transfers": _scenario,
    "H13_scenario_verdict": lambda d: surge.scenario_verdict(
        surge.scenario_facilities(d.reorder, 3.0), _scenario(d), 3.0),
    "H14_scenario_options": lambda d: surge.scenario_options(d.reorder),
    "H15_surge_month": lambda d: surge.surge_month(d.stock),
    "H15_surge_transfers": lambda d: surge.surge_transfers(d.surge_recs, surge.surge_month(d.stock)),
    "H16_early_warning_count": lambda d: surge.early_warning_count(
        surge.surge_cards(d.signals, d.labels)),
})

# -- beds and staff ------------------------------------------------------------------------

_season = lambda d: quality.demand_seasonality(d.demand)
_load = lambda d: quality.demand_scale(d.demand, d.facilities, "ASIA")

add_all({
    "B6_bed_norm": lambda d: resources.bed_norm(plan.lead_time(d.register)),
    "I1_bed_status": lambda d: resources.bed_status(d.captures, d.facilities),
    "I2_bed_referrals": lambda d: resources.bed_referrals(d.beds),
    "I3_bed_summary": lambda d: resources.bed_summary(d.beds),
    "I3_bed_list": lambda d: resources.bed_list(d.beds),
    "I4_facility_staffing": lambda d: resources.facility_staffing(d.staffing, d.facilities),
    "I5_staffing_norm_gap": lambda d: resources.staffing_norm_gap(d.posts),
    "I6_staff_status": lambda d: resources.staff_status(d.posts, d.facilities),
    "I7_staff_summary": lambda d: resources.staff_summary(d.staff),
    "I7_staff_by_cadre": lambda d: resources.staff_by_cadre(d.staff),
    "I7_staff_list": lambda d: resources.staff_list(d.staff),
    "I8_staff_reallocation_diag": lambda d: resources.staff_reallocation_diag(d.staff),
    "I9_resource_coverage": lambda d: resources.resource_coverage(d.resource_events, d.staff),
    "I10_leaked_column_check": lambda d: resources.leaked_column_check(d.staff),
    "I11_bed_demand": lambda d: resources.bed_demand(
        _load(d).filter("indicator = '2-HIGH'").select("state", "district_key", F.col("per_phc").alias("admissions")),
        _season(d).filter("indicator = '2-HIGH'").drop("indicator"), d.facilities, 0.5),
})

# -- reporting, capture and quality --------------------------------------------------------

_gate = lambda d: quality.capture_gate(quality.verify_item(quality.parse_reply(d.replies), d.items))
_counts = lambda d: d.captures.filter("resource_type = 'medicine'")
_reporting = lambda d: quality.facility_reporting(_counts(d), d.facilities, period_days=2)


def _score(d: Domain):
    rows = d.gate.withColumn("case_id", F.col("report_id"))
    events = rows.filter("route = 'events'")
    off = F.pmod(F.substring("report_id", 2, 20).cast("bigint"), F.lit(5)) == 0
    want = events.select("case_id", "item_id", F.when(F.col("event_type") == "count", "received")
                         .otherwise(F.col("event_type")).alias("event_type"),
                         (F.col("quantity") + F.when(off, 1).otherwise(0)).alias("quantity"))
    accept = (events.filter("event_type = 'count'").select("case_id", "item_id", "event_type").distinct()
              .withColumn("stands_for", F.lit("received")))
    review = rows.filter("route = 'review'").select("case_id", "item_id")
    asked = rows.filter("route = 'requests'").select("case_id", "item_id")
    return quality.extraction_score(rows, want, review, asked, accept)


def _approvals(d: Domain):
    return quality.review_approve(d.gate.filter("route = 'review'"), tb.approvals(d.spark, d.sf_dir))


def _parts(d: Domain):
    parts = tb.impact_parts(d.ledger, d.facilities)
    again = parts.filter("part = 'ASIA'").withColumns({c: F.col(c) * 2 for c in (
        "units_dispensed", "units_unmet", "units_expired_fefo", "units_expired_fifo")})
    return quality.impact_metrics(parts, again)


add_all({
    "J1_facility_reporting": _reporting,
    "J1_reporting_summary": lambda d: quality.reporting_summary(_reporting(d)),
    "J2_capture_gate": lambda d: _gate(d).select(
        "event_id", "report_id", "item_id", "matched_by", "event_type", "quantity", "confidence",
        "resource_subtype", "review_reason", "route"),
    "J3_loss_reason": lambda d: d.gate.filter("event_type = 'lost' AND route <> 'errors'")
        .groupBy("resource_subtype").agg(F.count("*").alias("n")),
    "J3_loss_reason_rows": lambda d: d.gate.filter("event_type = 'lost' AND route <> 'errors'")
        .select("event_id", "resource_subtype"),
    "J4_overdraw_hold": lambda d: quality.overdraw_hold(
        d.gate.filter("route = 'events'"), stock.ledger_balance(d.ledger))
        .select("event_id", "report_id", "facility_id", "item_id", "event_type", "quantity", "held", "on_record"),
    "J5_review_approve": _approvals,
    "J5_pending_review": lambda d: quality.pending_review(d.gate.filter("route = 'review'"), _approvals(d))
        .select("event_id", "facility_id", "item_id", "review_reason"),
    "J6_confirm_rows": lambda d: quality.confirm_rows(
        quality.verify_item(quality.parse_reply(d.replies), d.items))
        .groupBy("route", F.coalesce("review_reason", F.lit("")).alias("why")).agg(F.count("*").alias("n")),
    "J6_confirmed_rows": lambda d: quality.confirm_rows(
        quality.verify_item(quality.parse_reply(d.replies), d.items))
        .select("event_id", "route", F.coalesce("review_reason", F.lit("")).alias("why")),
    "J7_captures": lambda d: quality.captures(d.ledger),
    "J8_reported_today": lambda d: quality.reported_today(d.captures, "personnel", d.staff),
    "J8_reported_latest": lambda d: quality.reported_latest(d.captures, "personnel", d.staff),
    "J9_data_quality": lambda d: quality.data_quality(d.facilities, d.items),
    "J10_geo_summary": lambda d: quality.geo_summary(d.facilities),
    "J11_list_states": lambda d: quality.list_states(quality.geo_summary(d.facilities)),
    "J11_list_districts": lambda d: quality.list_districts(
        quality.geo_summary(d.facilities), display={("ASIA", "NATION_2"): "Nation Two"}),
    "J11_facility_counts": lambda d: quality.facility_counts(quality.geo_summary(d.facilities)),
    "J11_national_summary": lambda d: quality.national_summary(quality.geo_summary(d.facilities)),
    "J11_scope_facilities": lambda d: quality.scope_facilities(d.facilities),
    "J11_get_facility": lambda d: quality.get_facility(d.facilities, "F3").select("facility_id", "name", "admin_l1", "admin_l2"),
    "J12_population_reach": lambda d: quality.population_reach(d.facilities, d.demand),
    "J12_reach_check": lambda d: quality.reach_check(d.facilities),
    "J13_priced_expiry": lambda d: quality.priced_expiry(d.ledger, d.items, tb.prices(d.items)),
    "J13_waste_value": lambda d: quality.waste_value(
        quality.priced_expiry(d.ledger, d.items, tb.prices(d.items))),
    "J14_impact_parts": _parts,
    "J15_issue_policy_replay": lambda d: quality.issue_policy_replay(d.ledger),
    "J16_reach_read": lambda d: quality.population_reach(d.facilities, d.demand).orderBy("tier_order"),
    "J16_reporting_read": lambda d: quality.reporting_read(_reporting(d)),
    "J17_demand_seasonality": lambda d: _season(d).withColumn("multiplier", rnd("multiplier", 6)),
    "J18_demand_scale": lambda d: _load(d).withColumn("per_phc", rnd("per_phc", 6)),
    "J19_number_check": lambda d: quality.number_check(tb.notes(d.spark, d.sf_dir)),
    "J20_code_lookup": lambda d: quality.code_lookup(
        tb.teachings(d.spark, d.sf_dir), tb.scans(d.spark, d.sf_dir), d.items),
    "J21_sms_parse": lambda d: quality.sms_parse(tb.sms(d.spark, d.sf_dir)),
    "J22_extraction_score": _score,
    "J22_score_rate": lambda d: quality.score_rate(_score(d)),
})

# -- scorecards and map --------------------------------------------------------------------

_flows = lambda d: score.map_flows(d.facilities, d.recs)
_nodes = lambda d: score.map_districts(d.facilities, d.reorder, d.absorption)

add_all({
    "M1_scorecard": lambda d: score.scorecard(d.reorder),
    "M2_stockout_timeline": lambda d: score.stockout_timeline(d.reorder),
    "M3_worst_medicines": lambda d: score.worst_medicines(d.reorder),
    "M4_ven_breakdown": lambda d: score.ven_breakdown(d.reorder),
    "M5_district_quadrant": lambda d: score.district_quadrant(d.reorder, d.absorption),
    "M6_absorption_share": lambda d: score.absorption_share(d.absorption),
    "M6_queue": lambda d: score.queue(d.impact, d.recs),
    "M7_grades": lambda d: score.grades(score.scorecard(d.reorder), d.absorption),
    "M8_bed_scorecard": lambda d: score.bed_scorecard(d.beds),
    "M8_bed_distribution": lambda d: score.bed_distribution(d.beds),
    "M8_bed_ranking": lambda d: score.bed_ranking(d.beds),
    "M8_bed_quadrant": lambda d: score.bed_quadrant(d.beds),
    "M8_bed_breakdown": lambda d: score.bed_breakdown(d.beds),
    "M9_staff_scorecard": lambda d: score.staff_scorecard(d.staff),
    "M9_staff_distribution": lambda d: score.staff_distribution(d.staff),
    "M9_staff_ranking": lambda d: score.staff_ranking(d.staff),
    "M9_staff_quadrant": lambda d: score.staff_quadrant(d.staff),
    "M9_staff_breakdown": lambda d: score.staff_breakdown(d.staff),
    "M10_reporting_geography": lambda d: score.flat_geography(score.reporting_geography(d.reorder)),
    "M10_geography_levels": lambda d: score.reporting_geography(d.reorder),
    "M10_geography_totals": lambda d: score.geography_totals(score.reporting_geography(d.reorder)),
    "M11_medicine_comparison": lambda d: score.medicine_comparison(d.reorder),
    "M12_lead_time_structure": lambda d: score.lead_time_structure(d.reorder),
    "M12_lead_time_correlation": lambda d: score.lead_time_correlation(d.reorder),
    "B5_declared_columns": lambda d: read_columns(
        d.spark, f"{d.sf_dir}/customer.parquet", ["c_custkey", "c_nationkey", "c_mktsegment"], wide=5),
    "B1_scope_alerts": lambda d: transfers.alerts(scope.in_scope(d.reorder, "ASIA", "NATION_7")).select(
        "facility_id", "item_id", "priority_score", "status"),
    "B2_scope_absorption": lambda d: scope.in_scope(
        d.absorption, "EUROPE", facility="F1", columns=scope.AREA_ONLY).select(
        "state", "district", "atc_class", "multiplier", "absorbs"),
    "B3_scope_vital_moves": lambda d: scope.in_scope(
        d.recs, "AMERICA", vital_only=True, columns=scope.RECEIVER).select(
        "recommendation_id", "to_state", "quantity"),
    "M13_bed_comparison": lambda d: score.bed_comparison(d.beds),
    "M13_staff_comparison": lambda d: score.staff_comparison(d.staff),
    "M13_staff_cadres": lambda d: score.staff_comparison(d.staff, "ASIA"),
    "M14_league_finish": lambda d: score.league_finish(score.medicine_comparison(d.reorder)),
    "M14_league_ends": lambda d: score.league_ends(score.medicine_comparison(d.reorder)),
    "M15_map_districts": _nodes,
    "M15_map_flows": _flows,
    "M15_map_summary": lambda d: score.map_summary(_nodes(d), _flows(d)),
    "M16_facility_points": lambda d: score.facility_points(d.facilities),
    "M16_facility_point_counts": lambda d: score.facility_point_counts(d.facilities),
    "M17_dashboard_stats": lambda d: score.dashboard_stats(
        plan.reorder_summary(d.reorder), transfers.transfer_effects(d.recs),
        quality.facility_counts(quality.geo_summary(d.facilities)), quality.captures(d.ledger)),
})

# -- loading -------------------------------------------------------------------------------

def _loaded(d: Domain):
    return ingest.load_facilities(rf.register_rows(d.spark, d.sf_dir),
                                  ingest.population_lookup(rf.population_wide(d.spark, d.sf_dir)), ("ASIA", "EUROPE"))


def _melted(d: Domain):
    return ingest.melt_demand(rf.demand_wide(d.spark, d.sf_dir), rf.code_drivers(d.spark))


def _replaced(d: Domain):
    asia = F.col("admin_l1") == "ASIA"
    return ingest.replace_slice(d.demand, d.demand.filter(asia).withColumn("value", F.col("value") * 2), asia)


_parsed = lambda d: rf.parsed_medicines(d.spark, d.sf_dir)
_merged = lambda d: ingest.merge_catalogue(_parsed(d))
_count = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n"))


add_all({
    "A1_load_facilities": _loaded,
    "A2_population_lookup": lambda d: ingest.population_lookup(rf.population_wide(d.spark, d.sf_dir)),
    "A3_replace_slice": lambda d: _replaced(d).groupBy("admin_l1").agg(
        F.count("*").alias("n"), F.sum("value").alias("value")),
    "A3_slice_guard": lambda d: ingest.slice_guard(d.demand, _replaced(d), F.col("admin_l1") == "ASIA", "value"),
    "A4_load_verify": lambda d: ingest.load_verify(_loaded(d), d.read("supplier")),
    "A5_melt_demand": _melted,
    "A6_district_key": lambda d: _count(rf.messy_districts(d.spark, d.sf_dir).select(
        ingest.district_key("district").alias("district_key")), "district_key"),
    "A6_district_key_rows": lambda d: rf.messy_districts(d.spark, d.sf_dir).select(
        "c_custkey", ingest.district_key("district").alias("district_key")),
    "A7_completeness_gate": lambda d: ingest.completeness_gate(_melted(d), 5),
    "A7_absent_codes": lambda d: ingest.absent_codes(rf.demand_wide(d.spark, d.sf_dir), rf.code_drivers(d.spark)),
    "A8_merge_catalogue": _merged,
    "A9_infer_unit": lambda d: _count(_parsed(d).select(ingest.infer_unit("dosage_forms").alias("unit")), "unit"),
    "A9_infer_unit_rows": lambda d: _parsed(d).select("ord", ingest.infer_unit("dosage_forms").alias("unit")),
    "A10_classify_ven_rows": lambda d: _parsed(d).select("ord", ingest.classify_ven(
        "medicine", "section_no", ("red widget", "blue bolt"), ("small ring",)).alias("ven_class")),
    "A10_classify_ven": lambda d: _count(_parsed(d).select(ingest.classify_ven(
        "medicine", "section_no", ("red widget", "blue bolt"), ("small ring",)).alias("ven_class")), "ven_class"),
    "A11_item_id_full": lambda d: ingest.with_item_id(_merged(d)).select("ord", "medicine", "item_id"),
    "A11_item_id": lambda d: ingest.with_item_id(_merged(d), length=8).select("ord", "medicine", "item_id"),
    "A12_code_lookup": lambda d: ingest.lookup_code(_merged(d), rf.medicine_codes(d.spark)).select(
        "ord", "medicine", "atc_code"),
    "A13_curation_check": lambda d: ingest.curation_check(
        d.items, rf.curated_items(d.items), d.demand.select("indicator").distinct()),
    "A14_load_staffing": lambda d: ingest.load_staffing(
        rf.staffing_rows(d.staffing), rf.staffing_files(d.spark), 2022)
        .withColumn("n_types", F.size("applies_to_facility_types")).drop("applies_to_facility_types"),
    "A15_staffing_self_check": lambda d: ingest.staffing_self_check(rf.staffing_rows(d.staffing)),
    "A16_price_rows": lambda d: ingest.price_rows(rf.price_lines(d.spark, d.sf_dir)),
    "A17_choose_price": lambda d: ingest.choose_price(
        ingest.price_rows(rf.price_lines(d.spark, d.sf_dir)), rf.priced_items(d.spark, d.sf_dir)),
    "A18_second_country": lambda d: ingest.load_second_country(
        rf.establishments(d.spark, d.sf_dir), rf.coordinates(d.spark, d.sf_dir),
        rf.municipalities(d.spark, d.sf_dir), demo=("NATION_3",)),
    "A19_backfill_column": lambda d: ingest.backfill_column(
        d.register, rf.location_staging(d.spark, d.sf_dir), "facility_id", "location_type",
        ("rural", "urban")).select("facility_id", "location_type"),
    "A20_generalise_check": lambda d: ingest.generalise_check(d.ledger, ingest.generalise_ledger(d.ledger)),
    "A21_ledger_append": lambda d: quality.to_ledger(d.gate.filter("route = 'events'")),
    "A22_interchange_export": lambda d: ingest.interchange_export(d.ledger, d.facilities, d.items),
    "A23_add_state": lambda d: ingest.add_state(d.facilities, d.demand, "ASIA").select(
        "facility_id", "is_forecast_facility"),
    "A24_spread_sample": lambda d: ingest.spread_sample(d.facilities, d.demand, 30),
    "A24_sample_check": lambda d: ingest.sample_check(
        ingest.spread_sample(d.facilities, d.demand, 30), d.facilities, d.demand, 30),
})

# -- matching and models -------------------------------------------------------------------

add_all({
    "L1_match_items": lambda d: match.match_items(tb.utterances(d.spark, d.sf_dir), tb.catalogue(d.items)),
    "L1_contained_names": lambda d: match.contained_names(tb.utterances(d.spark, d.sf_dir), tb.catalogue(d.items)),
    "L2_match_vocabulary": lambda d: d.read("conversations").select(
        "conv_id", "turn", match.match_vocabulary("text", match.BED_WORDS).alias("bed"),
        match.match_vocabulary("text", match.STAFF_WORDS).alias("staff")),
    "L3_verify_item_id": lambda d: match.verify_item(quality.parse_reply(d.replies), d.items).select(
        "event_id", "matched_id", "matched_by"),
    "L4_quick_list": lambda d: match.quick_list(tb.catalogue(d.items)),
    "D9_fit_forecast": lambda d: forecast.forecast_rows(forecast.fit_models(d.training)),
    "D9_model_terms": lambda d: forecast.model_terms(d.models),
    "D10_model_evaluate": lambda d: forecast.model_evaluate(d.models),
    "D10_model_orders": lambda d: forecast.model_orders(d.models),
})

# -- streams -------------------------------------------------------------------------------

add_all({
    "K1_ingest_ledger": lambda d: replay.captures_to_ledger(d, "ledger"),
    "K1_ingest_review": lambda d: replay.captures_to_ledger(d, "review"),
    "K2_movements_once": replay.movements,
    "K3_overdraw_hold": replay.overdraws,
    "K4_transfer_machine": replay.transfers,
    "K5_rolling_reports": replay.rolling,
    "K6_reporting_periods": replay.periods,
    "K7_live_positions": replay.positions,
    "K7_live_alerts": replay.alerts,
})
