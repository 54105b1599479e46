import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwell.domain import Domain
from ledgerwell.operators import forecast, plan, surge, transfers

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def d(spark):
    return Domain.of(spark, SF)


def test_reorder_formula_and_boundary(d):
    for r in d.reorder.limit(400).collect():
        lim = r.avg_daily_demand * r.lead_time_days + 1.65 * r.demand_std_dev * math.sqrt(r.lead_time_days)
        assert abs(r.reorder_point - lim) <= 0.051
        assert r.needs_reorder == (r.on_hand <= lim)
        if r.on_hand <= 0:
            assert r.status == "stocked_out"
        assert (r.status == "ok") == (not r.needs_reorder and not (r.days_of_cover or 1e9) < r.lead_time_days - 0.1) or r.status == "critical"


def test_vital_weighs_three_times_desirable(d):
    top = {r.ven_class: r.m for r in d.reorder.filter("on_hand <= 0").groupBy("ven_class").agg(F.max("priority_score").alias("m")).collect()}
    assert top == {"Vital": 3.0, "Essential": 2.0, "Desirable": 1.0}


def test_lead_time_is_clamped_and_not_constant(d):
    r = d.facilities.agg(F.min("lead_time_days").alias("a"), F.max("lead_time_days").alias("b")).first()
    assert 7 <= r.a < r.b <= 30


def test_transfers_keep_donors_safe_and_help_receivers(d):
    rows = d.recs.collect()
    assert rows and len({r.recommendation_id for r in rows}) == len(rows)
    for r in rows:
        assert r.donor_cover_after >= 0 and r.distance_km <= 150 and r.quantity >= 1
        assert r.receiver_cover_after > r.receiver_cover_before and r.fefo_days_to_expiry >= 37
    assert transfers.donor_safety_check(d.recs).first().negative_donor == 0


def test_triage_is_exclusive_and_exhaustive(d):
    rows = transfers.triage(d.reorder, d.recs)
    s = transfers.triage_summary(rows).first()
    assert s.total == s.transfer + s.order + s.escalate == d.reorder.filter("needs_reorder").count()
    assert rows.filter("has_transfer AND too_late_to_order").count() == 0


def test_substitutes_share_class_and_are_another_item(d):
    rows = transfers.substitutes(d.reorder)
    assert rows.filter("requested_item_id = alternative_item_id OR substr(alternative_atc_code, 1, 5) <> atc_class").count() == 0


@pytest.mark.parametrize("hand,want", [(100, 0), (500, 220), (1000, 280)])
def test_transfer_size(spark, hand, want):
    df = spark.createDataFrame([(0, 10.0, hand, 10.0)], "r int, rd double, d int, dd double")
    assert df.select(transfers.transfer_size("r", "rd", "d", "dd", 14.0).alias("q")).first().q == want


def test_best_donor_by_cover_left_per_km(spark):
    inv = spark.createDataFrame([("fac1", "M", 10, 10.0), ("fac2", "M", 1000, 10.0), ("fac3", "M", 1000, 10.0)],
                                "facility_id string, item_id string, on_hand long, daily_demand double")
    at = spark.createDataFrame([("fac1", 0.0, 0.0), ("fac2", 0.1, 0.0), ("fac3", 1.0, 0.0)], "facility_id string, latitude double, longitude double")
    rows = transfers.score_redistribution(inv, at, 14, 50.0).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.from_facility_id, r.to_facility_id, r.quantity, r.donor_post_cover, r.receiver_post_cover) == ("fac2", "fac1", 270, 73.0, 28.0)


def test_lifecycle_no_skip_no_reverse_no_repeat(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    steps = ["dispatched", "received", "approved", "received", "approved", "dispatched", "recommended", "dispatched", "received", "received"]
    req = spark.createDataFrame([("T", f"q{i}", t(i), s) for i, s in enumerate(steps)],
                                "recommendation_id string, request_id string, ts timestamp_ntz, step string")
    log = transfers.apply_requests(req)
    got = {r.fulfilment_status: (r.request_id, r.movement_event_id) for r in log.collect()}
    assert got == {"approved": ("q2", None), "dispatched": ("q5", "T:dispatched"), "received": ("q8", "T:received")}
    assert sum(r.rejected for r in transfers.rejected_requests(req, log).collect()) == 7
    p = transfers.transfer_pending(log).first()
    assert p.fulfilment_status == "received" and p.approved_at == t(2)


def test_unreachable_shortage_stays_visible(spark):
    rs = spark.createDataFrame([("A", "n", "s", "d", "M", "m", "u", "Vital", 0, 0.0, "stocked_out", True), ("B", "n", "s", "d", "Z", "z", "u", "Vital", 9, 9.0, "ok", False)],
                               "facility_id string, facility_name string, state string, district string, item_id string, item_name string, unit string, ven_class string, on_hand long, days_of_cover double, status string, needs_reorder boolean")
    fac = spark.createDataFrame([("A", 20.0, 75.0, 100, True), ("B", 20.1, 75.0, 50, True)], "facility_id string, latitude double, longitude double, population_served long, has_valid_coords boolean")
    cases = transfers.nearest_help(rs, fac)
    assert [(r.facility_id, r.km) for r in cases.collect()] == [("A", None)]
    assert transfers.access_summary(cases).first().unreachable == 1


# -- surge -------------------------------------------------------------------------------

def vectors(spark, values):
    months = ["April", "May", "June", "July", "August", "September", "October", "November", "December", "January", "February", "March"]
    rows = [("s", k, "C", m, float(v), 100.0, 11, 1.0) for k, vs in values.items() for m, v in zip(months, vs)]
    return spark.createDataFrame(rows, "state string, district_key string, atc_class string, month string, value double, baseline double, months_with_data long, multiplier double")


def test_flat_series_never_surges_and_a_real_one_does(spark):
    noisy = [100, 104, 96, 102, 98, 101, 99, 103, 97, 600, 100, 100]
    sig = surge.surge_signals(vectors(spark, {"FLAT": [100] * 12, "HIT": noisy, "FEW": [v / 20 for v in noisy]}))
    hit = sig.filter("is_surge").collect()
    assert [(r.district_key, r.month) for r in hit] == [("HIT", "January")]
    assert hit[0].z_modified > 50 and hit[0].z_classical <= 3.175 + 0.01
    assert sig.filter("district_key = 'FLAT' AND (NOT mad_undefined OR is_surge)").count() == 0
    s = surge.surge_summary(sig).first()
    assert s.ceiling_ok and s.surges == 1


def test_donor_is_never_promised_twice_and_vital_goes_first(d):
    recs = d.surge_recs
    per = recs.groupBy("from_facility_id", "supplied_item_id", "surge_month").agg(F.sum("quantity").alias("q"))
    floor = d.impact.groupBy("facility_id", "item_id").agg(F.max("reorder_point_surge").alias("p"))
    spare = d.reorder.join(floor, ["facility_id", "item_id"], "left").select(
        F.col("facility_id").alias("from_facility_id"), F.col("item_id").alias("supplied_item_id"),
        (F.col("on_hand") - F.coalesce("p", "reorder_point")).alias("spare"))
    assert per.join(spare, ["from_facility_id", "supplied_item_id"]).filter("q > spare + 1").count() == 0
    groups = {}
    for r in recs.collect():
        groups.setdefault((r.from_facility_id, r.supplied_item_id, r.surge_month), []).append((r.claim_rank, {"Vital": 0, "Essential": 1}.get(r.ven_class, 2)))
    assert any(len(g) > 1 for g in groups.values())
    for g in groups.values():
        order = [v for _, v in sorted(g)]
        assert order == sorted(order)


def test_surge_search_runs_once(d):
    """The totals over claims read them twice: from the written claims, not by searching again."""
    read = surge.surge_recommendations(d.impact, d.reorder, d.stock, d.facilities).inputFiles()
    assert any("h10-claims" in f for f in read) and not any("h10-offer" in f for f in read)


def test_absorption_is_monotone_and_consistent(d):
    rows = {}
    for r in d.absorption.collect():
        assert not (r.absorbs and r.units_short > 0)
        rows.setdefault((r.state, r.district, r.atc_class), {})[r.multiplier] = r.absorption_days
    assert all(v[2.0] >= v[3.0] >= v[5.0] for v in rows.values())


@pytest.mark.parametrize("m", [0.5, 25])
def test_scenario_refuses_out_of_range(d, m):
    with pytest.raises(surge.ScenarioError):
        surge.scenario_facilities(d.reorder, m)


def test_scenario_scope_and_surge_month(d):
    one = surge.scenario_facilities(d.reorder, 3.0, "NATION_3", "A01AB")
    assert {r.district for r in one.select("district").distinct().collect()} <= {"NATION_3"}
    month = d.spark.createDataFrame([("July",)], "month string")
    assert {r.surge_month for r in surge.surge_transfers(d.surge_recs, month).collect()} <= {"July"}


# -- model -------------------------------------------------------------------------------

def test_fit_finds_the_weekly_shape(spark):
    start = dt.date(2024, 1, 1)
    rows = [("F", "M", start + dt.timedelta(i), 50 + 20 * (i % 7 == 0) + i % 3) for i in range(140)]
    tr = spark.createDataFrame(rows, "facility_id string, item_id string, day date, quantity long")
    m = forecast.fit_models(tr).first()
    assert m.seasonal and m.n_days == 140 and len(m.value) == 30
    out = {r.day: r for r in forecast.forecast_rows(forecast.fit_models(tr)).collect()}
    monday, tuesday = out[start + dt.timedelta(140)], out[start + dt.timedelta(141)]
    assert monday.value > tuesday.value + 10
    assert all(r.lower <= r.value <= r.upper for r in out.values())


def test_fit_equals_least_squares(spark):
    """Every combination solved by lstsq on the rows themselves, over gaps, a constant and short series."""
    rng, start, series = np.random.default_rng(5), dt.date(2024, 3, 2), {}
    for n in (7, 9, 12, 30, 90):
        day = np.cumsum(rng.integers(1, 4, n)) - 1
        series[f"S{n}"] = (day - day[0], rng.poisson(20, n) + (day % 7 == 2) * 15 + day // 9)
    series["constant"], series["two"] = (np.arange(25), np.full(25, 7)), (np.array([0, 2]), np.array([4, 6]))
    rows = [("F", k, start + dt.timedelta(int(d)), int(q)) for k, (days, qty) in series.items() for d, q in zip(days, qty)]
    tr = spark.createDataFrame(rows, "facility_id string, item_id string, day date, quantity long")
    got = {r.item_id: r for r in forecast.fit_models(tr.repartition(5)).collect()}
    for name, (days, qty) in series.items():
        y = np.floor(np.interp(np.arange(days[-1] + 1), days, qty) * 100 + 0.5 + 1e-9) / 100
        r, n, best = got[name], len(y), None
        t = np.arange(3, n)
        dow = (t + (start - dt.date(1970, 1, 1)).days) % 7
        for p in range(4):
            for drift in (False, True):
                for seasonal in (False, True):
                    x = np.column_stack([np.ones(len(t))] + [t] * drift + [dow == d for d in range(1, 7)] * seasonal
                                        + [y[3 - i:n - i] for i in range(1, p + 1)]) if len(t) else np.zeros((0, 1))
                    k = x.shape[1]
                    if len(t) < k + 3 or np.linalg.matrix_rank(x) < k:
                        continue
                    beta = np.linalg.lstsq(x, y[3:], rcond=None)[0]
                    sse = float(((y[3:] - x @ beta) ** 2).sum())
                    aic = len(t) * np.log(max(sse / len(t), 1e-9, (y[3:] ** 2).sum() * 1e-12 / len(t))) + 2 * (k + 1)
                    if best is None or aic < best[0] - 1e-6:
                        best = aic, p, drift, seasonal, beta, sse, k
        assert r.n_days == n
        if best is None:
            assert r.aic is None and r.coefficients is None and set(r.value) == {float(qty.mean())}
            continue
        assert (r.p, r.drift, r.seasonal) == best[1:4], name
        assert r.aic == pytest.approx(best[0], rel=1e-6)
        chosen = [0] + [1] * r.drift + list(range(2, 8)) * r.seasonal + list(range(8, 8 + r.p))
        assert np.array(r.coefficients)[chosen] == pytest.approx(best[4], rel=1e-4, abs=1e-5)
        assert all(c == 0 for i, c in enumerate(r.coefficients) if i not in chosen)
        hist, phi = list(y), np.array(r.coefficients)[8:]
        for h, v in enumerate(r.value):
            d = (n + h + (start - dt.date(1970, 1, 1)).days) % 7
            c = r.coefficients
            hist.append(c[0] + c[1] * (n + h) + (c[1 + d] if d else 0) + sum(phi[i] * hist[-1 - i] for i in range(3)))
            assert v == pytest.approx(max(hist[-1], 0), rel=1e-6, abs=1e-6)


def test_fit_of_nothing(spark):
    tr = spark.createDataFrame([("F", "M", dt.date(2024, 1, 1), None)], "facility_id string, item_id string, day date, quantity long")
    assert forecast.fit_models(tr).collect() == [] and forecast.model_evaluate(forecast.fit_models(tr)).first().series == 0


def test_fit_shuffles_the_series_once(spark):
    tr = spark.createDataFrame([("F", "M", dt.date(2024, 1, 1), 5)], "facility_id string, item_id string, day date, quantity long")
    assert forecast.fit_models(tr)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_training_counts_days_of_any_kind(spark):
    from tests.test_stock import ledger
    D = dt.date
    rows = [("a", "F", "M", "received", 5, D(2024, 1, 1), None), ("b", "F", "M", "count", 5, D(2024, 1, 2), None),
            ("c", "F", "M", "dispensed", 5, D(2024, 1, 3), None), ("e", "F", "N", "dispensed", 5, D(2024, 1, 3), None)]
    fac = spark.createDataFrame([("F", True)], "facility_id string, is_forecast_facility boolean")
    got = plan.training_set(ledger(spark, rows), fac, 3).collect()
    assert [(r.item_id, r.quantity) for r in got] == [("M", 5)]


def test_fit_is_dealt_by_rows(spark, monkeypatch):
    """A series is filled up to every day, so the rows decide on the parts and not the bytes shuffled."""
    rows = [(f"F{i % 40}", "M", dt.date(2024, 1, 1) + dt.timedelta(days=9 * (i // 40)), 5 + i % 3) for i in range(600)]
    tr = spark.createDataFrame(rows, "facility_id string, item_id string, day date, quantity long")
    whole = {r.facility_id: r.asDict() for r in forecast.fit_models(tr).collect()}
    monkeypatch.setattr(forecast, "ROWS_A_TASK", 20)
    fit = forecast.fit_models(tr)
    text = fit._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and ", 30), REPARTITION_BY_NUM" in text
    assert {r.facility_id: r.asDict() for r in fit.collect()} == whole and len(whole) == 40


def test_days_of_a_series_are_summed_without_a_sort(spark):
    tr = spark.createDataFrame([("F", "M", dt.date(2024, 1, 1), 5)], "facility_id string, item_id string, day date, quantity long")
    text = forecast.series_sums(tr)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[facility_id" in text and text.count("SortAggregate(") <= 2      # seven rows a series are left


def km_between(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 12742.0 * math.asin(math.sqrt(min(1, x)))


def test_nearest_help_in_crowded_places(spark):
    """Many sources at one place and across the steps of the radius, against all pairs."""
    r = random.Random(5)
    spots = [(21.0, 76.0), (21.0, 76.01), (21.6, 76.4), (24.0, 79.0), (30.0, 76.0)]
    fac = [(f"F{i}", *spots[min(i % 7, 4)], 10 * i, True) for i in range(80)] + [("F900", -40.0, -70.0, 5, True), ("F901", 89.9, 10.0, 5, True)]
    rs = [(f, f"name {f}", "s", "d", m, m.lower(), "u", "Vital", 0 if short else 9, 1.0, "x", short)
          for f, *_ in fac for m in ("M", "N") for short in [r.random() < (0.8 if m == "M" else 0.3)]]
    lines = spark.createDataFrame(rs, "facility_id string, facility_name string, state string, district string, item_id string, item_name string, "
                                  "unit string, ven_class string, on_hand long, days_of_cover double, status string, needs_reorder boolean")
    places = spark.createDataFrame(fac, "facility_id string, latitude double, longitude double, population_served long, has_valid_coords boolean")
    got = {(x.facility_id, x.item_id): (x.source_id, x.km) for x in transfers.nearest_help(lines, places).collect()}
    at = {f: (la, lo) for f, la, lo, *_ in fac}
    want = {}
    for f, *_, m, _, _, _, _, _, _, short in rs:
        if short:
            km, who = min((km_between(*at[f], *at[x[0]]), x[0]) for x in rs if x[4] == m and not x[11] and x[0] != f)
            want[f, m] = (who, math.floor(km * 10 + 0.5) / 10)
    assert got == want and len({w for w, _ in want.values()}) > 4


def test_places_offer_their_first_two_facilities(spark):
    rows = [(f"F{i}", "M", 21.0, 76.0) for i in range(9)] + [("F1", "M", 21.0, 76.0), ("F7", "M", 22.0, 76.0), ("F8", "N", 21.0, 76.0), ("F0", "M", None, 76.0)]
    df = spark.createDataFrame(rows, "from_facility_id string, supplied_item_id string, from_lat double, from_lon double")
    got = sorted(map(tuple, transfers.first_of_place(df, ["supplied_item_id"]).collect()))
    assert got == [("F0", "M", 21.0, 76.0), ("F1", "M", 21.0, 76.0), ("F1", "M", 21.0, 76.0), ("F7", "M", 22.0, 76.0), ("F8", "N", 21.0, 76.0)]
