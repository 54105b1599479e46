import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerwell.operators import stock, transfers

D = dt.date
COLS = "event_id string, facility_id string, item_id string, event_type string, quantity bigint, event_ts timestamp_ntz, expiry_date date, source string, resource_type string"


def ledger(spark, rows):
    return spark.createDataFrame([(i, f, m, t, q, dt.datetime.combine(d, dt.time()), e, "seed", "medicine")
                                  for i, f, m, t, q, d, e in rows], COLS)


def brute(rows):
    today = max(r[5] for r in rows)
    used, lots, out = defaultdict(int), defaultdict(list), {}
    for i, f, m, t, q, d, e in rows:
        if t in ("dispensed", "expired", "dispatched", "lost"):
            used[f, m] += q
        elif t == "received":
            lots[f, m].append((e or D.max, i, q, e))
    for pair, batch in lots.items():
        upto = 0
        for _, i, q, e in sorted(batch):
            upto += q
            left = max(0, min(q, upto - used[pair]))
            if left:
                out[i] = (left, (e - today).days if e else None, bool(e and e <= today))
    return out


def test_first_expiry_first_out_and_undated_last(spark):
    rows = [("a1", "F", "M", "received", 10, D(2024, 1, 1), D(2024, 6, 1)),
            ("a2", "F", "M", "received", 10, D(2024, 1, 2), D(2024, 3, 1)),
            ("a0", "F", "M", "received", 10, D(2024, 1, 3), None),
            ("x", "F", "M", "dispensed", 12, D(2024, 1, 9), None),
            ("y", "F", "M", "count", 99, D(2024, 1, 10), None)]
    got = {r.batch_id: r for r in stock.current_stock(ledger(spark, rows)).collect()}
    assert set(got) == {"a1", "a0"}
    assert got["a1"].remaining_qty == 8 and got["a0"].remaining_qty == 10
    assert got["a0"].expiry_unknown and got["a0"].days_to_expiry is None and not got["a0"].is_expired
    assert got["a1"].as_of_date == D(2024, 1, 10)


def test_one_pair_with_a_third_of_the_rows(spark):
    rnd = random.Random(7)
    rows = []
    for n in range(3000):
        f, m = ("HOT", "HOT") if n % 3 == 0 else (f"F{rnd.randrange(20)}", f"M{rnd.randrange(9)}")
        day = D(2024, 1, 1) + dt.timedelta(rnd.randrange(60))
        kind = rnd.choice(["received", "received", "dispensed", "lost", "expired", "dispatched"])
        exp = None if rnd.random() < 0.3 else day + dt.timedelta(rnd.randrange(5))
        rows.append((f"{rnd.getrandbits(128):032x}", f, m, kind, rnd.randrange(1, 30), day, exp if kind == "received" else None))
    got = {r.batch_id: (r.remaining_qty, r.days_to_expiry, r.is_expired)
           for r in stock.current_stock(ledger(spark, rows)).collect()}
    assert got == brute(rows)


def test_balance_equals_batches_unless_below_zero(spark):
    rows = [("a", "F", "M", "received", 10, D(2024, 1, 1), D(2025, 1, 1)), ("b", "F", "M", "lost", 4, D(2024, 1, 2), None),
            ("c", "G", "M", "received", 3, D(2024, 1, 1), None), ("d", "G", "M", "dispensed", 5, D(2024, 1, 2), None)]
    led = ledger(spark, rows)
    r = stock.stock_reconcile(led, stock.current_stock(led)).first()
    assert (r.mismatches, r.below_zero, r.compared) == (1, 1, 2)


def test_units_expiring_earlier_counts_undated_first(spark):
    st = spark.createDataFrame([("F", "M", "b1", D(2024, 2, 1), 30, 10), ("F", "M", "b2", None, None, 5), ("F", "M", "b3", D(2024, 3, 1), 60, 20)],
                               "facility_id string, item_id string, batch_id string, expiry_date date, days_to_expiry int, remaining_qty bigint")
    rs = spark.createDataFrame([("F", "M", 0.1)], "facility_id string, item_id string, avg_daily_demand double")
    risk = {r.batch_id: r for r in transfers.batch_risk(st, rs).collect()}
    assert [risk[b].units_expiring_earlier for b in ("b2", "b1", "b3")] == [0, 5, 15]
    assert risk["b2"].at_risk_units is None and risk["b1"].at_risk_units == 10.0
    # Dated stock at risk is offered before undated stock.
    assert transfers.fefo_batch(transfers.batch_risk(st, rs)).first().fefo_batch_id == "b1"


def test_recorded_balance_of_unknown_pair_is_zero(spark):
    led = ledger(spark, [("a", "F", "M", "received", 10, D(2024, 1, 1), None)])
    keys = spark.createDataFrame([("F", "M"), ("F", "Z")], "facility_id string, item_id string")
    assert {(r.item_id, r.balance) for r in stock.recorded_balance(led, keys).collect()} == {("M", 10), ("Z", 0)}
