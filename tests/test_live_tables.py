"""Tables that micro-batches merge into: what they read, reruns, and equality with recomputing."""
import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerwell.operators import plan, stock
from ledgerwell.streaming import ledger as live
from tests.test_stock import ledger


def events(spark, n, seed, pairs=40):
    rng, rows = random.Random(seed), []
    for i in range(n):
        p = rng.randrange(pairs)
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(60))
        kind = rng.choice(["received", "received", "dispensed", "lost", "count", "expired", "dispatched"])
        rows.append((f"{seed}-{i}", f"F{p % 8}", f"M{p // 8}", kind, rng.randrange(1, 20), day, rng.choice([None, day + dt.timedelta(days=rng.randrange(90))])))
    return ledger(spark, rows).drop("source", "resource_type")


def reference(spark):
    base = spark.createDataFrame([(f"F{f}", f"M{m}", 1.0 + f, 0.5, 30) for f in range(8) for m in range(6)],
                                 "facility_id string, item_id string, avg_daily_demand double, demand_std_dev double, observed_days long")
    fac = spark.createDataFrame([(f"F{f}", "n", "S", "D", True, 3 + f, 10.0, False) for f in range(8)],
                                "facility_id string, name string, admin_l1 string, admin_l2 string, is_forecast_facility boolean, lead_time_days int, distance_to_hq_km double, lead_time_is_estimated boolean")
    items = spark.createDataFrame([(f"M{m}", f"item {m}", "tablet", "Vital", "A01AA") for m in range(6)], "item_id string, display_name string, unit string, ven_class string, atc_code string")
    return base, fac, items


def bag(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_lines_equal_recomputing_after_every_batch(spark, tmp_path):
    kept, ref, so_far = live.live_cells(spark, str(tmp_path / "kept"), 16), reference(spark), None
    for batch in range(4):
        new = events(spark, 60, batch)
        so_far = new if so_far is None else so_far.unionByName(new)
        live.merge_positions(new, kept, batch)
        got = live.live_lines(kept, *ref)
        assert bag(got) == bag(plan.reorder_status(*ref, stock.current_stock(so_far)))
        few = new.limit(5)
        assert bag(live.live_lines(kept, *ref, few)) == bag(got.join(few.select(*stock.PAIR).distinct(), stock.PAIR, "left_semi"))


def test_a_batch_reads_and_writes_only_its_buckets(spark, tmp_path):
    kept = live.live_cells(spark, str(tmp_path / "kept"), 64)
    live.merge_positions(events(spark, 4000, 1, pairs=400), kept, 0)
    rows = kept.read().count()
    small = events(spark, 3, 2, pairs=400)
    buckets = kept.touched(small)
    assert len(buckets) <= 3
    before = kept.read(0, buckets)
    assert {f.split("bucket=")[1].split("/")[0] for f in before.inputFiles()} == set(map(str, buckets)) and before.count() < rows / 10
    written = {p for p in (tmp_path / "kept/rows").glob("bucket=*/at=0")}
    assert live.merge_positions(small, kept, 1) == buckets
    assert {p.parent.name for p in (tmp_path / "kept/rows").glob("bucket=*/at=1")} == {f"bucket={b}" for b in buckets}
    assert {p for p in (tmp_path / "kept/rows").glob("bucket=*/at=0")} == written              # a rerun of 1 needs them
    live.merge_positions(small, kept, 2)
    assert not [p for b in buckets for p in (tmp_path / f"kept/rows/bucket={b}").glob("at=0")]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    kept, ref = live.live_cells(spark, str(tmp_path / "kept"), 8), reference(spark)
    first, second = events(spark, 50, 1), events(spark, 50, 2)
    live.merge_positions(first, kept, 0)
    live.merge_positions(second, kept, 1)
    once = bag(live.live_lines(kept, *ref))
    live.merge_positions(second, kept, 1)
    assert bag(live.live_lines(kept, *ref)) == once


def test_a_reader_sees_committed_batches(spark, tmp_path, monkeypatch):
    kept, ref = live.live_cells(spark, str(tmp_path / "kept"), 8), reference(spark)
    live.merge_positions(events(spark, 50, 1), kept, 0)
    once = bag(live.live_lines(kept, *ref))
    monkeypatch.setattr(type(kept), "commit", lambda self, batch: None)
    live.merge_positions(events(spark, 50, 2), kept, 1)
    assert bag(live.live_lines(kept, *ref)) == once


def test_the_stream_reads_each_event_once(spark, tmp_path):
    kept, ref = live.live_cells(spark, str(tmp_path / "kept"), 8), reference(spark)
    src, total, read = str(tmp_path / "in"), None, []
    for batch in range(3):
        new = events(spark, 40, batch)
        total = new if total is None else total.unionByName(new)
        new.write.mode("append").parquet(src)
        stream = live.stream_of(spark, src, new.schema)

        def on_batch(b, i):
            read.append(b.count())
            live.merge_positions(b, kept, i)
        live.run_available(stream, str(tmp_path / "ck"), on_batch)
    assert read == [40, 40, 40]                                            # nothing of the history comes again
    assert bag(live.live_lines(kept, *ref)) == bag(plan.reorder_status(*ref, stock.current_stock(total)))
    live.merge_positions(total.limit(0), kept, 9)
    assert bag(live.live_lines(kept, *ref)) == bag(plan.reorder_status(*ref, stock.current_stock(total)))


def test_keys_are_written_once_over_all_history(spark, tmp_path):
    out, seen = str(tmp_path / "out"), live.seen_keys(spark, str(tmp_path / "keys"), "event_id", 16)

    def write(ids, batch):
        return live.write_new(spark.createDataFrame([(i,) for i in ids], "event_id string"), out, batch, "event_id", seen)

    def written():
        return sorted(r.event_id for r in spark.read.parquet(out).collect())
    for batch, ids in enumerate((["a", "b", "a"], ["c"], ["a", "d", "c"])):
        write(ids, batch)
    assert written() == ["a", "b", "c", "d"]
    write(["d", "a"], 2)                                                   # the batch again, with other rows
    assert written() == ["a", "b", "c", "d"]
    files = []
    for batch in range(3, 9):
        write(["a", f"new{batch}"], batch)
        files.append(len(seen.read(batch, seen.touched(spark.createDataFrame([("a",)], "event_id string"))).inputFiles()))
    assert set(files) == {1}                                               # one file of one bucket, however many batches
    assert written() == ["a", "b", "c", "d", *[f"new{b}" for b in range(3, 9)]]


def test_stock_from_cells_counts_undated_and_overdrawn(spark):
    d = dt.date
    rows = [("a", "F", "M", "received", 10, d(2024, 1, 1), None), ("b", "F", "M", "received", 5, d(2024, 1, 1), d(2024, 2, 1)), ("c", "F", "M", "dispensed", 7, d(2024, 1, 3), None),
            ("d", "G", "M", "dispensed", 3, d(2024, 1, 3), None), ("e", "H", "M", "count", 3, d(2024, 1, 9), None), ("f", "I", "M", "received", 2, d(2024, 1, 2), d(2024, 1, 5))]
    led = ledger(spark, rows)
    cells = stock.position_cells(led)
    today = F.lit(d(2024, 1, 9))
    assert bag(stock.on_hand(cells, today)) == bag(plan.stock_on_hand(stock.current_stock(led)))
    assert {tuple(r) for r in stock.on_hand(cells, today).collect()} == {("F", "M", 8, None, None), ("I", "M", 2, d(2024, 1, 5), -4)}


# -- balances and transfers ----------------------------------------------------------------

ROWS = "event_id string, facility_id string, item_id string, event_type string, quantity long, seq long"


def test_balances_survive_a_restart(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    kept = live.balances(spark, str(tmp_path / "kept"), 8)
    opening = spark.createDataFrame([("F", "M", 5)], "facility_id string, item_id string, balance long")
    batches = [[("a", "F", "M", "received", 10, 1), ("b", "F", "M", "dispensed", 12, 2), ("n", "F", None, "dispensed", 1, 3)],
               [("c", "F", "M", "dispensed", 4, 3), ("d", "F", "M", "lost", 3, 4), ("e", "G", "M", "lost", 1, 4), ("f", "F", "M", "count", 99, 9), ("g", "F", "M", "received", None, 10)],
               [("h", "F", "M", "dispensed", 1, 1), ("i", "G", "M", "received", 2, 1), ("j", "G", "M", "expired", 2, 2)]]
    for rows in batches:
        spark.createDataFrame(rows, ROWS).write.mode("append").parquet(src)
        live.run_available(live.stream_of(spark, src, ROWS), ck, lambda b, i: live.hold_overdraws(b, i, opening, kept, out))
    got = {r.event_id: (r.held, r.on_record) for r in spark.read.parquet(out).collect()}
    assert got == {"a": (False, 5), "b": (False, 15), "n": (False, 0), "c": (True, 3), "d": (False, 3), "e": (True, 0), "f": (False, 0), "g": (False, 0),
                   "h": (True, 0), "i": (False, 0), "j": (False, 2)}
    assert {tuple(r) for r in kept.read().collect()} == {("F", "M", 0), ("G", "M", 0)}
    before = {tuple(r) for r in kept.read().collect()}
    live.hold_overdraws(spark.createDataFrame(batches[2], ROWS), 2, opening, kept, out)              # the batch again
    assert {tuple(r) for r in kept.read().collect()} == before


def test_a_pair_larger_than_an_arrow_batch(spark, tmp_path):
    kept, out = live.balances(spark, str(tmp_path / "kept"), 8), str(tmp_path / "out")
    rng = random.Random(4)
    rows = [(str(i), "F", "M", rng.choice(["received", "dispensed", "lost"]), rng.randrange(1, 9), i) for i in range(5000)]
    opening = spark.createDataFrame([], "facility_id string, item_id string, balance long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        for batch in range(2):
            part = rows[batch * 2500:(batch + 1) * 2500]
            live.hold_overdraws(spark.createDataFrame(rng.sample(part, len(part)), ROWS), batch, opening, kept, out)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    have, want = 0, {}
    for i, _, _, kind, q, _ in rows:
        hold = kind != "received" and q > have
        want[i] = (hold, have)
        have += q if kind == "received" else 0 if hold else -q
    assert {r.event_id: (r.held, r.on_record) for r in spark.read.parquet(out).collect()} == want
    assert [r.balance for r in kept.read().collect()] == [have]


REQUESTS = "request_id string, recommendation_id string, step string, ts timestamp_ntz"


def one_by_one(batches):
    order, at, log = ["recommended", "approved", "dispatched", "received"], {}, set()
    for rows in batches:
        for rid, rec, step, ts in sorted(rows, key=lambda r: (r[3], r[0])):
            if step in order[1:] and order.index(step) == at.get(rec, 0) + 1:
                at[rec] = order.index(step)
                log.add((rec, step, ts, rid))
    return log, at


def test_transfers_advance_over_batches(spark, tmp_path):
    kept, out, rng = live.transfer_states(spark, str(tmp_path / "kept"), 8), str(tmp_path / "out"), random.Random(8)
    batches = [[(f"{b}-{i}", f"T{rng.randrange(12)}", rng.choice(["approved", "dispatched", "received", "cancelled", "recommended"]),
                 dt.datetime(2024, 1, 1 + b, rng.randrange(24))) for i in range(40)] for b in range(4)]
    for b, rows in enumerate(batches):
        for _ in range(2):                                                 # every batch twice
            live.advance_transfers(spark.createDataFrame(rows, REQUESTS), b, kept, out)
    log, at = one_by_one(batches)
    assert {(r.recommendation_id, r.fulfilment_status, r.updated_at, r.request_id) for r in spark.read.parquet(out).collect()} == log
    assert {r.recommendation_id: r.reached for r in kept.read().collect()} == at


def test_closed_transfers_leave(spark, tmp_path):
    kept, out = live.transfer_states(spark, str(tmp_path / "kept"), 1), str(tmp_path / "out")

    def step(batch, rec, name, day):
        live.advance_transfers(spark.createDataFrame([(f"{batch}", rec, name, dt.datetime(2024, 1, day))], REQUESTS), batch, kept, out, keep_closed=10)

    def known():
        return {r.recommendation_id: r.reached for r in kept.read().collect()}
    for i, name in enumerate(("approved", "dispatched", "received", "approved")):      # the last one is a late repeat
        step(i, "T", name, 1 + i)
    assert known() == {"T": 3}
    step(4, "U", "approved", 9)
    assert known() == {"T": 3, "U": 1}
    step(5, "V", "approved", 30)
    assert known() == {"U": 1, "V": 1}
    assert len(spark.read.parquet(out).filter("recommendation_id = 'T'").collect()) == 3
