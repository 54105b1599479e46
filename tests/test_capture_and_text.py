import datetime as dt
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerwell.operators import ingest, match, quality
from ledgerwell.schema import LEDGER_COLUMNS

ITEMS = [("PARACETAMOL", "Paracetamol", ["pcm", "bukhar ki goli", "dolo", "crocin", "पैरासिटामोल"]),
         ("AMOXICILLIN", "Amoxicillin", ["amoxy", "mox"]),
         ("ORAL-REHYDRATION-SALTS", "Oral rehydration salts", ["ors", "ors packet"]),
         ("FERROUS-SALT-FOLIC-ACID", "Ferrous Salt + Folic acid", ["khoon ki goli", "iron tablet"]),
         ("METFORMIN", "Metformin", ["sugar ki goli", "glycomet"]),
         ("SALBUTAMOL", "Salbutamol", ["asthalin", "inhaler"]),
         ("INSULIN", "Insulin (Soluble)", ["insulin"])]


@pytest.fixture(scope="module")
def cat(spark):
    rows = [(i, n, n, v, "tablet", "Vital", True) for i, n, v in ITEMS]
    return spark.createDataFrame(rows, "item_id string, display_name string, local_name_in string, spoken_variants array<string>, unit string, ven_class string, is_forecast_item boolean")


def said(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_spoken_names_and_noise(spark, cat):
    want = {"pcm": "PARACETAMOL", "bukhar ki goli": "PARACETAMOL", "dolo 650": "PARACETAMOL", "amoxy": "AMOXICILLIN",
            "ORS ka packet": "ORAL-REHYDRATION-SALTS", "khoon ki goli": "FERROUS-SALT-FOLIC-ACID",
            "sugar ki goli": "METFORMIN", "asthalin": "SALBUTAMOL", "paracetamol ke do sau tablet": "PARACETAMOL",
            "amoxycillin": "AMOXICILLIN", "banana": None, "hello there": None, "xyzzy": None, "500": None, "": None,
            "haan ji boliye": None}
    got = {r.text: r.matched_id for r in match.match_items(said(spark, want), cat).collect()}
    assert got == want


def test_candidates_lose_nothing(spark, cat):
    """The joins against scoring every pair."""
    r = random.Random(5)
    names = [v for _, n, vs in ITEMS for v in (n, *vs)]
    texts = set()
    for _ in range(400):
        t = list(r.choice(names).lower())
        for _ in range(r.randrange(4)):
            p = r.randrange(len(t) + 1)
            t[p:p + r.randrange(2)] = r.choice(["", "a", "x", " ", "t"])
        texts.add("".join(t) + r.choice(["", "", " de do", " aaye hain bahut"]))
    # one worker's view of the index, in catalogue order
    idx = sorted([(x.ord, x.key, x.item_id) for x in match.name_index(cat).collect()], key=lambda x: x[0])
    shaped = {x.key: (x.s, x.u) for x in spark.createDataFrame([(k,) for _, k, _ in idx], "key string").select(
        "key", F.array_join(F.sort_array(match.tokens(F.col("key"))), " ").alias("s"),
        F.array_join(F.sort_array(F.array_distinct(match.tokens(F.col("key")))), " ").alias("u")).collect()}
    rows = match.match_items(said(spark, texts), cat).withColumn("key", quality.name_key("text"))
    rows = rows.withColumn("s", F.array_join(F.sort_array(match.tokens(F.col("key"))), " ")).withColumn(
        "u", F.array_join(F.sort_array(F.array_distinct(match.tokens(F.col("key")))), " ")).collect()
    hits = 0
    for x in rows:
        want = None
        if x.key is not None and x.s:
            a = [(-match.sort_score(x.s, shaped[k][0]), o, i) for o, k, i in idx]
            b = [(-match.set_score(x.u, shaped[k][1]), o, i) for o, k, i in idx if len(k) >= 4]
            if -min(a)[0] >= 85:
                want = min(a)[2]
            elif -min(b)[0] >= 90:
                want = min(b)[2]
        hits += want is not None
        assert x.matched_id == want, (x.text, x.matched_id, want)
    assert 50 < hits < len(rows)


@pytest.mark.parametrize("a,b,want", [("abc", "abc", 100), ("abcd", "abxd", 75), ("kitten", "sitting", 62), ("a", "b", 0)])
def test_indel_score(a, b, want):
    assert match.sort_score(a, b) == want


def test_vocabulary_takes_the_longest_term(spark):
    df = said(spark, ["palang", "two ANMs present today", "female health assistant", "health assistant female here", "nothing"])
    got = [(r.b, r.s) for r in df.select(match.match_vocabulary("text", match.BED_WORDS).alias("b"),
                                         match.match_vocabulary("text", match.STAFF_WORDS).alias("s")).collect()]
    assert got == [("BED-INPATIENT", None), (None, "STAFF-NURSE"), (None, "STAFF-HA-FEMALE"), (None, "STAFF-HA-FEMALE"), (None, None)]


def test_quick_list(cat):
    r = {x.item_id: x for x in match.quick_list(cat).collect()}
    assert r["PARACETAMOL"].hindi_name == "पैरासिटामोल" and r["PARACETAMOL"].spoken == "bukhar ki goli"
    assert r["AMOXICILLIN"].spoken == "amoxy"


# -- gate --------------------------------------------------------------------------------

def gate(spark, cat, extractions):
    df = spark.createDataFrame([("r", json.dumps(extractions))], "id string, reply string")
    return quality.capture_gate(quality.verify_item(quality.parse_reply(df), cat)).collect()


def ex(name, conf, qty, kind="received", **more):
    return {"local_name": name, "confidence": conf, "quantity": qty, "event_type": kind, **more}


def test_mixed_note(spark, cat):
    rows = gate(spark, cat, [ex("Paracetamol", .94, 200), ex("Oral rehydration salts", .42, 30), ex("zzz", .88, 50)])
    assert sorted((r.route, r.review_reason or "") for r in rows) == [
        ("events", ""), ("review", "low confidence"), ("review", "no matching item")]


@pytest.mark.parametrize("row,route,why", [
    (ex("Metformin", .45, 5), "review", "low confidence"), (ex("Metformin", .6, 5), "events", None),
    (ex("Metformin", .9, None), "review", "no quantity"), (ex("Metformin", .9, 5, "issued"), "review", "unknown event type"),
    (ex("Metformin", .9, 5, "request"), "requests", None), (ex("Metformin", .9, 5, "identify"), "identified", None),
    (ex("nonsense", .9, 5, item_id="METFORMIN"), "events", None), (ex("Metformin", .9, 5, item_id="FAKE"), "events", None),
    (ex("iron ki goli", .9, 5, generic_name="ferrous salt + folic acid"), "events", None)])
def test_gate(spark, cat, row, route, why):
    r = gate(spark, cat, [row])[0]
    assert (r.route, r.review_reason) == (route, why)


def test_confirmed_rows_still_need_a_quantity(spark, cat):
    df = spark.createDataFrame([("r", json.dumps([ex("Metformin", .1, 5), ex("Metformin", .1, None)]))], "id string, reply string")
    rows = quality.confirm_rows(quality.verify_item(quality.parse_reply(df), cat)).collect()
    assert sorted((r.route, r.confidence) for r in rows) == [("events", 1.0), ("review", 1.0)]


@pytest.mark.parametrize("reply,n,error", [
    ('[{"local_name": "a"}, {"local_name": "b"}]', 2, None), ('```json\n[{"local_name": "a"}]\n```', 1, None),
    ('{"local_name": "a"}', 1, None), ("no medicine here", 1, "reply is not JSON")])
def test_reply_shapes(spark, reply, n, error):
    rows = quality.parse_reply(spark.createDataFrame([("r", reply)], "id string, reply string")).collect()
    assert len(rows) == n and rows[0].error == error


def test_loss_reason(spark):
    df = spark.createDataFrame([("lost", " Broken "), ("lost", None), ("received", "broken")], "event_type string, loss_reason string")
    assert [r.x for r in df.select(quality.loss_reason().alias("x")).collect()] == ["broken", "unknown", None]


def test_ledger_projection(spark, cat):
    df = spark.createDataFrame([("e", "medicine", "F", "M", "count", 1, "chat", 1.0, "extra")],
                               "event_id string, resource_type string, facility_id string, item_id string, event_type string, quantity long, source string, confidence double, local_name string")
    assert quality.to_ledger(df).columns == LEDGER_COLUMNS


# -- overdraw, review --------------------------------------------------------------------

EV = "report_id string, facility_id string, item_id string, resource_type string, event_type string, quantity long, seq long"


def hold(spark, rows, start):
    ev = spark.createDataFrame([("R", "F", i, "medicine", k, q, n) for n, (i, k, q) in enumerate(rows)], EV)
    bal = spark.createDataFrame([("F", i, b) for i, b in start.items()], "facility_id string, item_id string, balance long")
    return [r.held for r in quality.overdraw_hold(ev, bal).orderBy("seq").collect()]


def test_overdraw_cases(spark):
    assert hold(spark, [("M", "dispensed", 50)], {"M": 0}) == [True]
    assert hold(spark, [("M", "received", 100), ("M", "dispensed", 60)], {"M": 0}) == [False, False]
    assert hold(spark, [("M", "lost", 5)], {"M": 20}) == [False]
    # A held row does not lower the balance, so a smaller one after it passes.
    assert hold(spark, [("M", "dispensed", 30), ("M", "dispensed", 20), ("M", "lost", 1)], {"M": 20}) == [True, False, True]
    assert hold(spark, [("M", "dispensed", None), (None, "lost", 9), ("N", "count", 99)], {"M": 0}) == [False, False, False]


def test_overdraw_long_group_spans_batches(spark):
    r = random.Random(1)
    rows = [("M", r.choice(["received", "dispensed"]), r.randrange(1, 20)) for _ in range(2500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = hold(spark, rows, {"M": 3})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    have, want = 3, []
    for _, k, q in rows:
        h = k == "dispensed" and q > have
        have += q if k == "received" else 0 if h else -q
        want.append(h)
    assert got == want


def test_nothing_is_held_without_balances(spark):
    ev = spark.createDataFrame([("R", "F", "M", "medicine", "lost", 9, 1)], EV)
    assert [r.held for r in quality.overdraw_hold(ev, None).collect()] == [False]


def test_review_answers(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rev = spark.createDataFrame([("a", "M", 5), ("b", None, 5), ("c", "M", None)], "event_id string, item_id string, quantity long")
    app = spark.createDataFrame([("1", "a", t(1), -2), ("2", "a", t(2), None), ("3", "a", t(3), 9), ("4", "b", t(1), 4), ("5", "c", t(1), None),
                                 ("6", "c", t(2), 7), ("7", "zz", t(1), 1)], "approval_id string, event_id string, approved_at timestamp_ntz, approved_quantity long")
    got = {r.approval_id: (r.approved, r.reason, r.quantity, r.quantity_source) for r in quality.review_approve(rev, app).collect()}
    assert got == {"1": (False, "negative quantity", None, None), "2": (True, None, 5, "extraction"),
                   "3": (False, "already approved", None, None), "4": (False, "no item", None, None),
                   "5": (False, "no quantity", None, None), "6": (True, None, 7, "reviewer"), "7": (False, "no review item", None, None)}
    assert [r.event_id for r in quality.pending_review(rev, quality.review_approve(rev, app)).collect()] == ["b"]


def test_numbers(spark):
    df = spark.createDataFrame([(1, "1,250 left, 13 days, 007 and 0.50", "1250.0 13.0 7"), (2, "none", "")], "id long, text string, facts string")
    got = {r.id: (r.foreign_numbers, r.first_foreign, r.numbers_checked) for r in quality.number_check(df).collect()}
    assert got == {1: (1, "0.5", False), 2: (0, None, True)}


def test_sms(spark):
    df = spark.createDataFrame([("in-155 paracetamol 200 aaye",), ("IN-155",), ("hello IN-1 x",)], "message string")
    assert [(r.facility_id, r.body) for r in quality.sms_parse(df).collect()] == [("IN-155", "paracetamol 200 aaye"), (None, None), (None, None)]


def test_issue_replay(spark):
    from tests.test_stock import ledger
    D = dt.date
    # Old stock that lasts, then stock that expires soon: first-in order lets the latter expire.
    rows = [("a", "F", "M", "received", 10, D(2024, 1, 1), D(2024, 12, 1)), ("b", "F", "M", "received", 10, D(2024, 1, 2), D(2024, 1, 20)),
            ("c", "F", "M", "dispensed", 8, D(2024, 1, 10), None), ("d", "F", "M", "dispensed", 8, D(2024, 1, 25), None),
            ("e", "F", "M", "dispensed", 9, D(2024, 1, 30), None)]
    r = quality.issue_policy_replay(ledger(spark, rows)).first()
    # FEFO: 8 of b, 2 of b expire, 10 of a for 17 asked. FIFO: 8 of a, b expires whole, 2 of a left.
    assert (r.units_expired_fefo, r.units_expired_fifo, r.units_dispensed, r.units_unmet) == (2, 10, 18, 7)


def test_extraction_score(spark):
    T = "case_id string, item_id string, event_type string, quantity long"
    routed = spark.createDataFrame([("1", "P", "count", 5, "events"), ("2", "P", "received", 5, "events"), ("3", "Q", "received", 1, "review")], T + ", route string")
    want = spark.createDataFrame([("1", "P", "received", 5), ("2", "P", "received", 6)], T)
    acc = spark.createDataFrame([("1", "P", "count", "received")], "case_id string, item_id string, event_type string, stands_for string")
    got = quality.extraction_score(routed, want, spark.createDataFrame([("3", "Q")], "case_id string, item_id string"),
                                   spark.createDataFrame([], "case_id string, item_id string"), acc)
    assert {r.case_id: r.passed for r in got.collect()} == {"1": True, "2": False, "3": True}
    assert quality.score_rate(got).first().pass_rate == 66.7


# -- loading -----------------------------------------------------------------------------

@pytest.mark.parametrize("line,name", [
    ("Atropine Ointment 1% 1 gm 4.20 1499(E) 30.03.2022", "Atropine"),
    ("White Petrolatum Jelly 100% 1 gm 0.10 1499(E) 30.03.2022", "White Petrolatum Jelly"),
    ("Oral rehydration salts As licensed 1 gm 0.99 1499(E) 30.03.2022", "Oral rehydration salts"),
    ("BCG vaccine Each Dose 9.92 1499(E) 30.03.2022", "BCG vaccine"),
    ("DPT vaccine Per 0.5 ml 15.73 1499(E) 30.03.2022", "DPT vaccine"),
    ("Diphtheria antitoxin 10000 IU Each Pack 1455.21 1499(E) 30.03.2022", "Diphtheria antitoxin")])
def test_price_line_names(spark, line, name):
    r = ingest.price_rows(spark.createDataFrame([("d", 1, "4.2.1 " + line)], "doc_id string, line_no long, line string")).collect()
    assert [x.medicine for x in r] == [name]


def test_wrapped_price_lines_and_long_documents(spark):
    lines = ["10.1.3 Ferrous salt (A) + Folic", "acid (B)", "Tablet 100 mg", "1 Tablet 1,200.50 1499(E) 30.03.2022",
             "Capsule 5 mg 1 Capsule 2.00 1499(E) 30.03.2022", "(1) page head", "10.1.4 Zinc Syrup 1 ml 0.50", "1499(E) 30.03.2022"]
    df = spark.createDataFrame([("d", i * 9_999, t) for i, t in enumerate(lines)], "doc_id string, line_no long, line string")
    got = [(r.medicine, r.form, r.price) for r in ingest.price_rows(df).orderBy("price").collect()]
    assert got == [("Zinc", "Syrup 1 ml", 0.5), ("Ferrous salt (A) + Folic acid (B)", "Capsule 5 mg 1 Capsule", 2.0),
                   ("Ferrous salt (A) + Folic acid (B)", "Tablet 100 mg 1 Tablet", 1200.5)]


@pytest.mark.parametrize("form,unit", [("Tablet 100 mg 1 Tablet", "tablet"), ("Injection 0.6 mg/ml 1 ml", "vial"),
                                       ("As licensed 1 gm", "unit"), ("Injection 1000ml Each Pack", "vial"), ("Injection 0.9% 1000ml Glass", None)])
def test_pack_unit(spark, form, unit):
    assert spark.createDataFrame([(form,)], "form string").select(ingest.pack_unit("form").alias("u")).first().u == unit


def test_price_choice(spark):
    prices = spark.createDataFrame([("Paracetamol", "Tablet 500 mg 1 Tablet", .93), ("Paracetamol", "Tablet 650 mg 1 Tablet", 1.21),
                                    ("Paracetamol", "Oral liquid 125 mg/5 ml 1 ml", .35)], "medicine string, form string, price double")
    items = spark.createDataFrame([("Paracetamol", "tablet"), ("Paracetamol (x)", "bottle")], "display_name string, unit string")
    assert [(r.unit, r.ceiling_price) for r in ingest.choose_price(prices, items).collect()] == [("tablet", .93)]


def test_codes_are_confident_or_null(spark):
    codes = spark.createDataFrame([("insulin", "A10"), ("zinc", "A12"), ("artemether + lumefantrine", "P01")], "key string, atc_code string")
    names = ["Insulin Premix 30:70", "Zinc sulphate", "Artemether + Lumefantrine", "Insulin + other", "Insulin*"]
    got = {r.medicine: r.atc_code for r in ingest.lookup_code(spark.createDataFrame([(n,) for n in names], "medicine string"), codes).collect()}
    assert got == {names[0]: "A10", names[1]: None, names[2]: "P01", names[3]: None, names[4]: "A10"}


def test_failed_check_stops_the_load(spark):
    with pytest.raises(ingest.LoadError):
        ingest.require(spark.createDataFrame([(False,)], "ok boolean"))


def test_slices_are_replaced(spark, tmp_path):
    from tests.test_stock import ledger
    led = ledger(spark, [("a", "F", "M", "received", 1, dt.date(2024, 1, 1), None), ("b", "F", "M", "lost", 1, dt.date(2024, 1, 2), None)])
    ingest.write_slices(led.withColumn("day", F.to_date("event_ts")), str(tmp_path / "s"), ["day"])
    ingest.write_slices(led.filter("event_id = 'a'").withColumn("quantity", F.lit(7).cast("bigint")).withColumn("day", F.to_date("event_ts")), str(tmp_path / "s"), ["day"])
    assert sorted(r.quantity for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [1, 7]


# -- streams -----------------------------------------------------------------------------

def test_late_and_repeated_movements(spark, tmp_path):
    from ledgerwell.streaming import ledger as live
    t = lambda day: dt.datetime(2024, 1, day)
    schema = "event_id string, event_ts timestamp"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    batches = [[("T:dispatched", t(1)), ("T:dispatched", t(1))], [("T:dispatched", t(2)), ("T:received", t(3))], [("U:dispatched", t(3)), ("T:received", t(4))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        live.run_available(live.movements_once(live.stream_of(spark, src, schema), "30 days"), ck, lambda b, i: live.write_batch(b, out, i))
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["T:dispatched", "T:received", "U:dispatched"]


def test_price_lines_without_a_section(spark):
    lines = [("d", i, "Tablet 5 mg 1 Tablet 2.00 1499(E) 30.03.2022" if i % 1000 == 999 else f"page text {i}") for i in range(100_000)]
    got = ingest.price_rows(spark.createDataFrame(lines, "doc_id string, line_no long, line string")).collect()
    assert len(got) == 100 and {r.medicine for r in got} == {""} and all(r.price == 2.0 for r in got)


def test_price_lines_fold_by_counts(spark):
    """A price before any form inside a wrapped name, a tail over three lines, two medicines."""
    lines = ["1.2 Iron", "salt", "5 mg 3.00 7(E) 01.01.2020", "more name", "Tablet 9 mg", "1", "9.50", "8(E) 02.02.2020",
             "Capsule 1 mg 4.00 9(E) 03.03.2020", "1.3 Zinc Syrup 2 ml 6.25", "5(E) 04.04.2020"]
    got = ingest.price_rows(spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc_id string, line_no long, line string"))
    assert sorted((r.medicine, r.form, r.price) for r in got.collect()) == [
        ("Iron salt", "5 mg", 3.0), ("Iron salt more name", "Capsule 1 mg", 4.0), ("Iron salt more name", "Tablet 9 mg 1", 9.5), ("Zinc", "Syrup 2 ml", 6.25)]


def test_price_lines_without_a_price_are_searched_line_by_line(spark):
    """Long documents without a price, one of them a wrapped section, beside a short one with one."""
    lines = ([("a", i, f"page text {i}") for i in range(50_000)]
             + [("b", 0, "1.2 Iron")] + [("b", i, f"salt {i}") for i in range(1, 50_000)]
             + [("c", 0, "1.2 Iron Tablet 5 mg 2.00 7(E) 01.01.2020")])
    t0 = time.time()
    got = ingest.price_rows(spark.createDataFrame(lines, "doc_id string, line_no long, line string")).collect()
    assert [(r.doc_id, r.medicine, r.form, r.price) for r in got] == [("c", "Iron", "Tablet 5 mg", 2.0)]
    assert time.time() - t0 < 20


def test_price_tails_against_one_search_over_the_text(spark):
    """Random documents of tail words, cells of seven lines, against one expression over the whole text."""
    r = random.Random(9)
    ended = re.compile(r"(?s)(.*?\s[\d,]+\.\d{2}\s+\S*\(E\)\s+\d{2}\.\d{2}\.\d{4})(?:\n|\Z)")
    docs = {}
    for d in range(60):
        flow = []
        for _ in range(r.randrange(40)):
            flow += r.choice([["2.00", "7(E)", "01.01.2020"], ["2.00", "7(E)", "01.01.2020"], ["Tablet"], ["7(E)"], ["3.00"], ["x", "02.02.2020"]])
        out = []
        while flow:
            n = r.choice([1, 1, 2, 3, 3, 3, 4])
            out.append(" ".join(flow[:n]))
            flow = flow[n:]
        docs[f"d{d}"] = out
    want = sorted((d, " ".join(m.split())) for d, ls in docs.items() for m in ended.findall("\n".join(ls)))
    df = spark.createDataFrame([(d, 0, i, t) for d, ls in docs.items() for i, t in enumerate(ls)],
                               "doc_id string, section long, line_no long, body string")
    pieces, complete = {}, set()
    for x in ingest._price_tails(df, 7).orderBy("doc_id", "line_no").collect():
        pieces.setdefault((x.doc_id, x.piece), []).append(x.body)
        if x.ends:
            complete.add((x.doc_id, x.piece))
    got = sorted((k[0], " ".join(pieces[k])) for k in complete)
    assert len(got) > 100 and got == want


def test_suffixes_of_a_common_slug(spark):
    names = ["!!" if i % 3 == 0 else f"name {i % 50}" for i in range(3000)]
    seen, want = {}, {}
    for i, n in enumerate(names):
        slug = "ITEM" if n == "!!" else n.upper().replace(" ", "-")
        seen[slug] = seen.get(slug, 0) + 1
        want[i] = slug if seen[slug] == 1 else f"{slug}-{seen[slug]}"
    rows = ingest.with_item_id(spark.createDataFrame(list(enumerate(names)), "ord long, medicine string"))
    assert rows.columns == ["ord", "medicine", "item_id"]
    assert {r.ord: r.item_id for r in rows.collect()} == want


def test_price_choice_by_pieces(spark):
    prices = spark.createDataFrame([("Zincovit", "Tablet 5 mg 1 Tablet", 2.0), ("Zinc", "Tablet 5 mg 1 Tablet", 3.0), ("Iron", "Tablet 1 mg 1 Tablet", 1.0)],
                                   "medicine string, form string, price double")
    items = spark.createDataFrame([("zinc (any)", "tablet"), ("on", "tablet"), ("none", "tablet"), ("o", "tablet")], "display_name string, unit string")
    assert {(r.item_match, r.ceiling_price) for r in ingest.choose_price(prices, items).collect()} == {("zinc", 2.0), ("on", 1.0), ("o", 1.0)}


def test_export_gives_all_rows_and_one_facility(spark):
    from tests.test_stock import ledger
    rows = [(f"e{i}", f"F{i % 2}", "M", "received", 1, dt.date(2024, 1, 1 + i % 5), None) for i in range(6000)]
    led = ledger(spark, rows)
    led = led.withColumns({c: F.lit(None).cast(t) for c, t in (("source", "string"), ("confidence", "double")) if c not in led.columns})
    fac = spark.createDataFrame([("F0", "a", "S", "D", "phc"), ("F1", "b", "S", "D", "phc")], "facility_id string, name string, admin_l1 string, admin_l2 string, facility_type string")
    items = spark.createDataFrame([("M", "m", "A", "Vital", "tablet")], "item_id string, display_name string, atc_code string, ven_class string, unit string")
    assert ingest.interchange_export(led, fac, items).count() == 6000
    assert ingest.interchange_export(led, fac, items, facility_id="F1").count() == 3000
    assert ingest.interchange_export(led, fac, items, limit=7).count() == 7
    with pytest.raises(ValueError):
        ingest.interchange_export(led, fac, items, days=0)
