import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerwell.functions import haversine_km, rnd
from ledgerwell.operators.transfers import best_donor, up_to_a_sure_one
from ledgerwell.plans.near import near_pairs, with_probe_cells
from ledgerwell.plans.one_row import beside
from ledgerwell.plans.ordered import running_totals
from ledgerwell.plans.snapshot import shared_folder, snapshot


def km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 12742.0 * math.asin(math.sqrt(min(1, x)))


def test_haversine(spark):
    v = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d")).first().d
    assert 110 < v < 112


@pytest.mark.parametrize("x,n,want", [(2.6, 0, 3.0), (-2.5, 0, -3.0), (1.005, 1, 1.0), (0.25, 1, 0.3), (None, 1, None)])
def test_rounding_is_half_away_from_zero(spark, x, n, want):
    assert spark.createDataFrame([(x,)], "x double").select(rnd("x", n).alias("r")).first().r == want


@pytest.mark.parametrize("radius", [3.0, 40.0, 400.0])
def test_near_pairs_equals_brute_force(spark, radius):
    r = random.Random(int(radius))
    a = [(i, r.uniform(6, 38), r.uniform(68, 98)) for i in range(150)] + [(900, 30.0, 80.0), (901, -30.0, 80.0)]
    b = [(i, la + r.uniform(-.5, .5), lo + r.uniform(-.5, .5)) for i, la, lo in a] + [(999, 30.0, 80.0)]
    got = near_pairs(spark.createDataFrame(a, "p long, to_lat double, to_lon double"),
                     spark.createDataFrame(b, "q long, from_lat double, from_lon double"), radius)
    want = {(p, q) for p, la, lo in a for q, lb, l2 in b if km(la, lo, lb, l2) <= radius}
    rows = [(x.p, x.q) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_running_totals_equal_a_plain_running_sum(spark):
    r = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", r.randrange(4), r.randrange(5), i, r.randrange(-5, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, c1 int, c2 int, i long, v long")
    got = {x.i: (x.run, x.n) for x in running_totals(df, ["k"], ["c1", "c2"], ["i"], {"run": F.col("v"), "n": F.lit(1)}).collect()}
    want, tot = {}, {}
    for k, c1, c2, i, v in sorted(rows):
        s, n = tot.get(k, (0, 0))
        tot[k] = want[i] = (s + v, n + 1)
    assert got == want


NEED = "to_facility_id string, requested_item_id string, atc_class string, to_lat double, to_lon double, want int"
OFFER = "from_facility_id string, supplied_item_id string, donor_class string, from_lat double, from_lon double, have int"


def brute_donors(need, offer, radius):
    want = {}
    for f, m, c, la, lo, w in need:
        c_ = [(m2 != m, math.floor(km(la, lo, lb, l2) * 10 + .5) / 10, g) for g, m2, c2, lb, l2, h in offer
              if g != f and h >= w and (m2 == m or (c is not None and c2 == c)) and la is not None and lb is not None and km(la, lo, lb, l2) <= radius]
        if c_:
            want[f] = min(c_)
    return want


def donors(spark, need, offer, radius, **how):
    out = best_donor(spark.createDataFrame(need, NEED), spark.createDataFrame(offer, OFFER), ["to_facility_id", "requested_item_id"], radius,
                     F.col("have") >= F.col("want"), ["distance_km", "from_facility_id", "supplied_item_id"], grows=["have"], **how)
    return out, {x.to_facility_id: (x.is_substitution, x.distance_km, x.from_facility_id) for x in out.collect()}


@pytest.mark.parametrize("levels", [1, 3, 5])
@pytest.mark.parametrize("place", ["spread", "crowded", "date line"])
def test_best_donor_equals_brute_force(spark, place, levels):
    r = random.Random(11)

    def spot(i):
        if place == "date line":
            return r.uniform(-17, -15), r.choice([r.uniform(179, 180), r.uniform(-180, -179)])
        if place == "crowded" and i % 5 == 0:                      # a fifth within some metres
            return 21 + r.uniform(0, 1e-4), 76 + r.uniform(0, 1e-4)
        return r.uniform(20, 22), r.uniform(75, 77)
    need = [(f"n{i}", f"m{i % 5}", f"c{i % 2}", *spot(i), r.randrange(5, 45)) for i in range(120)]
    offer = [(f"o{i}", f"m{i % 6}", None if i % 6 == 5 else f"c{i % 2}", *spot(i), r.randrange(1, 40)) for i in range(150)]
    need += [("o3", "m1", "c1", *offer[3][3:5], 1), ("lost", "m1", "c1", None, None, 1), ("no class", "m2", None, 21.0, 76.0, 1)]
    offer += [("o3", "m4", "c1", *offer[3][3:5], 90), ("nowhere", "m1", "c1", None, None, 90)]
    _, got = donors(spark, need, offer, 120.0, levels=levels)
    assert got == brute_donors(need, offer, 120.0)


def test_crowded_spot(spark):
    """A fifth of all places within a kilometre."""
    r = random.Random(2)

    def spot(i):
        return (21 + r.uniform(0, 0.01), 76 + r.uniform(0, 0.01)) if i % 5 == 0 else (r.uniform(18, 24), r.uniform(73, 79))
    need = [(f"n{i}", "m", "c", *spot(i), r.randrange(5, 20)) for i in range(1500)]
    offer = [(f"o{i}", "m", "c", *spot(i), r.randrange(1, 40)) for i in range(1500)]
    _, got = donors(spark, need, offer, 150.0)
    assert got == brute_donors(need, offer, 150.0)


@pytest.mark.parametrize("most", [20, 60])
def test_offers_of_one_place(spark, most):
    """Many facilities at each of a few positions, needs among them; ``most`` over 40 is an ask that no offer meets."""
    r = random.Random(most)
    spots = [(21.0, 76.0), (21.0, 76.3), (21.4, 76.0)]
    need = [(f"f{i}", f"m{i % 4}", f"c{i % 2}", *spots[i % 3], r.randrange(1, 20)) for i in range(60)]
    need += [("hard", "m9", "c0", *spots[0], most), ("no ask", "m1", "c1", *spots[0], None)]
    offer = [(f"f{i}", f"m{r.randrange(6)}", r.choice(["c0", "c1", None]), *spots[i % 3], r.randrange(1, 40)) for i in range(240)]
    offer += [o for o in offer[:9]] + [("none", "m1", "c1", *spots[1], None)]
    _, got = donors(spark, need, offer, 120.0, asks={"have": F.col("want")})
    asked, had = [n for n in need if n[-1] is not None], [o for o in offer if o[-1] is not None]
    assert got == brute_donors(asked, had, 120.0)


def test_a_place_offers_no_more_than_needs_take(spark):
    rows = [(f"f{i:03}", "m", 21.0, 76.0, i, i % 10 == 0) for i in range(500)] + [("f000", "m", 21.0, 76.0, 3, True)]
    df = spark.createDataFrame(rows, "from_facility_id string, supplied_item_id string, from_lat double, from_lon double, days int, _serves boolean")
    got = up_to_a_sure_one(df, ["supplied_item_id"], ["days", "from_facility_id", "supplied_item_id"])
    assert sorted(r.days for r in got.collect()) == sorted([*range(11), 3])


def test_probe_cells_are_compiled(spark, capsys):
    """The JVM leaves methods of over 8,000 bytes uncompiled."""
    at = spark.range(9).select((F.col("id") + 0.5).alias("to_lat"), (F.col("id") + 0.5).alias("to_lon"), (F.col("id") % 3).alias("_level"), (F.col("id") * 0.1).alias("_bound"))
    with_probe_cells(at, "to_lat", "to_lon", F.lit(150.0) / F.pow(F.lit(8.0), F.col("_level")), F.col("_bound")).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_beside_needs_no_join(spark):
    a, b = spark.range(5).agg(F.count("*").alias("a")), spark.range(7).agg(F.max("id").alias("b"))
    df = beside(a, b)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.first().asDict() == {"a": 5, "b": 6}


def test_snapshot_uses_the_folder_the_session_names(spark):
    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") == folder
    assert snapshot(spark.range(3), "t").count() == 3


def test_values_that_do_not_match_any_partition_size(spark):
    from ledgerwell.operators.ingest import numbered
    df = numbered(spark.range(1000).repartition(7).select("id"))
    assert sorted(r.row_no for r in df.collect()) == list(range(1000))


@pytest.mark.parametrize("radius", [150.0, 3000.0, 12000.0, 20100.0])
def test_near_pairs_over_the_whole_globe(spark, radius):
    r = random.Random(int(radius))
    spots = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(60)]
    spots += [(10, 179.95), (10, -179.95), (89.9, 10), (89.9, -170), (-89.9, 0), (-15, -50), (20, 77), (0, 180), (0, -180), (90, 0), (-90, 5)]
    a = [(i, float(la), float(lo)) for i, (la, lo) in enumerate(spots)]
    got = near_pairs(spark.createDataFrame(a, "p long, to_lat double, to_lon double"),
                     spark.createDataFrame(a, "q long, from_lat double, from_lon double"), radius)
    want = {(p, q) for p, la, lo in a for q, lb, l2 in a if km(la, lo, lb, l2) <= radius}
    rows = [(x.p, x.q) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_far_help_is_the_nearest_wherever_it_is(spark):
    from ledgerwell.operators.transfers import _far_pairs
    r = random.Random(4)
    need = [(f"n{i}", f"m{i % 3}", r.uniform(-88, 88), r.uniform(-180, 180)) for i in range(40)]
    have = [(f"s{i}", f"m{i % 3}", r.uniform(-88, 88), r.uniform(-180, 180)) for i in range(90)]
    pairs = _far_pairs(spark.createDataFrame(need, "facility_id string, item_id string, to_lat double, to_lon double"),
                       spark.createDataFrame(have, "source_id string, item_id string, from_lat double, from_lon double"),
                       ["facility_id", "item_id"]).collect()
    best = {}
    for p in pairs:
        best[p.facility_id] = min(best.get(p.facility_id, (1e9, "")), (p.km, p.source_id))
    assert {k: v[1] for k, v in best.items()} == {
        n: min((km(la, lo, lb, l2), s) for s, j, lb, l2 in have if j == m)[1] for n, m, la, lo in need}
    assert len(pairs) < len(need) * len(have) / 6


def test_running_totals_keep_null_keys(spark):
    rows = [("a", None, 1, 5), ("a", None, 2, 7), (None, 1, 1, 3), (None, 1, 2, 4), ("a", 1, 1, 1)]
    df = spark.createDataFrame(rows, "k string, cell long, at long, v long")
    got = running_totals(df, ["k"], ["cell"], ["at"], {"run": F.col("v")})
    assert sorted(((r.k or "", r.cell or 0, r.at, r.run) for r in got.collect())) == [
        ("", 1, 1, 3), ("", 1, 2, 7), ("a", 0, 1, 5), ("a", 0, 2, 12), ("a", 1, 1, 13)]


def test_places_over_a_whole_table(spark):
    from ledgerwell.plans import scan
    rows = [((i * 7919) % 500 // 7, None if i % 3 == 0 else f"E{i:06d}") for i in range(500)]
    df = spark.createDataFrame(rows, "score int, id string")
    got = scan.numbered(df, [F.desc("score"), F.asc("id")]).collect()
    want = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or ""))
    assert [(r.score, r.id) for r in sorted(got, key=lambda r: r.place)] == want
    assert sorted(r.place for r in got) == list(range(500))
    assert scan.numbered(df.limit(0), ["score"]).collect() == []


def test_a_small_circle_probes_few_cells(spark):
    df = spark.createDataFrame([(21.1234, 76.1234)], "to_lat double, to_lon double")
    few, all_round = with_probe_cells(df, "to_lat", "to_lon", 50.0, 0.1), with_probe_cells(df, "to_lat", "to_lon", 50.0)
    assert few.count() == 1 and all_round.count() >= 9
