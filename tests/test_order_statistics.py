"""Exact places from counted histograms, the league summary and the reporting geography."""
import random

from pyspark.sql import functions as F

from ledgerwell.operators import score
from ledgerwell.plans.ranks import counted, holds


def test_places_equal_a_sorted_list(spark):
    r = random.Random(3)
    values = [None] * 3 + [50.0] * 700 + [round(r.uniform(0, 100), 1) for _ in range(1300)]      # a third of one value
    places = counted(spark.createDataFrame([(v,) for v in values], "v double").repartition(7), ["v"])
    rows = places.orderBy("start").collect()
    flat = [x.v for x in rows for _ in range(x.n)]
    assert flat == sorted(values, key=lambda v: (v is not None, v or 0))
    assert [x.start for x in rows] == [sum(y.n for y in rows[:i]) for i in range(len(rows))]
    assert places.filter(holds(F.lit(1000))).first().v == flat[1000]


def league(rows):
    """The summary from a plain sorted list."""
    rows = sorted(rows, key=lambda x: (x[1] is None, x[1] if x[1] is not None else 0, x[0]))
    s = [x[1] for x in rows if x[1] is not None]
    typical = rows[len(rows) // 2]
    t = typical[1]
    return {"districts": len(rows), "worst": rows[0][0], "best": rows[-1][0], "typical": typical[0], "typical_score": t,
            "median": s[len(s) // 2] if s else None, "lowest": min(s, default=None), "highest": max(s, default=None),
            "under_60": sum(x < 60 for x in s), "from_60": sum(60 <= x < 75 for x in s),
            "from_75": sum(75 <= x < 90 for x in s), "from_90": sum(x >= 90 for x in s),
            "above_typical": sum(x > t for x in s) if t is not None else 0, "below_typical": sum(x < t for x in s) if t is not None else 0}


def test_league_finish_equals_sorted_rows(spark):
    r = random.Random(9)
    for n, nulls in ((1, 0), (2, 1), (3, 3), (41, 4), (600, 200)):
        rows = [(f"D{i:04}", None if i < nulls else round(r.choice([100.0, r.uniform(20, 100)]), 1)) for i in range(n)]
        got = score.league_finish(spark.createDataFrame(rows, "district string, score double")).first().asDict()
        got.pop("gap")
        assert got == league(rows), n


def test_league_of_nothing(spark):
    got = score.league_finish(spark.createDataFrame([], "district string, score double")).first()
    assert got.districts == 0 and got.typical is None and got.median is None and got.above_typical == 0


def test_geography_keeps_levels_apart(spark, tmp_path):
    rows = [("S", "d1", "F1", "b"), ("S", "d1", "F1", "a"), ("S", "d1", "F2", "c"), ("S", None, "F3", "d"), (None, "d1", "F4", "e")]
    geo = score.reporting_geography(spark.createDataFrame(rows, "state string, district string, facility_id string, facility_name string"))
    flat = {r.facility_id: (r.state_lines, r.district_lines, r.lines, r.name) for r in score.flat_geography(geo).collect()}
    assert flat == {"F1": (4, 3, 2, "a"), "F2": (4, 3, 1, "c"), "F3": (4, 1, 1, "d"), "F4": (1, 1, 1, "e")}
    assert tuple(score.geography_totals(geo).first()) == (2, 3, 4, 5)
    assert not any(f.dataType.typeName() == "array" for f in geo.schema.fields)
    score.write_geography(geo, str(tmp_path / "geo"))
    nested = spark.read.parquet(str(tmp_path / "geo")).filter("state = 'S' AND district = 'd1'").first()
    assert nested.lines == 3 and [f.name for f in nested.facilities] == ["a", "c"]


def test_no_window_over_the_whole_table(spark):
    rows = spark.createDataFrame([("D", 1.0)], "district string, score double")
    plan = score.league_finish(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    places = counted(rows, ["score"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in places
