"""District matching by nested cells against brute force."""
import numpy as np
import pytest

from ledgerwell.operators import seasonal
from ledgerwell.plans.nearest import nearest

DIMS = ["z_population", "z_facilities", "z_phcs", "z_pop_per_phc"]
SCHEMA = "state string, district_key string, " + ", ".join(f"{d} double" for d in DIMS)


def brute(x, states, names, i, k, same):
    ok = (states == states[i]) if same else (states != states[i])
    ok[i] = False
    j = np.flatnonzero(ok)
    d = np.sqrt(((x[j] - x[i]) ** 2).sum(axis=1))
    order = sorted(zip(d.tolist(), names[j].tolist(), states[j].tolist()))[:k]
    return [(name, state) for _, name, state in order], [v for v, _, _ in order]


def clouds(n, seed):
    """A dense state of one kind holding a third, copies of one place, an outlier, and the rest."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 4)
    states = np.array([f"S{i}" for i in rng.integers(0, 12, n)])
    third = n // 3
    x[:third] = np.round(rng.normal(size=(third, 4)) * 0.01 + 6, 4)
    states[:third] = "HOT"
    x[third:third + n // 10] = [1.5, 0.5, -0.25, 2.0]
    x[-1] = [400.0, -300.0, 0.0, 9.0]
    return x, states, np.array([f"D{i:06}" for i in rng.permutation(n)])


def check(spark, x, states, names, same, sample):
    rows = [(s, k, *map(float, v)) for s, k, v in zip(states.tolist(), names.tolist(), x)]
    got = {}
    pairs = nearest(spark.createDataFrame(rows, SCHEMA).repartition(8), DIMS, "state", ["district_key"], 3, same)
    for r in pairs.select("id.district_key", "other", "distance", "rank").collect():
        got.setdefault(r.district_key, []).append((r["rank"], r.distance, (r.other.district_key, r.other.group)))
    for i in sample:
        mine = sorted(got.get(names[i], []))
        want, dist = brute(x, states, names, i, 3, same)
        assert [m[2] for m in mine] == want
        assert [m[1] for m in mine] == pytest.approx(dist, abs=1e-12)
    return got


@pytest.mark.parametrize("same", [False, True])
def test_matches_equal_brute_force(spark, same):
    x, states, names = clouds(1500, 4)
    check(spark, x, states, names, same, range(1500))


def test_a_hundred_thousand_profiles(spark):
    x, states, names = clouds(100_000, 8)
    check(spark, x, states, names, False, [0, 5, 33_000, 33_400, 43_000, 60_000, 99_998, 99_999])


@pytest.mark.parametrize("same", [False, True])
def test_few_and_odd_rows(spark, same):
    rows = [("A", "a", 0.0, 0.0, 0.0, 0.0), ("A", "b", 0.0, 0.0, 0.0, 0.0), ("B", "c", 1.0, 0.0, 0.0, 0.0),
            ("B", "n", None, 0.0, 0.0, 0.0), (None, "s", 0.0, 0.0, 0.0, 0.0)]
    got = nearest(spark.createDataFrame(rows, SCHEMA), DIMS, "state", ["district_key"], 3, same)
    pairs = {(r.id.district_key, r.other.district_key, r.distance, r["rank"]) for r in got.collect()}
    assert pairs == ({("a", "b", 0.0, 1), ("b", "a", 0.0, 1)} if same else
                     {("a", "c", 1.0, 1), ("b", "c", 1.0, 1), ("c", "a", 1.0, 1), ("c", "b", 1.0, 2)})
    assert nearest(spark.createDataFrame([], SCHEMA), DIMS, "state", ["district_key"], 3, same).count() == 0
