"""One model per series (D9, D10): autoregression with optional drift and weekday effects.

All sixteen combinations of a series are least squares on the same rows, so their normal
equations are parts of one matrix of sums. Spark adds that matrix up per series and weekday in
one aggregate; what reaches Python is one short row per series, and a batch of series is solved
at once by elimination over arrays. The daily values are whole hundredths, so the sums are
exact and do not depend on the order in which they are added.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import rnd, share
from ..plans.listing import upto
from ..plans.streamed import shuffle_width
from .plan import HORIZON
from .stock import PAIR, mean4

Z80 = 1.2815515655446004        # two-sided 80 % interval
MAX_P = 3
WEEK = 7
UNIT = 100.0                    # the sums count hundredths
TERMS = ["level", "trend", *[f"weekday_{d}" for d in range(1, WEEK)], *[f"lag_{i}" for i in range(1, MAX_P + 1)]]
MODEL = ("facility_id string, item_id string, n_days bigint, p int, drift boolean, seasonal boolean, "
         "aic double, sigma double, last_day date, value array<double>, lower array<double>, upper array<double>, "
         "coefficients array<double>")
COLUMNS = [c.split()[0] for c in MODEL.split(", ")]

_SUMMED = ["one", "t", *[f"l{i}" for i in range(1, MAX_P + 1)], "y"]
_AT = [0, 1, *range(1 + WEEK, 1 + WEEK + MAX_P), len(TERMS)]      # their places among the terms, then the value
_PAIRS = [(i, j) for i in range(len(_SUMMED)) for j in range(i + 1)]
ROWS_A_TASK = 20_000            # of the training set; each stands for all days up to the next one
ALIASED = 1e-9                  # a term is a combination of earlier ones below this share of its square sum


def daily_values(training: DataFrame) -> DataFrame:
    """A row for every day from a series' first to its last, in whole hundredths; days without a
    row are interpolated. ``training`` has one row per series and day; null quantities are no rows."""
    known = training.filter("quantity IS NOT NULL").select(*PAIR, "day", (F.col("quantity").cast("double") * UNIT).alias("q"))
    ahead = Window.partitionBy(*PAIR).orderBy("day")
    rows = (known.withColumn("gap", F.greatest(F.coalesce(F.date_diff(F.lead("day").over(ahead), F.col("day")), F.lit(1)), F.lit(1)))
            .withColumn("rise", F.coalesce(F.lead("q").over(ahead) - F.col("q"), F.lit(0.0)))
            .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("gap") - 1))))
    return rows.select(*PAIR, F.date_add("day", F.col("k")).alias("day"),
                       F.floor(F.col("q") + F.col("rise") * F.col("k") / F.col("gap") + 0.5).cast("double").alias("y"),
                       F.when(F.col("k") == 0, F.col("q")).alias("seen"))


def series_sums(training: DataFrame) -> DataFrame:
    """Per series the sums of products of (1, day number, lags, value) for each weekday, one after
    the other, with the last values and the mean of the days seen. One shuffle on the series, into as
    many parts as the rows ask for: a part grows many times when its days are filled in, so the size
    of what is shuffled says nothing about it. Sums and maxima are of plain numbers, which are hashed, not sorted."""
    order = Window.partitionBy(*PAIR).orderBy("day")
    parts = max(shuffle_width(training), -(-training.count() // ROWS_A_TASK))
    rows = daily_values(training.repartition(parts, *PAIR)).withColumn("day_no", F.row_number().over(order) - 1)
    rows = rows.withColumn("is_last", F.lead(F.lit(True)).over(order).isNull())
    for i in range(1, MAX_P + 1):
        rows = rows.withColumn(f"l{i}", F.lag("y", i).over(order))
    full = F.col(f"l{MAX_P}").isNotNull()
    one = F.when(full, F.lit(1.0))
    value = {"one": one, "t": one * F.col("day_no"), "y": one * F.col("y"), **{f"l{i}": one * F.col(f"l{i}") for i in range(1, MAX_P + 1)}}
    rows = rows.select(*PAIR, "day", "seen", "is_last", F.pmod(F.unix_date("day"), F.lit(WEEK)).alias("dow"),
                       F.col("y").alias("now"), F.col("l1").alias("now1"), F.col("l2").alias("now2"),
                       *[v.alias(n) for n, v in value.items()])
    sums = F.array(*[F.coalesce(F.sum(F.col(_SUMMED[i]) * F.col(_SUMMED[j])), F.lit(0.0)) for i, j in _PAIRS])
    by_day = rows.groupBy(*PAIR, "dow").agg(
        sums.alias("sums"), F.count("*").alias("n"), F.sum("seen").alias("seen"), F.count("seen").alias("n_seen"),
        F.min("day").alias("first"), *[F.max(F.when(F.col("is_last"), F.col(c))).alias(f"last_{c}") for c in ("day", "now", "now1", "now2")])
    none = F.array(*[F.lit(0.0)] * len(_PAIRS))
    return by_day.groupBy(*PAIR).agg(
        F.flatten(F.array(*[F.coalesce(F.max(F.when(F.col("dow") == d, F.col("sums"))), none) for d in range(WEEK)])).alias("sums"),
        F.sum("n").alias("n_days"), (F.sum("seen") / F.sum("n_seen")).alias("mean"),
        F.pmod(F.unix_date(F.min("first")), F.lit(WEEK)).cast("int").alias("first_dow"), F.max("last_day").alias("last_day"),
        F.array(*[F.coalesce(F.max(f"last_{c}"), F.lit(0.0)) for c in ("now", "now1", "now2")]).alias("history")).select(
        *PAIR, "n_days", "mean", "first_dow", "last_day", "sums", "history")


def normal_equations(sums: np.ndarray) -> np.ndarray:
    """(series, terms + 1, terms + 1) from the sums per weekday; the last row and column are the value's."""
    n, v = len(sums), len(_SUMMED)
    per_day = np.zeros((n, WEEK, v, v))
    flat = sums.reshape(n, WEEK, len(_PAIRS))
    for at, (i, j) in enumerate(_PAIRS):
        per_day[:, :, i, j] = per_day[:, :, j, i] = flat[:, :, at]
    out = np.zeros((n, len(TERMS) + 1, len(TERMS) + 1))
    out[:, np.array(_AT)[:, None], _AT] = per_day.sum(axis=1)
    for d in range(1, WEEK):
        out[:, 1 + d, _AT] = out[:, _AT, 1 + d] = per_day[:, d, 0]
        out[:, 1 + d, 1 + d] = per_day[:, d, 0, 0]
    return out


def eliminate(m: np.ndarray, k: int, squares: np.ndarray, sound: np.ndarray):
    """Term ``k`` taken into the model of every series; not sound where earlier terms already give it."""
    sound = sound & (m[:, k, k] > ALIASED * squares[:, k])
    row = m[:, k, :] / np.where(sound, m[:, k, k], 1.0)[:, None]
    out = m - m[:, :, k, None] * row[:, None, :]
    out[:, k, :] = row
    return out, sound


def best_models(sums: np.ndarray, n_days: np.ndarray) -> dict[str, np.ndarray]:
    """The combination with the lowest AIC (to six decimals; then the one with fewer lags, no drift,
    no weekdays). ``aic`` is NaN for a series too short for any."""
    whole = normal_equations(sums)
    squares, rows, target = np.einsum("bii->bi", whole).copy(), n_days - MAX_P, len(TERMS)
    fits = []
    for drift in (False, True):
        for seasonal in (False, True):
            m, sound = eliminate(whole, 0, squares, rows >= 4)
            taken = [0] + [1] * drift + list(range(2, 1 + WEEK)) * seasonal
            for k in taken[1:]:
                m, sound = eliminate(m, k, squares, sound)
            for p in range(MAX_P + 1):
                if p:
                    taken = taken + [WEEK + p]
                    m, sound = eliminate(m, WEEK + p, squares, sound)
                k = len(taken)
                sse = np.maximum(m[:, target, target], squares[:, target] * 1e-12)
                usable = sound & (rows >= k + 3)
                per_row = np.maximum(sse / np.maximum(rows, 1) / UNIT ** 2, 1e-9)
                aic = np.where(usable, rows * np.log(per_row) + 2 * (k + 1), np.nan)
                beta = np.zeros((len(whole), target))
                beta[:, taken] = m[:, taken, target]
                sigma = np.sqrt(sse / np.maximum(rows - k, 1)) / UNIT
                fits.append((p, drift, seasonal, aic, beta, sigma))
    fits.sort(key=lambda f: f[:3])
    aics = np.stack([f[3] for f in fits])
    pick = np.argmin(np.where(np.isnan(aics), np.inf, np.round(aics, 6)), axis=0)
    at = np.arange(len(whole))
    return {"p": np.array([f[0] for f in fits])[pick], "drift": np.array([f[1] for f in fits])[pick],
            "seasonal": np.array([f[2] for f in fits])[pick], "aic": aics[pick, at],
            "beta": np.stack([f[4] for f in fits])[pick, at], "sigma": np.stack([f[5] for f in fits])[pick, at]}


def predict(beta: np.ndarray, sigma: np.ndarray, history: np.ndarray, n_days: np.ndarray, first_dow: np.ndarray, horizon: int):
    """Values and bounds of the next days, all series a step at a time."""
    n = len(beta)
    weekday = np.concatenate([np.zeros((n, 1)), beta[:, 2:1 + WEEK]], axis=1)
    phi, past = beta[:, 1 + WEEK:], [history[:, i] for i in range(MAX_P)]
    weights, spread, out = [np.ones(n)] + [np.zeros(n)] * (MAX_P - 1), np.zeros(n), []
    for h in range(horizon):
        t = n_days + h
        v = beta[:, 0] + beta[:, 1] * t + weekday[np.arange(n), (first_dow + t) % WEEK]
        for i in range(MAX_P):
            v = v + phi[:, i] * past[i]
        spread = spread + weights[0] * weights[0]
        half = Z80 * sigma * np.sqrt(spread)
        following = phi[:, 0] * weights[0]
        for i in range(1, MAX_P):
            following = following + phi[:, i] * weights[i]
        past, weights = [v, *past[:-1]], [following, *weights[:-1]]
        out.append([np.maximum(v / UNIT, 0.0), np.maximum(v / UNIT - half, 0.0), np.maximum(v / UNIT + half, 0.0)])
    return np.array(out).transpose(1, 2, 0)


def fit_models(training: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Every series fitted on its own. A series too short for any model (under seven days) has its
    mean as forecast, and null for AIC, sigma and coefficients. ``coefficients`` follow TERMS,
    trend per day since the first; 0 where the chosen model lacks the term."""
    def solve(batches):
        for b in batches:
            if b.empty:
                continue
            days, first = b["n_days"].to_numpy(), b["first_dow"].to_numpy()
            fit = best_models(np.stack(b["sums"].to_numpy()), days)
            short = np.isnan(fit["aic"])
            ahead = predict(fit["beta"], fit["sigma"], np.stack(b["history"].to_numpy()), days, first, horizon)
            ahead[:, short, :] = (b["mean"].to_numpy() / UNIT)[short][None, :, None]
            coefficients = fit["beta"] / np.array([UNIT] * (1 + WEEK) + [1.0] * MAX_P)
            orders = np.where(short, 0, fit["p"]).astype("int32")
            yield pd.DataFrame({
                **{c: b[c] for c in PAIR}, "n_days": days, "p": orders, "drift": fit["drift"] & ~short,
                "seasonal": fit["seasonal"] & ~short, "aic": [None if s else a for s, a in zip(short, fit["aic"])],
                "sigma": [None if s else a for s, a in zip(short, fit["sigma"])], "last_day": b["last_day"],
                "value": list(ahead[0]), "lower": list(ahead[1]), "upper": list(ahead[2]),
                "coefficients": [None if s else c for s, c in zip(short, coefficients)]}, columns=COLUMNS)

    return series_sums(training).mapInPandas(solve, MODEL)


def model_terms(models: DataFrame) -> DataFrame:
    """The chosen model of each series with its coefficients as columns."""
    at = lambda i: rnd(F.get("coefficients", F.lit(i)), 4)
    return models.select(*PAIR, "n_days", "p", "drift", "seasonal", rnd("aic", 4).alias("aic"), rnd("sigma", 4).alias("sigma"),
                         *[at(i).alias(t) for i, t in enumerate(TERMS)])


def forecast_rows(models: DataFrame) -> DataFrame:
    """(series, day, value, lower, upper), the day after the series' last one first."""
    rows = models.select(*PAIR, "last_day", F.posexplode(F.arrays_zip("value", "lower", "upper")).alias("h", "f"))
    return rows.select(*PAIR, F.date_add("last_day", F.col("h") + 1).alias("day"), rnd("f.value", 4).alias("value"),
                       rnd("f.lower", 4).alias("lower"), rnd("f.upper", 4).alias("upper"))


def model_evaluate(models: DataFrame) -> DataFrame:
    return models.agg(
        F.count("*").alias("series"), F.count_if(F.col("seasonal")).alias("seasonal"),
        share(F.count_if(F.col("seasonal")), F.count("*")).alias("seasonal_pct"),
        F.count_if(F.col("drift")).alias("with_drift"), F.count_distinct("p").alias("distinct_orders"),
        rnd(mean4("aic"), 1).alias("mean_aic"))


def model_orders(models: DataFrame, top: int | None = None) -> DataFrame:
    name = F.format_string("(%d,0,0)", "p")
    return (models.groupBy(name.alias("model_order"), F.when(F.col("seasonal"), "Weekly").otherwise("None").alias("seasonality"))
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model_order", "seasonality").transform(upto, top))
