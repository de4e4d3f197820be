"""Hand-computed cases and properties of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import timeaxis, units
from tidewheel.operators import align, ensemble, linop, metrics, normalize, regress, spectra


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_calendar(spark):
    months = spark.createDataFrame([(m,) for m in range(1, 13)], "m int").select("m", timeaxis.season(F.col("m")).alias("s")).collect()
    assert {r["m"]: r["s"] for r in months} == {m: "DJF" if m in (12, 1, 2) else "MAM" if m < 6 else "JJA" if m < 9 else "SON" for m in range(1, 13)}
    assert one(spark, *timeaxis.from_decimal_year(F.lit(1850.041667)), *timeaxis.from_decimal_year(F.lit(1850.958333))) == (1850, 1, 1850, 12)
    assert one(spark, *timeaxis.from_counter(F.lit(11)), *timeaxis.from_counter(F.lit(12))) == (1920, 12, 1921, 1)
    assert str(one(spark, timeaxis.quarter_label(F.lit("1921-02-01").cast("date")))[0]) == "1920-12-01"


def test_units(spark):
    rows = spark.createDataFrame([(62.0, "mm/month", "2001-01-05"), (1e-8, "m/s", "2001-01-05"), (300.0, "K", "2001-01-05"), (5.0, "Pa", "2001-01-05")], "v double, u string, d string").withColumn("d", F.col("d").cast("date"))
    assert [round(r[0], 6) for r in rows.select(units.converted(F.col("v"), F.col("u"), F.col("d"))).collect()] == [2, 0.864, 26.85, 5]
    assert one(spark, units.converted(F.lit(1e-8), F.lit("m/s"), F.lit("2001-01-05").cast("date"), True))[0] == pytest.approx(26.784)
    with pytest.raises(Exception, match="unknown unit"):
        spark.range(1).select(units.converted(F.lit(1.0), F.lit("furlong"), F.lit("2001-01-05").cast("date"))).collect()


def test_lagged(spark):
    rows = spark.createDataFrame([(t, t, 10.0 * t) for t in range(1, 5)], "t int, month int, enso double")
    assert [tuple(r) for r in align.lagged(rows, 1, ["month"]).orderBy("t").select("month", "enso").collect()] == [(2, 10), (3, 20), (4, 30)]


def test_orthogonalised(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 0.0), (2, 3.0, 1.0)], "t int, pdo double, enso double")
    assert [r["o"] for r in regress.orthogonalised(rows, "pdo", "enso", "o").orderBy("t").collect()] == [-1, 2, 1]


def test_spread_and_levels(spark):
    rows = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 4.0, 8.0, None)], "k int, value double")
    assert metrics.spread(rows, ["k"]).first()["iq_range"] == 3.25
    ranks = lambda n: one(spark, *[metrics.recurrence_rank(F.lit(n), F.lit(y)) for y in (33, 55, 150, 300, 500)])
    assert ranks(85) == (3, 2, 1, 1, 1)
    assert ranks(3400) == (103, 62, 23, 12, 7)
    many = spark.createDataFrame([(1, float(v)) for v in range(85)], "k int, value double")
    assert {r["return_period"]: r["level"] for r in metrics.return_levels(many, ["k"], [33, 55, 500]).collect()} == {33: 82, 55: 83, 500: 84}


def test_recurrence_rank_is_the_nearest_interval(spark):
    for n in (1, 2, 5, 30, 98):
        for years in (1, 3, 33, 150):
            best = min(range(1, n + 1), key=lambda k: (abs((n + 0.12) / (k - 0.44) - years), k))
            assert one(spark, metrics.recurrence_rank(F.lit(n), F.lit(years)))[0] == best


def test_block_length(spark):
    got = one(spark, *[ensemble.block_length(F.lit(98), F.lit(x).cast("double")) for x in (-0.5, 0.0, 0.1, 0.3, 0.6, 0.9, None)])
    assert got == (0, 1, 1, 4, 9, 16, 9)


def test_boxcox(spark):
    assert one(spark, normalize.forward(F.lit(4.0), F.lit(0.5)), normalize.inverse(F.lit(2.0), F.lit(0.5)), normalize.inverse(F.lit(-3.0), F.lit(0.4)), normalize.inverse(F.lit(-3.0), F.lit(0.5))) == (2, 4, 0, 0.25)
    rng = np.random.default_rng(0)
    x = rng.gamma(2, 3, 60)
    found = normalize.best_exponents(spark.createDataFrame([(1, float(v)) for v in x], "k int, value double"), ["k"], refine=2).first()["lam"]
    llf = lambda g: (g - 1) * np.log(x).sum() - len(x) / 2 * np.log(((x**g - 1) / g).var())
    assert llf(found) >= max(llf(g) for g in np.arange(0.001, 1, 0.001)) - 1e-6


def test_hann():
    assert linop.hann_weights(4) == pytest.approx([0, 0.25, 0.5, 0.25, 0])


def test_hann_keeps_whole_windows(spark):
    rows = spark.createDataFrame([(t, float(t)) for t in range(96)], "t int, value double")
    got = linop.hann_smoothed(rows, 21).orderBy("t").collect()
    assert len(got) == 76 and all(r["smooth"] == pytest.approx(r["t"]) for r in got)


def test_butterworth():
    b = a = np.ones(1)
    for own in linop.butterworth(3, 0.2):
        b, a = np.polymul(b, own[0]), np.polymul(a, own[1])
    assert b[:4] == pytest.approx([0.01809893, 0.0542968, 0.0542968, 0.01809893], abs=1e-7)
    assert a[:4] == pytest.approx([1, -1.76004188, 1.18289326, -0.27805992], abs=1e-7)
    assert linop.zero_phase(np.full(40, 3.0), 3, 0.2) == pytest.approx(np.full(40, 3.0))
    assert linop.zero_phase(np.full(40, 3.0), 3, 0.2, "high") == pytest.approx(np.zeros(40), abs=1e-9)
    slow = np.sin(2 * np.pi * np.arange(85) / 40)
    low = linop.filter_matrix(85, 3, 0.2, reflect=True) @ slow
    high = linop.filter_matrix(85, 3, 0.2, "high", reflect=True) @ slow
    assert low[5:-5].var() / slow[5:-5].var() == pytest.approx(1, abs=0.02) and high[5:-5].var() < 1e-3
    with pytest.raises(ValueError, match="too short"):
        linop.zero_phase(np.ones(12), 3, 0.2)


def test_harmonics():
    row = linop.harmonic_matrix()[0]
    assert row == pytest.approx([0.416667, 0.316814, 0.097117, -0.078011, -0.087299, 0.016666, 0.083167, 0.025545, -0.08122, -0.085429, 0.078381, 0.307245], abs=1e-6)


def test_regression_recovers_its_coefficients(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(96, 2))
    drivers = spark.createDataFrame([(t, t % 12 + 1, float(x[t, 0]), float(x[t, 1])) for t in range(96)], "t int, month int, a double, b double")
    series = spark.createDataFrame([(c, t, t % 12 + 1, None if (c, t) == (1, 14) else 2.0 + c * float(x[t, 0]) - 3 * float(x[t, 1])) for c in (0, 1, 2) for t in range(96)], "cell int, t int, month int, value double")
    fit = regress.monthly_fit(series, regress.hat_table(drivers, ["constant", "a", "b"])).collect()
    for r in fit:
        want = {"constant": 2.0, "a": float(r["cell"]), "b": -3.0}[r["predictor"]]
        assert r["beta"] is None if (r["cell"], r["month"]) == (1, 3) else r["beta"] == pytest.approx(want)
    smooth = regress.smoothed(spark.createDataFrame(fit)).where("cell = 1").collect()
    assert len(smooth) == 36 and all(r["beta"] is None for r in smooth)
    with pytest.raises(ValueError, match="dependent"):
        regress.hat_table(drivers.withColumn("b", F.col("a") * 2), ["constant", "a", "b"])


def test_through_origin(spark):
    series = spark.createDataFrame([(1, 0, 2.0), (1, 1, 5.0)], "cell int, t int, value double")
    assert regress.through_origin(series, spark.createDataFrame([(0, 1.0), (1, 2.0)], "t int, x double"), "x", ["cell"]).first()["slope"] == 2.4


def test_bootstrap(spark):
    starts = spark.createDataFrame([(0, 0, 24), (0, 1, 0)], "member int, block int, start int")
    got = [r["from_t"] for r in ensemble.resampling(starts, 36, 24).orderBy("t").collect()]
    assert got == [*range(24, 36), *range(12), *range(12)]
    assert [r["start"] for r in ensemble.seeded_starts(spark, 1, 72, 24).orderBy("block").collect()] == [60, 24, 48]
    drawn = ensemble.hashed_starts(spark, 5, 72, 24).collect()
    assert len(drawn) == 15 and all(r["start"] % 12 == 0 and r["start"] < 72 for r in drawn)


def test_weighted_mean(spark):
    rows = spark.createDataFrame([(1, 0.0, 2.0), (1, 60.0, None)], "k int, lat double, value double")
    w = align.cos_weight(F.col("lat"))
    assert align.weighted_mean(rows, ["k"], "value", w).first()["mean"] == pytest.approx(2 / 1.5)
    assert align.weighted_mean(rows, ["k"], "value", w, True).first()["mean"] == pytest.approx(2)


def test_polygon(spark):
    cells = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (-0.1, 0.2)], "lon double, lat double")
    inside = cells.where(align.in_polygon(cells, [(-360.0, 0.0), (-359.0, 0.0), (-359.0, 1.0), (-360.0, 1.0)], 360.0)).collect()
    assert [tuple(r) for r in inside] == [(0.5, 0.5)]


def test_surrogates_keep_values_and_spectrum(spark):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.normal(size=240))
    found = spectra.surrogate(x, rng)
    assert np.sort(found) == pytest.approx(np.sort(x))
    assert np.corrcoef(np.abs(np.fft.fft(found - found.mean())), np.abs(np.fft.fft(x - x.mean())))[0, 1] > 0.99
    seasonal = spectra.surrogate(x, rng, 12)
    assert [seasonal[k::12].std() for k in range(12)] == pytest.approx([(x - x.mean())[k::12].std() for k in range(12)])
    rows = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "mode string, t int, value double")
    first = sorted(map(tuple, spectra.surrogates(rows, 3).collect()))
    assert first == sorted(map(tuple, spectra.surrogates(rows.repartition(5), 3).collect()))
    assert len({v for m, _, t, v in first if t == 0}) > 1


def test_multitaper():
    v, c = spectra.tapers(240, 3, 5)
    assert c == pytest.approx([0.9999999, 0.99999, 0.99972, 0.99492, 0.94617], abs=1e-5)
    assert v.T @ v == pytest.approx(np.eye(5), abs=1e-10)
    t = np.arange(480)
    wave = np.sin(2 * np.pi * 0.1 * t) + np.random.default_rng(6).normal(0, 0.1, 480)
    found = spectra.multitaper(wave)
    assert found["frequency"][np.argmax(found["power"])] == pytest.approx(0.1, abs=0.01)
    assert np.all(found["upper"] > 1) and np.all(found["lower"] < 1)
    noise = np.random.default_rng(7).normal(size=1000)
    assert spectra.multitaper(noise)["power"].mean() == pytest.approx(noise.var(), rel=0.1)


def test_components_find_a_slow_pattern(spark):
    rng = np.random.default_rng(8)
    slow = np.linspace(-1, 1, 60) + 0.1 * np.sin(np.arange(60) / 9)
    pattern = rng.normal(size=12)
    x = 2 * slow[:, None] * pattern[None, :] + rng.normal(0, 1, (60, 12))
    rows = [("m", c, t, 1.0, float(x[t, c])) for c in range(12) for t in range(60)] + [("m", 99, 0, 1.0, None)]
    patterns, series = spectra.low_frequency_components(spark.createDataFrame(rows, "member string, cell int, t int, weight double, value double"), ["member"], 60, 8, 2, 0.05)
    first = np.array([r["value"] for r in series.where("component = 0").orderBy("t").collect()])
    assert np.corrcoef(first, slow)[0, 1] > 0.9
    own = np.array([r["pattern"] for r in patterns.where("component = 0").orderBy("cell").collect()])
    assert len(own) == 12 and np.corrcoef(own, pattern)[0, 1] > 0.9


def test_members_add_up(spark):
    noise = spark.createDataFrame([(0, 0, t, 0.5 * t) for t in range(12)], "cell int, member int, t int, noise double")
    fit = spark.createDataFrame([(0, m, p, b) for m in range(1, 13) for p, b in (("constant", 1.0), ("a", 2.0))], "cell int, month int, predictor string, beta double")
    modes = spark.createDataFrame([(0, t, t + 1, float(t % 3)) for t in range(12)], "member int, t int, month int, a double")
    got = {r["t"]: r["value"] for r in ensemble.members(noise, fit, modes, ["a"]).collect()}
    assert got == {t: 1 + 0.5 * t + 2 * (t % 3) for t in range(12)}
    scaled = ensemble.rescaled(modes, ["a"]).agg(F.stddev_pop("a")).first()[0]
    assert math.isclose(scaled, 1)
