"""Order statistics, regions, nearest cells, spectra and components against plain reckoning."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import align, linop, metrics, selection, spectra
from tidewheel.plans import extended
from tidewheel.sources import regions

SF = "/root/testdata/sf0.01"


def test_ranks_over_many_ranges(spark, monkeypatch):
    """A key with nine in ten rows, many ties, missing values; also where the wanted rows are joined by a shuffle."""
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.integers(0, 400, 9000)] + [(f"k{k % 7}", float(v)) for k, v in enumerate(rng.normal(size=900))] + [("hot", None), ("none", None), ("one", 5.0), (None, 2.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "key string, value double").repartition(5)
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    wanted = [(k, r) for k in by for r in {1, 2, len(by[k]) // 2 + 1, len(by[k]), len(by[k]) + 1}]
    for most in (selection.BROADCAST_ROWS, 0):
        monkeypatch.setattr(selection, "BROADCAST_ROWS", most)
        dealt = selection.dealt(df, ["key"])
        got = {(r["key"], r["rank"]): r["value"] for r in dealt.at_ranks(spark.createDataFrame([w for w in wanted if w[0] is not None], "key string, rank long")).collect()}
        assert got == {(k, r): sorted(by[k])[r - 1] for k, r in wanted if k is not None and r <= len(by[k])}
    # the hot key's rows are in several ranges, none of which has half of them
    parts = [r["n"] for r in dealt.pieces().where("key = 'hot'").collect()]
    assert sum(parts) == 9000 and max(parts) < 4500
    found = {(r["key"], r["probability"]): r["quantile"] for r in metrics.pooled_quantiles(df.where("key is not null"), ["key"], [0.1, 0.5, 1]).collect()}
    for k, v in by.items():
        if k is not None:
            assert [found[k, p] for p in (0.1, 0.5, 1.0)] == pytest.approx(np.quantile(v, [0.1, 0.5, 1]).tolist())
    plain = {tuple(r) for r in metrics.return_levels(df.where("key is not null"), ["key"], [2, 50]).collect()}
    assert {tuple(r) for r in metrics.pooled_return_levels(df.where("key is not null"), ["key"], [2, 50]).collect()} == plain


def test_no_window_has_a_whole_pooled_key(spark):
    plan = metrics.pooled_return_levels(extended.pooled_orders(spark, SF), ["region"], [3])._jdf.queryExecution().toString()
    assert "row_number" not in plan


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def test_regions_from_geojson(spark, tmp_path):
    """Polygons, several polygons with a hole, a closed ring, a feature without a name."""
    square = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]
    hole, far = [[2.0, 2.0], [8.0, 2.0], [8.0, 8.0], [2.0, 8.0]], [[20.0, -30.0], [30.0, -5.0], [25.0, 12.0]]
    shapes = [("a", "Polygon", [[*square, square[0]]]), ("b", "MultiPolygon", [[square, hole], [far]]), (None, "Polygon", [far])]
    made = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": n} if n else {}, "geometry": {"type": t, "coordinates": c}} for n, t, c in shapes]}
    (tmp_path / "x.json").write_text(json.dumps(made))
    found = regions.edges(regions.features(spark, str(tmp_path / "x.json")), 360.0)
    cells = [(k, 360.0 + (k * 7 % 330) / 10, -35.0 + (k * 13 % 500) / 10) for k in range(2000)] + [(5000, None, 1.0), (5001, 361.0, None)]
    got = {tuple(r) for r in regions.cells_in(spark.createDataFrame(cells, "cell long, lon double, lat double"), found).collect()}
    rings = {"a": [square], "b": [square, hole, far], "2": [far]}
    want = {(name, k) for name, own in rings.items() for k, x, y in cells if x is not None and y is not None and inside([[(a + 360, b) for a, b in ring] for ring in own], x, y)}
    assert got == want and len({n for n, _ in got}) == 3 and ("b", 5000) not in got


def test_nearest_cells_of_many_points(spark):
    rng = np.random.default_rng(2)
    lats, lons = sorted({-80.0, -79.5, -10.0, 0.0, 3.0, 90.0}), [0.0, 2.5, 5.0, 300.0]
    cells = [(i * 10 + j, a, b) for i, a in enumerate(lats) for j, b in enumerate(lons)]
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-95, 95, 300), rng.uniform(-20, 380, 300)))] + [(900, -5.0, 3.75), (901, 1.5, 1.25), (902, None, 1.0), (903, 2.0, None), (904, -5.0, 3.75)]
    got = {r["point"]: r["cell"] for r in align.nearest_cells(spark.createDataFrame(points, "point long, lat double, lon double"), spark.createDataFrame(cells, "cell long, lat double, lon double")).collect()}
    near = lambda axis, v: min(axis, key=lambda x: (abs(x - v), x))
    want = {k: None if a is None or b is None else next(c for c, x, y in cells if (x, y) == (near(lats, a), near(lons, b))) for k, a, b in points}
    assert got == want
    assert align.nearest_cells(spark.createDataFrame(points, "point long, lat double, lon double"), spark.createDataFrame([], "cell long, lat double, lon double")).where("cell is not null").count() == 0


@pytest.mark.parametrize("n, nw, k", [(5, 1.5, 2), (72, 3.0, 5), (240, 4.0, 7), (1176, 3.0, 5)])
def test_tapers_equal_dense_eigenvectors(n, nw, k):
    v, c = spectra.tapers(n, nw, k)
    t, half = np.arange(n), nw / n
    dense = np.diag(((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * half)) + np.diag(t[1:] * (n - t[1:]) / 2, 1) + np.diag(t[1:] * (n - t[1:]) / 2, -1)
    want = np.linalg.eigh(dense)[1][:, ::-1][:, :k]
    assert np.abs((v * want).sum(axis=0)) == pytest.approx(np.ones(k), abs=1e-9)
    a = 2 * half * np.sinc(2 * half * (t[:, None] - t[None, :]))
    assert c == pytest.approx(np.einsum("ik,ij,jk->k", want, a, want), abs=1e-9)


def test_spectra_of_batches_equal_single_ones(spark):
    rng = np.random.default_rng(4)
    series = {c: rng.normal(size=60 if c % 3 else 72).cumsum() for c in range(20)}
    rows = spark.createDataFrame([(c, t, float(v)) for c, x in series.items() for t, v in enumerate(x)], "cell long, t int, value double").repartition(3)
    got = spectra.spectra(rows, {"cell": "bigint"}, 1 / 12).toPandas()
    for c, x in series.items():
        one = spectra.multitaper(x, 1 / 12)
        own = got[got.cell == c].sort_values("k")
        for name in ("frequency", "power", "upper", "lower"):
            assert own[name].to_numpy() == pytest.approx(one[name], rel=1e-9)


def test_masked_components_by_phase(spark):
    """Patterns and series as from singular vectors of the masked, weighted departures, filtered phase by phase."""
    rng = np.random.default_rng(5)
    steps, phases, cells = 12 * 20, 12, 9
    slow = np.repeat(np.linspace(-1, 1, 20), 12)
    x = slow[:, None] * rng.normal(size=cells) * 2 + rng.normal(size=(steps, cells))
    w = rng.uniform(0.5, 1, cells)
    keep = [0, 2, 3, 4, 6, 7, 8]
    rows = spark.createDataFrame([("m", c, t, float(w[c]), float(x[t, c])) for c in range(cells) for t in range(steps)], "member string, cell int, t int, weight double, value double")
    mask = spark.createDataFrame([(c,) for c in keep], "cell int")
    patterns, series = spectra.low_frequency_components(rows, ["member"], steps, 5, 2, 0.1, phases=phases, mask=mask)
    own = (x - x.mean(axis=0))[:, keep]
    u, s, vt = np.linalg.svd(own * w[keep], full_matrices=False)
    a, sigma = vt[:5], s[:5] / np.sqrt(steps - 1)
    smooth = np.empty_like(own)
    for k in range(phases):
        smooth[k::phases] = linop.zero_phase(own[k::phases], 3, 0.2, padding="even")
    tilde = smooth @ a.T / sigma
    values, e = np.linalg.eigh(tilde.T @ tilde)
    e = e[:, ::-1][:, :2]
    want_series, want_patterns = own @ (a.T / sigma) @ e, (a.T * sigma) @ e
    got_series = np.array([[r["value"] for r in series.where(f"component = {c}").orderBy("t").collect()] for c in range(2)]).T
    got_patterns = {(r["component"], r["cell"]): r["pattern"] for r in patterns.collect()}
    assert {c for _, c in got_patterns} == set(keep)
    for c in range(2):
        sign = np.sign(got_series[:, c] @ want_series[:, c])
        assert got_series[:, c] == pytest.approx(sign * want_series[:, c], abs=1e-6)
        assert [got_patterns[c, k] for k in keep] == pytest.approx((sign * want_patterns[:, c]).tolist(), abs=1e-6)
        assert got_series[-5:, c].mean() >= got_series[:5, c].mean()


def test_spectra_of_modes_lie_in_their_range(spark):
    got = extended.mode_spectra_with_range(spark, SF).toPandas()
    assert (got.power_low < got.power).all() and (got.power < got.power_high).all() and (got.surrogate_low <= got.surrogate_high).all()
    assert extended.cell_spectra(spark, SF).agg(F.countDistinct("cell")).first()[0] == 25
