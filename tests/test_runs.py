"""Files as sources, and runs from a cube to stored members."""

import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import timeaxis
from tidewheel.operators import align, ensemble, linop, metrics, normalize, spectra
from tidewheel.plans import products, runs
from tidewheel.sources import files, regions, store


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return str(path)


def test_files_along_time(spark, tmp_path):
    late = write(spark, [(1, 3, 30.0), (1, 2, 21.0)], "cell int, ts int, value double", tmp_path / "late")
    early = write(spark, [(1, 1, 10.0), (1, 2, 20.0)], "cell int, ts int, value double", tmp_path / "early")
    rows = lambda paths: [tuple(r) for r in files.along_time(spark, paths, keys=["cell"]).orderBy("ts").collect()]
    assert rows([late, early]) == [(1, 1, 10.0), (1, 2, 20.0), (1, 3, 30.0)]
    assert rows([early, late])[1] == (1, 2, 21.0)


def test_members_by_path(spark, tmp_path):
    for m in (1, 12):
        write(spark, [(m, 1.0)], "own int, value double", tmp_path / f"run_member_{m:03d}.parquet")
    write(spark, [(9, 9.0)], "own int, value double", tmp_path / "other.parquet")
    (tmp_path / "notes.txt").write_text("no table")
    got = files.matching(spark, str(tmp_path), "part-*.parquet", r"member_(\d+)").where("member is not null").collect()
    assert sorted((r["own"], r["member"]) for r in got) == [(1, 1), (12, 12)]


def test_merged_keeps_all_coordinates(spark):
    a = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "cell int, t int, value double")
    b = spark.createDataFrame([(1, 1, 5.0), (2, 0, 6.0)], "cell int, t int, value double")
    got = {(r["cell"], r["t"]): (r["a"], r["b"]) for r in files.merged({"a": a, "b": b}, ["cell", "t"]).collect()}
    assert got == {(1, 0): (1.0, None), (1, 1): (2.0, 5.0), (2, 0): (None, 6.0)}


def test_polygon_and_archive_and_units(spark, tmp_path):
    ring = [[-110.0, 35.0], [-105.0, 35.0], [-105.0, 40.0], [-110.0, 35.0]]
    (tmp_path / "r.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring]}}]}, indent=1))
    assert files.polygon(spark, str(tmp_path / "r.json")) == [(250.0, 35.0), (255.0, 35.0), (255.0, 40.0)]
    paths = [write(spark, [(t, n, float(n)) for t in range(2) for n in range(3)], "t int, n int, enso double", tmp_path / f"a{k}") for k in range(2)]
    assert sorted({r["member"] for r in files.surrogate_archive(spark, paths, 3).collect()}) == list(range(6))
    rows = files.with_unit(spark.createDataFrame([(1.0,)], "v double"), "v", "K")
    assert files.unit_of(rows, "v") == "K"
    with pytest.raises(ValueError, match="unit"):
        files.unit_of(rows.select((F.col("v") * 2).alias("v")), "v")


def test_partial_dates_and_halves(spark):
    days = spark.createDataFrame([("1996-02-29",), ("1996-03-01",), ("1997-12-31",), ("1998-01-01",)], "d string").withColumn("d", F.col("d").cast("date"))
    assert [r[0] for r in days.select(timeaxis.within(F.col("d"), "1996-03", "1997")).collect()] == [False, True, True, False]
    assert [r[0] for r in days.select(timeaxis.within(F.col("d"), "1996", "1996-02")).collect()] == [True, False, False, False]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(timeaxis.rounded(F.col("x")))
    assert [float(r[0]) for r in halves.collect()] == [0, 2, 2]


def test_heads_aliases_and_ids(spark):
    rows = spark.createDataFrame([(1, t, t % 12 + 1) for t in range(30)], "cell int, t int, month int")
    head = align.from_first(rows, F.col("month") == 4, 5, by=["cell"]).orderBy("t").collect()
    assert [(r["t"], r["month"]) for r in head] == [(k, 4 + k) for k in range(5)]
    named = spark.createDataFrame([(3.0,)], "latitude double")
    assert named.select(align.first_of(named, "lat", "latitude")).columns == ["latitude"]
    assert ensemble.member_ids((1, 35), (101, 105)) == [*range(1, 36), *range(101, 106)]
    assert [r[0] for r in align.in_order(rows, "month", "t").select("month").limit(3).collect()] == [1, 1, 1]


def test_transforms_by_name(spark):
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 0.0), (2, 1, None)], "cell int, month int, value double")
    lam = spark.createDataFrame([(c, m, 0.5) for c in (1, 2) for m in (1, 2)], "cell int, month int, lam double")
    for name, exponents in (("boxcox", lam), ("log", None)):
        there = normalize.transform(rows, exponents, ["cell", "month"], name)
        back = normalize.transform(there, exponents, ["cell", "month"], name, back=True, mask=rows.where("value is not null").select("cell"))
        got = {(r["cell"], r["month"]): r["value"] for r in back.collect()}
        assert got[1, 1] == pytest.approx(2.0) and abs(got[1, 2]) < 1e-6 and got[2, 1] is None
    with pytest.raises(NotImplementedError):
        normalize.transform(rows, lam, ["cell", "month"], "cube")
    with pytest.raises(ValueError, match="no metric"):
        metrics.named(rows, ["cell"], ["median"])


def test_filter_equals_its_recursion():
    """Against the published coefficients of order 3 at 0.2, run as one polynomial over the odd extension."""
    b, a = [0.01809893, 0.0542968, 0.0542968, 0.01809893], [1, -1.76004188, 1.18289326, -0.27805992]
    x = np.cumsum(np.random.default_rng(3).normal(size=90))
    pad = 12
    long = [2 * x[0] - x[k] for k in range(pad, 0, -1)] + list(x) + [2 * x[-1] - x[-1 - k] for k in range(1, pad + 1)]

    def once(v):
        out = []
        past_in, past_out = [v[0]] * 3, [v[0]] * 3
        for now in v:
            y = b[0] * now + sum(c * p for c, p in zip(b[1:], past_in)) - sum(c * p for c, p in zip(a[1:], past_out))
            past_in, past_out = [now, *past_in[:2]], [y, *past_out[:2]]
            out.append(y)
        return out

    want = once(once(long)[::-1])[::-1][pad:-pad]
    assert linop.zero_phase(x, 3, 0.2) == pytest.approx(np.array(want), abs=2e-5)


def test_filtered_cells_equal_the_weight_table(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(c, t, None if (c, t) == (2, 5) else float(rng.normal())) for c in range(3) for t in range(40)], "cell int, t int, value double")
    matrix = linop.filter_matrix(40, 3, 0.2, reflect=True)
    one = {(r["cell"], r["t"]): r["filtered"] for r in linop.filtered(rows, matrix, ["cell"], first=5, last=34).collect()}
    other = {(r["cell"], r["t"]): r["filtered"] for r in linop.applied(rows, linop.weight_table(spark, matrix), ["cell"], steps=40).where("t between 5 and 34").collect()}
    assert one.keys() == other.keys() and all(v is None if c == 2 else v == pytest.approx(other[c, t]) for (c, t), v in one.items())


@pytest.mark.parametrize("kind", ["string", "int", "date"])
def test_step_products_are_matrix_products(spark, kind):
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(7, 4)), rng.uniform(0.2, 1, 7)
    names = {"string": ("g", "h"), "int": (3, 4), "date": (date(2001, 1, 1), date(2001, 2, 1))}[kind]
    rows = spark.createDataFrame([(names[k >= 5], k, float(w[k]), x[k].tolist()) for k in range(7)], f"member {kind}, cell int, weight double, x array<double>").repartition(3)
    got = spectra.step_products(rows, ["member"], 4)
    assert got.schema["member"].dataType == rows.schema["member"].dataType
    got = got.collect()
    for name, at in ((names[0], slice(0, 5)), (names[1], slice(5, 7))):
        own = sorted((r["i"], r["mixed"], r["gram"]) for r in got if r["member"] == name)
        assert np.array([r[1] for r in own]) == pytest.approx(x[at].T @ (x[at] * w[at, None]))
        assert np.array([r[2] for r in own]) == pytest.approx((x[at] * w[at, None]).T @ (x[at] * w[at, None]))


def test_low_passed_surrogates(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(0, m, t, float(rng.normal())) for m in ("amo", "enso") for t in range(72)], "member int, mode string, t int, value double")
    got = spectra.low_passed(rows, ["amo"], 72, 0.05).toPandas().sort_values("t")
    before = rows.toPandas().sort_values("t")
    series = lambda df, m: df[df["mode"] == m]["value"].to_numpy()
    assert series(got, "enso") == pytest.approx(series(before, "enso"))
    assert series(got, "amo") == pytest.approx(linop.zero_phase(series(before, "amo"), 3, 0.1))


SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("case", ["orders", "orders_transformed"])
def test_run(spark, tmp_path, case):
    got = runs.run(spark, SF, case, str(tmp_path))
    p = runs.parameters(case)
    assert got.count() == 2 * p.members * 25 * 72
    assert {(r["variable"], r["kind"], r["member"]) for r in got.select("variable", "kind", "member").distinct().collect()} == {("order_value", k, m) for k in ("full", "noise") for m in range(p.members)}
    assert json.loads(spark.read.text(str(tmp_path / f"parameters-{case}")).first()[0])["variables"][0]["name"] == "order_value"
    names = {x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir()}
    assert {"original", "beta", "fitted", "climatology", "surrogates", "block-lengths", "members"} <= names
    # the middle of what was kept comes back, in the units of the input
    original = spark.read.parquet(next(str(x) for x in tmp_path.iterdir() if x.name.startswith("original")))
    # (exponents that differ between months can make single values very large)
    middle = [df.where("cell = 3").agg(F.percentile("value", F.lit(0.5))).first()[0] for df in (original, got.where("kind = 'noise'"))]
    assert middle[1] == pytest.approx(middle[0], rel=0.1)
    with pytest.raises(ValueError, match="no case"):
        runs.parameters("moon")


def test_joint_run(spark, tmp_path):
    """Two variables share their draws; what they share isn't made twice; the lag leaves out the first year."""
    stages, inputs = store.Stages(spark, str(tmp_path)), store.fingerprint(spark, f"{SF}/orders.parquet")
    p = runs.parameters("joint")
    members = runs.joint(spark, SF, p, stages, inputs).rows
    assert members.count() == 2 * 2 * p.members * 25 * 60
    # a residual of the same step is drawn for both variables
    fits = spark.read.parquet(next(str(x) for x in tmp_path.iterdir() if x.name.startswith("fitted")))
    assert {r["t"] for r in fits.select("t").distinct().collect()} == set(range(60))
    own = members.where("kind = 'noise' and variable = 'order_count' and cell = 4")
    counts = {(r["member"], r["t"]): r["value"] for r in own.collect()}
    logs = {(r["member"], r["t"]): r["value"] for r in members.where("kind = 'noise' and variable = 'order_value' and cell = 4").collect()}
    back = {v: {r["t"]: (r["fitted"], r["residual"]) for r in fits.where(f"variable = '{v}' and cell = 4").collect()} for v in ("order_count", "order_value")}
    from_t = {k: min(range(60), key=lambda s: abs(back["order_count"][k[1]][0] + back["order_count"][s][1] - v)) for k, v in counts.items()}
    for (m, t), v in logs.items():
        assert np.log(v) == pytest.approx(back["order_value"][t][0] + back["order_value"][from_t[m, t]][1], abs=1e-6)
    # the block is the largest over the variables
    lengths = spark.read.parquet(next(str(x) for x in tmp_path.iterdir() if x.name.startswith("block-lengths"))).where("abs(lat) > 30 or abs(lat) < 10").toPandas()
    block = 12 * max(1, max(int(np.quantile(g["length"], 0.97)) for _, g in lengths.groupby("variable")))
    jumps = [(from_t[0, t] - from_t[0, t - 1]) % 60 for t in range(1, 60)]
    assert all(j == 1 for k, j in enumerate(jumps, 1) if k % block)
    made = list(stages.made)
    runs.joint(spark, SF, p, stages, inputs)
    assert stages.made == made
    names = ["IQ_range", "max_val", "33yr_event", "var_low", "var_high"]
    metrics_kept = runs.metric_run(stages, runs.joint(spark, SF, p, stages, inputs), names, 60).rows
    # a cell that misses a month has no return level, but a row for each other metric
    empty = members.groupBy("variable", "kind", "cell").agg(F.count("value").alias("n")).where("n = 0").count()
    assert metrics_kept.count() == 2 * 2 * 25 * len(names) - empty


def test_products_of_a_run(spark, tmp_path):
    """All products are stored, kept and read back by their partitions."""
    stages, inputs = store.Stages(spark, str(tmp_path)), store.fingerprint(spark, f"{SF}/orders.parquet")
    members = runs.joint(spark, SF, runs.parameters("orders"), stages, inputs)
    cells = spark.createDataFrame([(c, -60.0 + 5 * c, 4.0 * c) for c in range(25)], "cell long, lat double, lon double")
    edges = regions.edges(spark.createDataFrame([("box", 0, k, x, y) for k, (x, y) in enumerate([(-1.0, -31.0), (50.0, -31.0), (50.0, 1.0), (-1.0, 1.0)])], "region string, ring int, seq int, lon double, lat double"))
    make = lambda: products.write_all(stages, members, cells, edges, 1995, 2000, ["IQ_range", "max_val", "33yr_event"], [5, 50])
    made = make()
    before = list(stages.made)
    assert {n: s.digest for n, s in make().items()} == {n: s.digest for n, s in made.items()} and stages.made == before
    assert made["seasons"].rows.count() == 2 * 4 * 25 * 4 * 6
    own = made["seasons"].rows.where("kind = 'full' and cell = 8 and season = 'DJF'").toPandas()
    assert set(own.season_year) == set(range(1995, 2001))
    level = made["extremes"].rows.where("kind = 'full' and cell = 8 and season = 'DJF' and return_period = 5").first()["level"]
    ranked = np.sort(own["value"].to_numpy())[::-1]
    span = (len(ranked) + 1 - 0.88) / (np.arange(1, len(ranked) + 1) - 0.44)
    assert level == pytest.approx(ranked[np.argmin(np.abs(span - 5))])
    assert made["metrics"].rows.where("metric = 'max_val' and kind = 'full' and cell = 8 and season = 'DJF'").first()["value"] == pytest.approx(own.groupby("member")["value"].max().mean())
    # cells 6 to 12 are in the box
    box = made["seasons"].rows.where("kind = 'noise' and member = 1 and season = 'JJA' and season_year = 1997 and cell between 6 and 12").toPandas()
    w = np.cos(np.radians(-60 + 5 * box.cell))
    assert made["regional"].rows.where("kind = 'noise' and member = 1 and season = 'JJA' and season_year = 1997").first()["mean"] == pytest.approx((w * box.value).sum() / w.sum())
    assert made["components"].rows.where("part = 'series'").count() == 4 * 3 * 72


def test_two_inputs_in_one_folder(spark, tmp_path):
    a = runs.run(spark, SF, "regions", str(tmp_path))
    b = runs.run(spark, "/root/testdata/sf0.001", "regions", str(tmp_path))
    again = runs.run(spark, SF, "regions", str(tmp_path))
    total = lambda df: df.agg(F.sum("value")).first()[0]
    assert total(a) == total(again) != total(b)


def test_exponents_are_those_of_the_first_member(spark, tmp_path):
    runs.run(spark, SF, "member_2", str(tmp_path))
    kept = spark.read.parquet(next(str(x) for x in tmp_path.iterdir() if x.name.startswith("exponents")))
    first = runs.source(spark, SF, "member_value", 1).withColumn("variable", F.lit("member_value"))
    want = {(r["cell"], r["month"]): r["lam"] for r in normalize.best_exponents(first, ["variable", "cell", "month"], refine=2).collect()}
    assert {(r["cell"], r["month"]): r["lam"] for r in kept.collect()} == want


def test_lagged_surrogates_go_round(spark):
    rows = spark.createDataFrame([(0, "enso", t, float(t)) for t in range(12)], "member int, mode string, t int, value double")
    assert {r["t"]: r["value"] for r in ensemble.turned(rows, 3, 12).collect()} == {t: float((t - 3) % 12) for t in range(12)}


@pytest.mark.parametrize("kind", ["low", "high"])
def test_recursion_equals_the_matrix(spark, kind):
    x = np.random.default_rng(2).normal(size=(40, 1176))
    for reflect in (False, True):
        assert linop.recursion(3, 0.2, kind, reflect=reflect)(x) == pytest.approx(x @ linop.filter_matrix(1176, 3, 0.2, kind, reflect=reflect).T, abs=1e-9)
    rows = spark.createDataFrame([(c, t, float(v) if c or t else None) for c in range(3) for t, v in enumerate(x[c, :72])], "cell int, t int, value double")
    got = linop.filtered(rows, linop.recursion(3, 0.2, kind), ["cell"], first=2, last=70, steps=72).toPandas().sort_values(["cell", "t"])
    assert got[got.cell == 0].filtered.isna().all() and set(got.t) == set(range(2, 71))
    assert got[got.cell == 1].filtered.to_numpy() == pytest.approx((linop.filter_matrix(72, 3, 0.2, kind) @ x[1, :72])[2:71])


def test_filters_by_phase():
    x = np.random.default_rng(3).normal(size=24 * 30)
    got = linop.phase_filter_matrix(720, 24, 3, 0.2) @ x
    for k in range(24):
        assert got[k::24] == pytest.approx(linop.zero_phase(x[k::24], 3, 0.2, padding="even"))
