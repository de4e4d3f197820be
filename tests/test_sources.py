"""Array archives, long lists of files and table functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import tables
from tidewheel.operators import spectra
from tidewheel.sources import arrays, files


@pytest.fixture
def archives(tmp_path):
    rng = np.random.default_rng(1)
    made, paths = {}, []
    for k, save in enumerate((np.savez, np.savez_compressed, np.savez)):
        own = {"ENSO_surr": rng.normal(size=(5, 24)), "AMO_surr": np.asfortranarray(rng.normal(size=(5, 24))).astype(np.float32 if k else float), "months": np.arange(24)}
        path = str(tmp_path / f"surrogates_{k}.npz")
        save(path, **own)
        made[k] = own
        paths.append(path)
    np.save(tmp_path / "plain.npy", rng.integers(0, 9, (3, 4)))
    return made, paths, str(tmp_path / "plain.npy")


def test_archives_read_back(spark, archives, monkeypatch):
    made, paths, plain = archives
    monkeypatch.setattr(arrays, "VALUES_A_TASK", 50)  # two rows a task
    got = {(r["file"], r["name"], r["row"], r["step"]): r["value"] for r in arrays.read(spark, [*paths, plain]).collect()}
    want = {(k, n, i, j): float(np.atleast_2d(a)[i, j]) for k, own in made.items() for n, a in own.items() for i in range(np.atleast_2d(a).shape[0]) for j in range(a.shape[-1])}
    want |= {(3, "plain", i, j): float(v) for (i, j), v in np.ndenumerate(np.load(plain))}
    assert got == want
    members = arrays.surrogate_archive(spark, paths, 5, {"ENSO_surr": "enso", "AMO_surr": "amo"})
    back = {(r["member"], r["mode"], r["t"]): r["value"] for r in members.collect()}
    assert len(back) == 15 * 2 * 24 and all(v == float(made[m // 5][{"enso": "ENSO_surr", "amo": "AMO_surr"}[mode]][m % 5, t]) for (m, mode, t), v in back.items())


def test_filters_leave_out_partitions(archives, monkeypatch):
    made, paths, _ = archives
    monkeypatch.setattr(arrays, "VALUES_A_TASK", 50)
    everything = arrays.ArrayReader(paths).partitions()
    assert len(everything) == 3 * (3 + 3 + 1)
    reader = arrays.ArrayReader(paths)
    left = list(reader.pushFilters([arrays.EqualTo(("name",), "ENSO_surr"), arrays.In(("file",), (0, 2)), arrays.GreaterThanOrEqual(("row",), 3), arrays.EqualTo(("value",), 1.0)]))
    assert left == [arrays.EqualTo(("value",), 1.0)]
    found = reader.partitions()
    assert {(p.file, p.name) for p in found} == {(0, "ENSO_surr"), (2, "ENSO_surr")} and min(p.first for p in found) == 3
    values = [v for p in found for b in reader.read(p) for v in b.column("value").to_pylist()]
    assert values == [v for k in (0, 2) for v in made[k]["ENSO_surr"][3:].ravel().tolist()]


def test_pushed_filters_in_a_plan(spark, archives):
    made, paths, _ = archives
    df = arrays.read(spark, paths).where("name = 'AMO_surr' and file = 1 and row in (1, 4)")
    assert {(r["row"], r["step"]): r["value"] for r in df.collect()} == {(i, j): float(made[1]["AMO_surr"][i, j]) for i in (1, 4) for j in range(24)}
    assert df.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="no array file"):
        arrays.read(spark, ["/tmp/x.nc"]).count()


def test_stretches_that_files_share():
    assert files.overlaps([(0, 9), (10, 19), (20, 29)]) == []
    assert files.overlaps([(5, 12), (0, 6), (12, 20), (30, 40), (32, 33), (33, 50)]) == [(5, 6), (12, 12), (32, 40)]
    assert files.overlaps([(0, 100), (10, 20), (15, 30)]) == [(10, 30)]


def test_a_thousand_files_are_one_scan(spark, tmp_path):
    spark.range(4000).select((F.col("id") / 4).cast("int").alias("part"), F.col("id").alias("ts"), (F.col("id") * 2.0).alias("value"), F.lit("x").alias("own")).repartition(4).write.partitionBy("part").parquet(str(tmp_path / "all"))
    paths = [str(tmp_path / "all" / f"part={k}") for k in range(1000)]
    spark.createDataFrame([(11, -1.0, "late"), (12, -2.0, "late"), (5000, -3.0, "late"), (None, 7.0, "late")], "ts long, value double, own string").coalesce(1).write.parquet(str(tmp_path / "late"))
    got = files.along_time(spark, [*paths, str(tmp_path / "late")], keys=["own"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 8  # not one for each path
    rows = {(r["own"], r["ts"]): r["value"] for r in got.collect()}
    assert len(rows) == 4004 and rows["late", 11] == -1.0 and rows["x", 11] == 22.0 and rows["late", None] == 7.0
    # without keys, the later file's value stands for steps that both have
    rows = {r["ts"]: r["value"] for r in files.along_time(spark, [*paths, str(tmp_path / "late")]).collect()}
    assert len(rows) == 4002 and rows[11] == -1.0 and rows[12] == -2.0 and rows[13] == 26.0
    rows = {r["ts"]: r["value"] for r in files.along_time(spark, [str(tmp_path / "late"), *paths]).collect()}
    assert rows[11] == 22.0


def test_table_functions_equal_the_operators(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(m, t, float(v)) for m in ("amo", "enso") for t, v in enumerate(rng.normal(size=48).cumsum())], "mode string, t int, value double").repartition(4)
    rows.createOrReplaceTempView("series_for_sql")
    tables.register(spark)
    got = spark.sql("SELECT * FROM surrogates(TABLE(SELECT mode, t, value FROM series_for_sql), members => 3)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spectra.surrogates(rows, 3).collect()))
    got = spark.sql("SELECT * FROM spectrum(TABLE(series_for_sql), dt => 0.5D)").orderBy("mode", "k").collect()
    want = spectra.spectra(rows, {"mode": "string"}, 0.5).orderBy("mode", "k").collect()
    assert len(got) == len(want) == 50
    for a, b in zip(got, want):
        assert a["mode"] == b["mode"] and [a[c] for c in ("frequency", "power", "upper", "lower")] == pytest.approx([b[c] for c in ("frequency", "power", "upper", "lower")])
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM spectrum(TABLE(SELECT 1 AS x))")
