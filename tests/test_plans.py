"""Every query against its SQL, the stores and the stream."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewheel.plans import catalogue, extended  # noqa: F401  registers its queries
from tidewheel.sources import cubes, store
from tidewheel.streaming import climatology

TABLES = "region nation customer supplier part orders lineitem events".split()


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-5))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLES[name]})").fetchall()
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, round(x, 2) if isinstance(x, float) else x) for x in r))
    got = order(tuple(r) for r in df.select(*cols).collect())
    want = order(want)
    assert len(got) == len(want) > 0
    assert all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_libraries_of_the_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    hide = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", hide], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(catalogue.QUERIES) and out[1] == "False"


def test_every_query_names_what_it_covers():
    assert set(catalogue.COVERS) == set(catalogue.QUERIES)
    named = {i for ids in catalogue.COVERS.values() for i in ids.split()}
    assert all(i[0] in "ABCDEFGHILN" and i[1:].isdigit() for i in named) and len(named) > 90


def test_member_store(spark, sf_dir, tmp_path):
    rows = spark.range(12).select((F.col("id") % 3).cast("int").alias("member"), F.lit("tas").alias("variable"), F.lit("full").alias("kind"), F.col("id").alias("t"))
    path = str(tmp_path / "members")
    store.write_members(rows, path)
    store.write_members(rows.limit(1), path)  # what is there stays
    assert store.read_members(spark, path).count() == 12
    one = store.read_members(spark, path, [1])
    assert one.count() == 4 and len(one.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(member" in one._jdf.queryExecution().toString()


def test_results_are_kept_by_what_they_depend_on(spark, tmp_path):
    """Other input, other parameters or another stage before give another result; an interrupted one is made anew."""
    stages = store.Stages(spark, str(tmp_path / "kept"))
    spark.range(5).write.parquet(str(tmp_path / "a"))
    spark.range(9).write.parquet(str(tmp_path / "b"))
    a, b = (store.fingerprint(spark, str(tmp_path / x)) for x in "ab")
    assert a == store.fingerprint(spark, str(tmp_path / "a")) != b
    read = lambda x, **more: stages.kept("x", lambda: spark.read.parquet(str(tmp_path / x)), {"a": a, "b": b}[x], more)
    assert [read("a").rows.count(), read("b").rows.count(), read("a").rows.count(), read("a", seed=9).rows.count()] == [5, 9, 5, 5]
    assert stages.made == ["x", "x", "x"]
    after = lambda x: stages.kept("sum", lambda: x.rows.agg(F.sum("id").alias("s")), x)
    assert [after(read("a")).rows.first()[0], after(read("b")).rows.first()[0]] == [10, 36]
    # a job that was cut off leaves a folder without a marker
    path = stages.path("x", read("b").digest)
    (tmp_path / "kept" / path.rsplit("/", 1)[1] / "_SUCCESS").unlink()
    (tmp_path / "kept" / path.rsplit("/", 1)[1] / "_temporary").mkdir()
    assert read("b").rows.count() == 9 and stages.made.count("x") == 4
    # changed files are other files
    spark.range(7).write.mode("append").parquet(str(tmp_path / "a"))
    assert store.fingerprint(spark, str(tmp_path / "a")) != a


def test_cubes_have_every_step(spark, sf_dir):
    assert cubes.orders_cube(spark, sf_dir).count() == 25 * 72
    assert cubes.complete_orders_cube(spark, sf_dir).count() == 5 * 72
    assert cubes.drivers(spark, sf_dir).where("enso is null or pdo is null or gmt is null").count() == 0


def test_running_climatology(spark, sf_dir, tmp_path):
    whole = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    whole.repartition(3).write.parquet(str(tmp_path / "in" / "events"))
    stream = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in" / "events"))
    q = climatology.running(stream, "event_type", "ts", "value").writeStream.outputMode("complete").format("memory").queryName("climatology").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r["cell"], r["day"], r["phase"]): (round(r["mean"], 9), r["n"]) for r in spark.table("climatology").collect()}
    want = {(r["cell"], r["day"], r["phase"]): (round(r["mean"], 9), r["n"]) for r in climatology.running(whole, "event_type", "ts", "value").collect()}
    assert got == want
