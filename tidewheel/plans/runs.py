"""Runs by case, from a cube to stored ensemble members: fit, forced part, block length, surrogates, members.

A case has any number of variables. They are one plan in which a series is a variable and a cell: each
variable has its own transform, while the block length is the largest over the variables and the
draws and surrogates are the same for all. Stages are named by what they depend on (``store.Stages``),
so a run with other input, parameters or variables never reads what another one made.
"""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, ensemble, metrics, normalize, regress, spectra
from ..sources import cubes, store
from ..sources.store import Parameters, Stage, Stages, Variable

#: A run's parameters by the name of its case.
CASES: dict[str, Parameters] = {
    "orders": Parameters((Variable("order_value"),), predictors=("constant", "enso", "pdo_orth", "gmt"), low_pass_cutoff=0.05),
    "orders_transformed": Parameters((Variable("order_value", "boxcox"),), low_pass_cutoff=0.05, members=2),
    "regions": Parameters((Variable("region_value"),), predictors=("constant", "enso"), members=2),
    "joint": Parameters((Variable("order_value", "log"), Variable("order_count")), predictors=("constant", "enso", "pdo_orth", "gmt"), members=2, lag=1),
    "member_2": Parameters((Variable("member_value", "boxcox", exponents_of=1),), source_member=2, predictors=("constant", "enso"), members=2),
}
MODES = ("enso", "pdo_orth", "amo")


def parameters(case: str) -> Parameters:
    if case not in CASES:
        raise ValueError(f"no case {case!r}")
    return CASES[case]


def source(spark: SparkSession, sf_dir: str, name: str, member: int | None = None) -> DataFrame:
    """A variable's cube: cell, lat, t, year, month, value. Values are in thousands, so that exponents have a maximum within bounds."""
    columns = ["cell", "lat", "t", "year", "month"]
    thousands = (F.col("value") / 1000).alias("value")
    if name == "order_value":
        return cubes.orders_cube(spark, sf_dir).select(*columns, thousands)
    if name == "order_count":
        return cubes.orders_cube(spark, sf_dir).select(*columns, F.col("n_orders").cast("double").alias("value"))
    of_regions = [F.col("cell"), (F.lit(-40.0) + 20 * F.col("cell")).alias("lat"), F.col("t"), F.col("year"), F.col("month")]
    if name == "region_value":
        return cubes.complete_orders_cube(spark, sf_dir).select(*of_regions, thousands)
    if name == "member_value":
        return cubes.members_cube(spark, sf_dir).where(F.col("member") == member).select(*of_regions, thousands)
    raise ValueError(f"no variable {name!r}")


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All drivers, the second without its part along the first, with a standard deviation of one (but gmt, which is never scaled)."""
    return regress.standardised(regress.orthogonalised(cubes.drivers(spark, sf_dir), "pdo", "enso", "pdo_orth"), list(MODES))


def led(rows: DataFrame, lag: int, first_t: int) -> DataFrame:
    """Drivers whose modes come lag steps earlier (gmt and the calendar don't), from first_t on."""
    if not lag:
        return rows.where(F.col("t") >= first_t)
    kept = [c for c in ("year", "month", "gmt") if c in rows.columns]
    return align.lagged(rows, lag, kept).where(F.col("t") >= first_t)


def surrogate_table(drivers: DataFrame, p: Parameters, steps: int) -> DataFrame:
    """member, t, month and the modes that p's predictors name, each lagged round its axis."""
    names = [m for m in MODES if m in p.predictors]
    series = align.stacked({m: drivers.select("t", F.col(m).alias("value")) for m in names}, "mode")
    drawn = spectra.low_passed(spectra.surrogates(series, p.members, p.seed, cycle={"enso": 12}), [m for m in names if m == "amo"], steps, p.low_pass_cutoff)
    moved = ensemble.turned(drawn, p.lag, steps)
    wide = align.to_columns(moved, ["member", "t"], "mode", "value", names)
    return ensemble.rescaled(wide.withColumn("month", (F.col("t") % 12 + 1).cast("int")), names)


def normalised(stages: Stages, original: Stage, exponents: Stage, p: Parameters, back: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Each variable under its own transform; back: rows with a column kind to transform back instead, where only full members have the cells without data masked again."""
    parts = []
    for v in p.variables:
        own = (original.rows if back is None else back).where(F.col("variable") == v.name)
        if v.transform is None:
            parts.append(own)
            continue
        lam = exponents.rows.where(F.col("variable") == v.name).select("cell", "month", "lam") if v.transform == "boxcox" else None
        if back is None:
            parts.append(normalize.transform(own, lam, ["cell", "month"], v.transform))
        else:
            there = mask.where(F.col("variable") == v.name)
            parts += [normalize.transform(own.where(F.col("kind") == kind), lam, ["cell", "month"], v.transform, back=True, mask=m) for kind, m in (("full", there), ("noise", None))]
    columns = parts[0].columns
    return reduce(DataFrame.unionByName, [x.select(columns) for x in parts])


def run(spark: SparkSession, sf_dir: str, case: str, folder: str) -> DataFrame:
    """Writes parameters, stages and members (by variable, kind and member) below folder; returns the stored members."""
    p = parameters(case)
    return joint(spark, sf_dir, p, Stages(spark, folder), store.fingerprint(spark, *[f"{sf_dir}/{t}.parquet" for t in ("nation", "customer", "orders", "lineitem")]), case).rows


def joint(spark: SparkSession, sf_dir: str, p: Parameters, stages: Stages, inputs: str, case: str = "run") -> Stage:
    """The stages of all of p's variables, from inputs (a digest of the input's files) to members."""
    store.write_parameters(spark, p, f"{stages.folder}/parameters-{case}")
    # with a lag, the first year only lends its modes
    skipped = 12 * -(-p.lag // 12)
    first_t = 12 * (p.first_year - cubes.FIRST_YEAR) + skipped
    steps = 12 * (p.last_year - p.first_year + 1) - skipped
    span = [p.first_year, p.last_year, p.lag, p.source_member]

    def cube(v: Variable, member: int | None) -> DataFrame:
        rows = source(spark, sf_dir, v.name, member).where(F.col("t").between(first_t, first_t + steps - 1)).withColumn("t", F.col("t") - first_t)
        return rows.withColumn("variable", F.lit(v.name))

    names = [v.name for v in p.variables]
    original = stages.kept("original", lambda: reduce(DataFrame.unionByName, [cube(v, p.source_member) for v in p.variables]), inputs, names, span, partition=("variable",))
    boxed = [v for v in p.variables if v.transform == "boxcox"]
    lending = [(v, p.source_member if v.exponents_of is None else v.exponents_of) for v in boxed]
    # named by the member that lends them, not by the one that runs, so all members read the same
    exponents = stages.kept("exponents", lambda: reduce(DataFrame.unionByName, [normalize.best_exponents(cube(v, m), ["variable", "cell", "month"], refine=2) for v, m in lending]), inputs, [(v.name, m) for v, m in lending], span[:3]) if boxed else Stage(None, "")
    data = stages.kept("transformed", lambda: normalised(stages, original, exponents, p), original, exponents, [asdict(v) for v in p.variables], partition=("variable",))

    predictors = list(p.predictors)
    drivers = led(modes(spark, sf_dir), p.lag, first_t).withColumn("t", F.col("t") - first_t)
    flat = lambda rows: rows.select("series.variable", "series.cell", *[c for c in rows.columns if c != "series"])
    keyed = lambda rows: rows.select(F.struct("variable", "cell").alias("series"), *[c for c in rows.columns if c not in ("variable", "cell")])
    beta = stages.kept("beta", lambda: flat(regress.smoothed(regress.monthly_fit(keyed(data.rows), regress.hat_table(drivers, predictors), "series"), "series")), data, inputs, predictors, span, partition=("variable",))
    fit = keyed(beta.rows)
    fits = stages.kept("fitted", lambda: flat(regress.fitted(keyed(data.rows.select("variable", "cell", "t", "month", "value")), fit, drivers, predictors, "series")), data, beta, partition=("variable",))
    stages.kept("climatology", lambda: beta.rows.where("predictor = 'constant'").select("variable", "cell", "month", F.col("beta").alias("mean")), beta, partition=("variable",))
    forced = stages.kept("forced", lambda: flat(regress.forced(fit, drivers, "gmt", "series")), beta, inputs, partition=("variable",)) if "gmt" in predictors else None

    # the largest block over the variables, from cells with data outside the subtropics
    there = align.ends(original.rows, ["variable", "cell"]).where("has_data").select("variable", "cell")
    lats = original.rows.select("variable", "cell", "lat").distinct()
    rho = lambda: ensemble.lag_correlation(fits.rows.join(there, ["variable", "cell"], "left_semi"), ["variable", "cell", "month"], order="t", value="residual")
    lengths = stages.kept("block-lengths", lambda: rho().join(lats, ["variable", "cell"]).select("variable", "cell", "lat", "month", ensemble.block_length(F.col("n"), F.col("rho")).alias("length")), fits)
    block = min(steps, ensemble.block_to_use(lengths.rows, "variable", align.outside_subtropics(F.col("lat"))).first()["block"] or 12)

    own_modes = [m for m in MODES if m in predictors]
    drawn = stages.kept("surrogates", lambda: surrogate_table(modes(spark, sf_dir).where(F.col("t").between(first_t, first_t + steps - 1)).withColumn("t", F.col("t") - first_t), p, steps), inputs, own_modes, span, p.members, p.seed, p.low_pass_cutoff)

    def made() -> DataFrame:
        starts = ensemble.seeded_starts(spark, p.members, steps, block, p.seed)
        noise = ensemble.bootstrapped(keyed(fits.rows), ensemble.resampling(starts, steps, block), "series")
        full = ensemble.members(noise, fit, drawn.rows, own_modes, None if forced is None else keyed(forced.rows), "series")
        kinds = align.stacked({"full": full, "noise": ensemble.noise_members(noise, keyed(fits.rows), "series")}, "kind")
        months = flat(kinds).withColumn("month", (F.col("t") % 12 + 1).cast("int"))
        return normalised(stages, original, exponents, p, months, there).drop("month")

    members = stages.kept("members", made, fits, drawn, forced or "", original, exponents, block, p.seed, p.members, [asdict(v) for v in p.variables], partition=("variable", "kind", "member"))
    return members


def metric_run(stages: Stages, members: Stage, names: list[str], steps: int, partition: tuple[str, ...] = ("kind", "metric")) -> Stage:
    """Metrics by name of every stored series, averaged over members: variable, kind, cell, metric, value."""
    keys = ["variable", "kind", "member", "cell"]
    make = lambda: ensemble.nested_mean(metrics.named(members.rows, keys, names, steps), ["variable", "kind", "cell", "metric"])
    return stages.kept("metrics", make, members, names, steps, partition=partition)
