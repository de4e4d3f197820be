"""Box-Cox and logarithmic normalisation of skewed series, by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for no rain, and the bounds of the exponent.
TRACE = 1e-24
LOWEST, HIGHEST = 0.001, 1.0
GRID = (LOWEST, *(k / 20 for k in range(1, 21)))


def cleared(value: Column) -> Column:
    """Zero and less become a trace; null stays null."""
    return F.when(value <= 0, F.lit(TRACE)).otherwise(value)


def forward(value: Column, lam: Column) -> Column:
    return (F.pow(value, lam) - 1) / lam


def inverse(value: Column, lam: Column) -> Column:
    """What no value maps to becomes 0."""
    back = F.pow(lam * value + 1, 1 / lam)
    return F.when(value.isNotNull(), F.coalesce(F.nanvl(back, F.lit(0.0)), F.lit(0.0)))


def log_forward(value: Column) -> Column:
    return F.ln(cleared(value))


def log_inverse(value: Column) -> Column:
    return F.coalesce(F.exp(value), F.lit(0.0))


def best_exponents(df: DataFrame, keys: list[str], value: str = "value", refine: int = 0) -> DataFrame:
    """The exponent with the highest profile likelihood, by key: a grid in one aggregation, without a row for each exponent; each refinement searches between the neighbours of the best, ten times as fine. Keys without values have none."""
    x = cleared(F.col(value))

    def best(rows: DataFrame, lams: list[Column], extra: list[str]) -> DataFrame:
        x = F.col("_x")
        sums = rows.groupBy(*keys, *extra).agg(F.count(x).alias("_k"), F.sum(F.ln(x)).alias("_logs"), *[F.var_pop(forward(x, lam)).alias(f"_v{i}") for i, lam in enumerate(lams)])
        scored = F.array(*[F.struct(F.when(F.col(f"_v{i}") > 0, (lam - 1) * F.col("_logs") - F.col("_k") / 2 * F.ln(f"_v{i}")).alias("llf"), (-lam).alias("lam")) for i, lam in enumerate(lams)])
        return sums.select(*keys, (-F.array_max(F.filter(scored, lambda s: s["llf"].isNotNull()))["lam"]).alias("lam"))

    rows = df.select(*keys, x.alias("_x"))
    found = best(rows, [F.lit(g) for g in GRID], [])
    step = 0.05
    for _ in range(refine):
        near = rows.join(found.withColumnRenamed("lam", "_at"), keys)
        found = best(near, [F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.col("_at") + step * (k / 10))) for k in range(-10, 11)], ["_at"])
        step /= 10
    return found


def borrowed(exponents: DataFrame, member: int, keys: list[str]) -> DataFrame:
    """The exponents of one member, for all: keys (without the member), lam."""
    return exponents.where(F.col("member") == member).select(*keys, "lam")


#: Named transforms: forward and inverse of a value and an exponent (which the logarithm doesn't use).
TRANSFORMS = {
    "boxcox": (lambda value, lam: forward(cleared(value), lam), inverse),
    "log": (lambda value, lam: log_forward(value), lambda value, lam: log_inverse(value)),
}


def transform(df: DataFrame, exponents: DataFrame | None, keys: list[str], name: str, back: bool = False, value: str = "value", mask: DataFrame | None = None) -> DataFrame:
    """value transformed by name, or transformed back, with the exponents (keys, lam). Back, values that can't be become 0; mask (a table of cells with data) makes those of other cells null again."""
    if name not in TRANSFORMS:
        raise NotImplementedError(f"no transform {name!r}")
    both = df if exponents is None else df.join(exponents, keys)
    lam = F.lit(1.0) if exponents is None else F.col("lam")
    out = both.withColumn(value, TRANSFORMS[name][int(back)](F.col(value), lam)).drop("lam")
    if mask is not None:
        out = out.join(mask.select("cell", F.lit(True).alias("_there")).distinct(), "cell", "left").withColumn(value, F.when(F.col("_there"), F.col(value))).drop("_there")
    return out
