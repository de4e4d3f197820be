"""Surrogate series, multitaper spectra and low-frequency components.

A surrogate or a spectrum needs one series whole, and no more: grouped maps by series, whose size is
the length of the time axis. Low-frequency components need products of time steps summed over cells,
which Spark adds up; only steps x steps tables are decomposed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .linop import filter_matrix, phase_filter_matrix

MOST_ROUNDS, TOLERANCE = 1000, 1e-8


def surrogate(x: np.ndarray, rng: np.random.Generator, cycle: int | None = None) -> np.ndarray | None:
    """A random series with the values of x and nearly its amplitude spectrum. cycle: with the standard deviation of each phase of x as well (values then differ). None if it doesn't settle."""
    mean, x = x.mean(), x - x.mean()
    goal, ranked, scale = np.abs(np.fft.fft(x)), np.sort(x), x.std() or 1.0
    whole = x[: len(x) // cycle * cycle].reshape(-1, cycle).std(axis=0) if cycle else None
    out, last = rng.permutation(x), np.inf
    for _ in range(MOST_ROUNDS):
        z = np.fft.fft(out)
        size = np.abs(z)
        gap = float(np.sqrt(np.mean((goal - size) ** 2)) / scale)
        shaped = np.fft.ifft(goal * np.divide(z, size, out=np.ones_like(z), where=size > 0)).real
        out = np.empty_like(x)
        out[np.argsort(shaped, kind="stable")] = ranked
        if cycle:
            for k in range(cycle):
                own = out[k::cycle].std()
                out[k::cycle] *= whole[k] / own if own > 0 else 1.0
        if abs(last - gap) <= TOLERANCE:
            return out + mean
        last = gap
    return None


def settled(x: np.ndarray, seed: int, member: int, mode: str, cycle: int | None = None) -> np.ndarray:
    """A member's surrogate of a mode, whose seed follows from the seed, the member's number and the mode; what doesn't settle is drawn again."""
    for attempt in range(100):
        found = surrogate(x, np.random.default_rng([seed, member, zlib.crc32(mode.encode()), attempt]), cycle)
        if found is not None:
            return found
    raise ValueError(f"no surrogate of {mode} settled")


def surrogates(series: DataFrame, members: int, seed: int = 456, cycle: dict[str, int] | None = None) -> DataFrame:
    """series (mode, t, value) to (member, mode, t, value). Each member's seed follows from the seed, its number and the mode, whatever the order of work; what doesn't settle is drawn again."""

    def make(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("t")
        member, mode = int(own["member"].iloc[0]), own["mode"].iloc[0]
        return own[["member", "mode", "t"]].assign(value=settled(own["value"].to_numpy(), seed, member, mode, (cycle or {}).get(mode)))

    each = series.select("mode", "t", "value").withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    return each.groupBy("member", "mode").applyInPandas(make, "member int, mode string, t int, value double")


def low_passed(surrogates: DataFrame, modes: list[str], steps: int, cutoff: float, order: int = 3) -> DataFrame:
    """(member, mode, t, value) with the named modes filtered again, as a surrogate of a filtered index isn't quite as smooth. A member's series at a time."""
    if cutoff <= 0:
        return surrogates
    matrix = filter_matrix(steps, order, 2 * cutoff)

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("t")
        return own.assign(value=matrix @ own["value"].to_numpy()) if own["mode"].iloc[0] in modes else own

    return surrogates.select("member", "mode", "t", "value").groupBy("member", "mode").applyInPandas(run, "member int, mode string, t int, value double")


def _tridiagonal_vectors(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The eigenvectors (columns) of the k largest eigenvalues, in descending order, of a symmetric tridiagonal matrix.

    Eigenvalues by bisection on Sturm counts, all k at once; vectors by inverse iteration, k solutions
    of a tridiagonal system at a time. No n x n matrix is made.
    """
    n = len(d)
    spread = np.abs(np.append(e, 0)) + np.abs(np.insert(e, 0, 0))
    low, high = np.full(k, (d - spread).min()), np.full(k, (d + spread).max())
    tiny = np.finfo(float).eps * max(abs(low[0]), abs(high[0]), 1e-300)
    wanted = n - 1 - np.arange(k)  # so many eigenvalues lie below
    squares = e * e
    while (high - low > 4 * tiny).any():
        mid = (low + high) / 2
        if (mid <= low).all() or (mid >= high).all():
            break
        q = d[0] - mid
        below = (q < 0).astype(np.int64)
        for i in range(1, n):
            q = d[i] - mid - squares[i - 1] / np.where(np.abs(q) < tiny, np.copysign(tiny, q), q)
            below += q < 0
        more = below > wanted
        high, low = np.where(more, mid, high), np.where(more, low, mid)
    values = (low + high) / 2
    x = np.random.default_rng(0).normal(size=(n, k))
    for _ in range(4):
        x = _solved(d, e, values, x, tiny)
        for j in range(k):  # values lie apart, but rounding may mix neighbours
            x[:, j] -= x[:, :j] @ (x[:, :j].T @ x[:, j])
            x[:, j] /= np.linalg.norm(x[:, j])
    return x


def _solved(d: np.ndarray, e: np.ndarray, shifts: np.ndarray, rhs: np.ndarray, tiny: float) -> np.ndarray:
    """Solutions of (T - shift) x = rhs, a column for each shift, by elimination with row exchanges."""
    n, k = rhs.shape
    u0, u1, u2, y = np.empty((n, k)), np.zeros((n, k)), np.zeros((n, k)), np.empty((n, k))
    a, b, c, r = d[0] - shifts, np.full(k, e[0] if n > 1 else 0.0), np.zeros(k), rhs[0].copy()  # the row in hand
    for i in range(n - 1):
        low, mid = np.full(k, e[i]), d[i + 1] - shifts
        high = np.full(k, e[i + 1] if i + 2 < n else 0.0)
        swap = np.abs(low) > np.abs(a)
        p0, p1, p2, pr = np.where(swap, low, a), np.where(swap, mid, b), np.where(swap, high, c), np.where(swap, rhs[i + 1], r)
        s0, s1, s2, sr = np.where(swap, a, low), np.where(swap, b, mid), np.where(swap, c, high), np.where(swap, r, rhs[i + 1])
        p0 = np.where(np.abs(p0) < tiny, tiny, p0)
        f = s0 / p0
        u0[i], u1[i], u2[i], y[i] = p0, p1, p2, pr
        a, b, c, r = s1 - f * p1, s2 - f * p2, np.zeros(k), sr - f * pr
    u0[-1], y[-1] = np.where(np.abs(a) < tiny, tiny, a), r
    x = np.empty((n, k))
    for i in range(n - 1, -1, -1):
        x[i] = (y[i] - (u1[i] * x[i + 1] if i + 1 < n else 0) - (u2[i] * x[i + 2] if i + 2 < n else 0)) / u0[i]
    return x


@lru_cache(maxsize=16)
def tapers(n: int, nw: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most concentrated sequences (columns) and their concentrations, worked out once for each length."""
    half = nw / n
    t = np.arange(n)
    v = _tridiagonal_vectors(((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * half), t[1:] * (n - t[1:]) / 2, k)
    # the quadratic form of a Toeplitz matrix, from the sequences' autocorrelations
    power = np.abs(np.fft.rfft(v, 2 * n, axis=0)) ** 2
    own = np.fft.irfft(power, 2 * n, axis=0)[:n]
    kernel = 2 * half * np.sinc(2 * half * t)
    return v, kernel[0] * own[0] + 2 * kernel[1:] @ own[1:]


#: Series that are transformed at once.
SERIES_AT_ONCE = 256


def multitaper(x: np.ndarray, dt: float = 1.0, nw: float = 3.0) -> dict[str, np.ndarray]:
    """Frequencies, adaptive power and its 95 % factors of a series, or of each row of a batch. The mean stays, at frequency 0."""
    one_series, x = x.ndim == 1, np.atleast_2d(x)
    n = x.shape[1]
    k = max(1, min(round(2 * nw), n) - 1)
    v, concentration = tapers(n, nw, k)
    one = n // 2 + 1
    power = np.abs(np.fft.fft(x[:, :, None] * v, axis=1)) ** 2
    variance = ((x * x).sum(axis=1) / n)[:, None, None]
    s = power[:, :, : min(2, k)].mean(axis=2)
    weights, going = np.ones_like(power), np.ones(len(x), bool)
    for _ in range(1000):
        # a series stays as it is once it has settled, whatever the batch
        own = np.flatnonzero(going)
        weights[own] = s[own, :, None] / (s[own, :, None] * concentration + variance[own] * (1 - concentration) + 1e-300)
        scale = weights[own] ** 2 * concentration
        fresh = (scale * power[own]).sum(axis=2) / np.maximum(scale.sum(axis=2), 1e-300)
        going[own] = np.abs(fresh - s[own]).sum(axis=1) / n > 5e-4 * variance[own, 0, 0] / n
        s[own] = fresh
        if not going.any():
            break
    scale = weights**2 * concentration
    freedom = 2 * scale.sum(axis=2) ** 2 / np.maximum((scale**2).sum(axis=2), 1e-300)
    spread = 2 / (9 * np.maximum(freedom, 1e-12))
    # fixed value: 1.96, the two-sided 95 % point of the normal distribution
    found = {"power": s[:, :one], "upper": (1 / (1 - spread - 1.96 * np.sqrt(spread)) ** 3)[:, :one], "lower": (1 / (1 - spread + 1.96 * np.sqrt(spread)) ** 3)[:, :one]}
    return {"frequency": np.arange(one) / (n * dt)} | ({c: a[0] for c, a in found.items()} if one_series else found)


def spectra(series: DataFrame, keys: dict[str, str], dt: float = 1.0, nw: float = 3.0) -> DataFrame:
    """series (keys, t, value) to keys, k, frequency, power, upper, lower. keys: their types by name. Series come as arrays and are transformed in batches; those of one length share their tapers. A missing value makes a series' power missing."""
    names = list(keys)
    rows = series.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("_s")).select(*names, F.col("_s.value").alias("_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, SERIES_AT_ONCE):
                batch = whole.slice(first, SERIES_AT_ONCE)
                lists = batch.column("_x")
                x = [np.array(v, float) for v in lists.to_pylist()]
                found: list = [None] * len(x)
                for n in {len(v) for v in x}:
                    own = [i for i, v in enumerate(x) if len(v) == n]
                    got = multitaper(np.stack([x[i] for i in own]), dt, nw)
                    for place, i in enumerate(own):
                        found[i] = (got["frequency"], *(got[c][place] for c in ("power", "upper", "lower")))
                cols = [pa.array([f[c] for f in found], pa.list_(pa.float64())) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], names=[*names, "frequency", "power", "upper", "lower"])

    schema = ", ".join(f"{n} {t}" for n, t in keys.items()) + ", frequency array<double>, power array<double>, upper array<double>, lower array<double>"
    each = rows.mapInArrow(run, schema).select(*names, F.posexplode(F.arrays_zip("frequency", "power", "upper", "lower")).alias("k", "of"))
    return each.select(*names, "k", "of.*")


def envelope(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and 95 % range of power over surrogates."""
    return spectra.groupBy(*keys).agg(F.avg("power").alias("mean"), F.percentile("power", F.lit(0.025)).alias("low"), F.percentile("power", F.lit(0.975)).alias("high"))


def step_products(rows: DataFrame, groups: list[str], steps: int) -> DataFrame:
    """rows (groups, cell, weight, x: a series as an array) to groups, i, mixed, gram: row i of the steps x steps sums of products of two steps over cells, weighted once and twice. One matrix product for each batch of cells; what crosses the network are steps rows a batch and group."""
    kinds = [rows.schema[g].dataType.simpleString() for g in groups]
    typed = [to_arrow_type(rows.schema[g].dataType) for g in groups]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def summed() -> Iterator[pa.RecordBatch]:
            for name, (mixed, gram) in sums.items():
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * steps, kind) for v, kind in zip(name, typed)), pa.array(np.arange(steps, dtype=np.int32)), pa.array(list(mixed)), pa.array(list(gram))], names=[*groups, "i", "mixed", "gram"])
            sums.clear()

        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, steps)
            w = batch.column("weight").to_numpy()[:, None]
            names = list(zip(*(batch.column(g).to_pylist() for g in groups)))
            for name in set(names):
                at = np.array([n == name for n in names])
                own = x[at] * w[at]
                both = np.stack([x[at].T @ own, own.T @ own])
                sums[name] = sums[name] + both if name in sums else both
            if len(sums) > 8:
                yield from summed()
        yield from summed()

    schema = ", ".join(f"{g} {k}" for g, k in zip(groups, kinds)) + ", i int, mixed array<double>, gram array<double>"
    partial = rows.select(*groups, "weight", "x").mapInArrow(multiply, schema)
    spread = partial.select(*groups, "i", F.posexplode(F.arrays_zip("mixed", "gram")).alias("j", "of"))
    sums = spread.groupBy(*groups, "i", "j").agg(F.sum("of.mixed").alias("mixed"), F.sum("of.gram").alias("gram"))
    rows_of = F.sort_array(F.collect_list(F.struct("j", "mixed", "gram")))
    return sums.groupBy(*groups, "i").agg(rows_of.alias("of")).select(*groups, "i", F.col("of.mixed").alias("mixed"), F.col("of.gram").alias("gram"))


def low_frequency_components(series: DataFrame, groups: list[str], steps: int, retained: int, kept: int, cutoff: float, order: int = 3, phases: int | None = None, mask: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Patterns (groups, cell, component, pattern) and series (groups, t, component, value).

    series: groups, cell, t from 0 to steps - 1, value (without its cycle), weight (the root of the
    cell's area). Cells that miss a value take no part. The products of two steps are summed over
    cells, once unweighted by weighted and once weighted by weighted (``step_products``); the rest works
    on steps x steps numbers. A component's sign is such that its last five steps lie above its first five.
    phases: the filter runs on each phase of a cycle of so many steps alone, evenly reflected at its ends,
    and cutoff is in cycles of a phase; without, on the whole axis, oddly reflected. mask: a table of the
    cells that take part.
    """
    if mask is not None:
        series = series.join(mask.select("cell").distinct(), "cell", "left_semi")
    rows = series.groupBy(*groups, "cell", "weight").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("s"), F.count("value").alias("n"), F.avg("value").alias("mean")).where(F.col("n") == steps)
    rows = rows.select(*groups, "cell", "weight", F.transform("s", lambda p: p["value"] - F.col("mean")).alias("x"))
    products = step_products(rows, groups, steps)
    slow = phase_filter_matrix(steps, phases, order, 2 * cutoff) if phases else filter_matrix(steps, order, 2 * cutoff)

    def decompose(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("i")
        mixed, gram = np.vstack(own["mixed"].to_numpy()), np.vstack(own["gram"].to_numpy())
        values, u = np.linalg.eigh(gram)
        n = min(retained, int((values > values[-1] * 1e-12).sum()))
        values, u = values[::-1][:n], u[:, ::-1][:, :n]
        sigma = np.sqrt(values / (steps - 1))
        u = u / np.sqrt(values)
        scores = mixed @ u / sigma
        smooth = slow @ scores
        e = np.linalg.eigh(smooth.T @ smooth / (n - 1))[1][:, ::-1][:, :kept]
        out = scores @ e
        sign = np.where(out[-5:].mean(axis=0) >= out[:5].mean(axis=0), 1, -1)
        back = (u * sigma) @ e * sign
        t, c = np.divmod(np.arange(out.size), out.shape[1])
        found = pd.DataFrame({"t": t.astype(np.int32), "component": c.astype(np.int32), "value": (out * sign).ravel(), "back": back.ravel()})
        for place, name in enumerate(groups):
            found.insert(place, name, own[name].iloc[0])
        return found

    kinds = ", ".join(f"{g} {series.schema[g].dataType.simpleString()}" for g in groups)
    found = products.groupBy(*groups).applyInPandas(decompose, f"{kinds}, t int, component int, value double, back double")
    weights = found.groupBy(*groups, "component").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "back"))), lambda p: p["back"]).alias("b"))
    patterns = rows.join(weights, groups).select(*groups, "cell", "component", F.aggregate(F.zip_with("x", "b", lambda x, b: x * b), F.lit(0.0), lambda a, v: a + v, lambda a: a * F.col("weight")).alias("pattern"))
    return patterns, found.drop("back")
