"""Linear operators on the time axis as small weight tables: Hann, zero-phase Butterworth, harmonics.

A filter of fixed length is a matrix. ``applied`` joins its rows (t_out, t_in, w) with the series and
sums: for short axes and few series. ``filtered`` has each series as an array and multiplies batches of
cells by the matrix, or, where the axis is long, runs the recursion over time for a batch of cells at
once (``recursion``), so a cell costs as many operations as it has steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeaxis import MID_MONTH_DAYS


def hann_weights(m: int) -> list[float]:
    """Symmetric and adding up to one; an even length becomes odd."""
    m += 1 - m % 2
    w = [0.5 - 0.5 * math.cos(2 * math.pi * k / (m - 1)) for k in range(m)] if m > 1 else [1.0]
    return [x / sum(w) for x in w]


def hann_smoothed(df: DataFrame, m: int, value: str = "value", order: str = "t", by: list[str] | None = None) -> DataFrame:
    """Only rows with a whole window of rows and values around them have a result; others go."""
    w, half = hann_weights(m), len(hann_weights(m)) // 2
    over = Window.partitionBy(*(by or [])).orderBy(order)
    terms = [F.lag(value, -k).over(over) * w[k + half] for k in range(-half, half + 1) if w[k + half]]
    # the end weights are zero, but their rows must be there
    edges = F.lag(value, half).over(over).isNotNull() & F.lag(value, -half).over(over).isNotNull()
    return df.withColumns({"_inside": edges, "smooth": sum(terms[1:], terms[0])}).where(F.col("_inside") & F.col("smooth").isNotNull()).drop("_inside")


def butterworth(order: int, cutoff: float, kind: str = "low") -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a digital filter from the analogue prototype by the bilinear transform; cutoff in units of the Nyquist frequency."""
    warped = 4 * math.tan(math.pi * cutoff / 2)
    poles = np.array([np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)])
    analogue = warped * poles if kind == "low" else warped / poles
    digital = (4 + analogue) / (4 - analogue)
    zero = -1.0 if kind == "low" else 1.0
    sections = []
    for p in sorted((p for p in digital if p.imag > 1e-12), key=abs):
        sections.append((np.array([1, -2 * zero, 1.0]), np.array([1, -2 * p.real, abs(p) ** 2])))
    for p in (p for p in digital if abs(p.imag) <= 1e-12):
        sections.append((np.array([1, -zero, 0.0]), np.array([1, -p.real, 0.0])))
    at = 1.0 if kind == "low" else -1.0  # unit gain at frequency 0, or at the Nyquist frequency
    powers = at ** -np.arange(3)
    return [(b * (a @ powers) / (b @ powers), a) for b, a in sections]


def _run(sections, x: np.ndarray) -> np.ndarray:
    """Columns of x through all sections, each in the steady state of its first value."""
    for b, a in sections:
        # steady state of a transposed direct form II section for a constant input of one
        out1 = b.sum() / a.sum()
        z2 = b[2] - a[2] * out1
        z1 = b[1] - a[1] * out1 + z2
        s1, s2 = z1 * x[0], z2 * x[0]
        y = np.empty_like(x)
        for k in range(len(x)):
            y[k] = b[0] * x[k] + s1
            s1 = b[1] * x[k] - a[1] * y[k] + s2
            s2 = b[2] * x[k] - a[2] * y[k]
        x = y
    return x


def zero_phase(x: np.ndarray, order: int, cutoff: float, kind: str = "low", padding: str = "odd") -> np.ndarray:
    """Forward and backward over the first axis, extended at both ends by the odd or even reflection."""
    sections = butterworth(order, cutoff, kind)
    pad = 3 * (2 * len(sections) + 1 - min(order % 2, 1))
    if len(x) <= pad:
        raise ValueError(f"a series of {len(x)} is too short for this filter; it needs more than {pad}")
    head, tail = x[pad:0:-1], x[-2 : -pad - 2 : -1]
    if padding == "odd":
        head, tail = 2 * x[0] - head, 2 * x[-1] - tail
    long = _run(sections, np.concatenate([head, x, tail]))
    return _run(sections, long[::-1])[::-1][pad:-pad]


def filter_matrix(n: int, order: int, cutoff: float, kind: str = "low", padding: str = "odd", reflect: bool = False) -> np.ndarray:
    """The filter as an n x n matrix. reflect: of the series between two mirror images of itself."""
    unit = np.eye(n)
    if not reflect:
        return zero_phase(unit, order, cutoff, kind, padding)
    return zero_phase(np.concatenate([unit[::-1], unit, unit[::-1]]), order, cutoff, kind, padding)[n : 2 * n]


def phase_filter_matrix(steps: int, phases: int, order: int, cutoff: float, padding: str = "even") -> np.ndarray:
    """The filter run on each phase of a cycle alone (every January, every February), as one steps x steps matrix: phases filters interleaved. cutoff is in units of a phase's own Nyquist frequency."""
    out = np.zeros((steps, steps))
    for k in range(phases):
        own = np.arange(k, steps, phases)
        out[np.ix_(own, own)] = filter_matrix(len(own), order, cutoff, padding=padding)
    return out


def recursion(order: int, cutoff: float, kind: str = "low", padding: str = "odd", reflect: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """The filter as a function of a batch of series (rows): all series advance together, step by step, so a series costs as many operations as it has steps."""

    def run(x: np.ndarray) -> np.ndarray:
        n, x = x.shape[1], np.ascontiguousarray(x.T)
        if not reflect:
            return zero_phase(x, order, cutoff, kind, padding).T
        return zero_phase(np.concatenate([x[::-1], x, x[::-1]]), order, cutoff, kind, padding)[n : 2 * n].T

    return run


#: Axes up to so many steps are filtered by a matrix, longer ones by recursion.
MATRIX_STEPS = 512


def band_filter(steps: int, order: int, cutoff: float, kind: str = "low", reflect: bool = False) -> np.ndarray | Callable[[np.ndarray], np.ndarray]:
    """The cheaper of the two forms for an axis of this length; they agree up to rounding."""
    return filter_matrix(steps, order, cutoff, kind, reflect=reflect) if steps <= MATRIX_STEPS else recursion(order, cutoff, kind, reflect=reflect)


def harmonic_matrix() -> np.ndarray:
    """Mean, annual and semi-annual harmonics of twelve values at mid-month."""
    t = np.array(MID_MONTH_DAYS) / 365
    return 1 / 12 + sum(2 / 12 * np.cos(2 * np.pi * k * (t[:, None] - t[None, :])) for k in (1, 2))


def weight_table(spark: SparkSession, matrix: np.ndarray, first: int = 0) -> DataFrame:
    """(t_out, t_in, w) of a matrix, counted from first; Catalyst sees its size and decides how to join it."""
    rows = [(i + first, j + first, float(w)) for i, row in enumerate(matrix) for j, w in enumerate(row)]
    return spark.createDataFrame(rows, "t_out int, t_in int, w double")


def applied(df: DataFrame, weights: DataFrame, keys: list[str], value: str = "value", order: str = "t", steps: int | None = None) -> DataFrame:
    """keys, order, filtered. With steps, the number of the axis's steps, series that miss a value have null throughout."""
    joined = df.join(weights, df[order] == weights["t_in"])
    out = joined.groupBy(*keys, F.col("t_out").alias(order)).agg(F.sum(F.col(value) * F.col("w")).alias("filtered"), F.count(value).alias("_n"))
    return out.select(*keys, order, (F.when(F.col("_n") == steps, F.col("filtered")) if steps else F.col("filtered")).alias("filtered"))


def filtered(df: DataFrame, operator: np.ndarray | Callable[[np.ndarray], np.ndarray], keys: list[str], value: str = "value", order: str = "t", first: int = 0, last: int | None = None, steps: int | None = None) -> DataFrame:
    """keys, order, filtered, for the steps from first to last. Series that miss a value have null throughout; steps count from 0. operator: a matrix, or a function of a batch of series (rows; then the number of steps is needed)."""
    return several_filtered(df, {"filtered": operator}, keys, value, order, first, last, steps)


def several_filtered(df: DataFrame, operators: dict[str, np.ndarray | Callable[[np.ndarray], np.ndarray]], keys: list[str], value: str = "value", order: str = "t", first: int = 0, last: int | None = None, steps: int | None = None) -> DataFrame:
    """The same for several operators in one pass: keys, order and a column for each."""
    steps = steps or next(o.shape[1] for o in operators.values() if isinstance(o, np.ndarray))
    last = steps - 1 if last is None else last
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.col(value).alias("_v")))).alias("_s"), F.count(value).alias("_n"))
    rows = rows.select(*keys, F.when(F.col("_n") == steps, F.col("_s._v")).alias("_x"))
    apply = {name: (lambda x, m=np.ascontiguousarray(o[first : last + 1].T): x @ m) if isinstance(o, np.ndarray) else (lambda x, f=o: f(x)[:, first : last + 1]) for name, o in operators.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x")
            some = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
            own = x.drop_null().flatten().to_numpy().reshape(-1, steps) if len(some) else None
            cols = []
            for f in apply.values():
                out = np.full((len(x), last + 1 - first), np.nan)
                if own is not None:
                    out[some] = f(own)
                cols.append(pa.array(list(out), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *cols], names=[*keys, *(f"_{n}" for n in apply)])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + "".join(f", _{n} array<double>" for n in apply)
    each = rows.mapInArrow(run, schema).select(*keys, F.posexplode(F.arrays_zip(*[f"_{n}" for n in apply])).alias("_p", "_of"))
    return each.select(*keys, (F.col("_p") + first).cast("int").alias(order), *[F.when(~F.isnan(F.col("_of")[f"_{n}"]), F.col("_of")[f"_{n}"]).alias(n) for n in apply])
