"""Irregular readings onto a regular grid: a Kalman smoother with a continuous-time local trend.

State: level and slope, whose slope is a Wiener process and whose level has a
Wiener part of its own, so that between two times dt apart
``F = [[1, dt], [0, 1]]`` and ``Q = q * [[dt + dt^3/3, dt^2/2], [dt^2/2, dt]]`` with
slope noise scaled by ``SLOPE``. The smoother runs over the grid times and all
readings at their own times, merged; what comes out is the level at each grid time with
its standard deviation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.clean import MINUTE_NS, bar_ns, finite
from tapeline.operators.sessions import in_session

#: Slope noise in units of level noise, per minute.
SLOPE = 1e-3
#: Ratios of measurement to process noise of which each series takes the likeliest.
NOISE_RATIOS = (0.01, 0.1, 1.0, 10.0)


#: Series smoothed at once: bounds the memory of a task, which keeps some 20 numbers for each series, grid time and reading.
AT_ONCE = 256


def smooth(at: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Level at the grid times 0 to ``width - 1`` and its standard deviation, for many series at once.

    ``at`` is series x readings, times within [0, width) in order, ``y`` the readings; rows are filled up with NaN at
    the end. A series needs one reading at least. With a single reading its level holds throughout; the deviation
    grows with the distance from it.
    """
    many = len(y)
    start, scale = y[:, 0], np.empty(many)
    for i in range(many):
        k = int((~np.isnan(y[i])).sum())
        gap = np.diff(at[i, :k])
        steps = np.diff(y[i, :k])[gap > 0] / np.sqrt(gap[gap > 0])
        s = np.median(np.abs(steps)) * 1.4826 if len(steps) else 0.0
        scale[i] = s or (np.sqrt(np.mean(steps**2)) if len(steps) else 0.0) or max(abs(start[i]), 1.0) * 1e-6
    # grid times and readings in one order, a reading at a grid time after it
    times = np.concatenate([np.broadcast_to(np.arange(width, dtype=float), (many, width)), at], axis=1)
    values = np.concatenate([np.full((many, width), np.nan), (y - start[:, None]) / scale[:, None]], axis=1)
    order = np.argsort(times, axis=1, kind="stable")
    times, values = np.take_along_axis(times, order, 1), np.take_along_axis(values, order, 1)
    steps = np.diff(np.where(np.isnan(times), np.nanmax(times, axis=1, keepdims=True), times), axis=1, prepend=0.0)
    z, dt = np.ascontiguousarray(values.T), np.ascontiguousarray(steps.T)
    best, ratio = np.full(many, -np.inf), np.ones(many)
    for r in NOISE_RATIOS:
        like = _filter(z, dt, np.full(many, r), keep=False)
        ratio = np.where(like > best, r, ratio)
        best = np.maximum(like, best)
    level, deviation = _filter(z, dt, ratio, keep=True)
    on_grid = order < width
    level, deviation = level.T[on_grid].reshape(many, width), deviation.T[on_grid].reshape(many, width)
    return level * scale[:, None] + start[:, None], deviation * scale[:, None]


def _filter(z: np.ndarray, dt: np.ndarray, ratio: np.ndarray, keep: bool):
    """Log likelihood, or with ``keep`` the smoothed level and deviation, all times x series.

    ``z`` is NaN where there is no reading, ``dt`` the time since the one before. Process noise is taken so that one
    period's change and the measurement have variance one together: q = 1 / (1 + 2 * ratio), r = ratio * q.
    """
    length, many = z.shape
    q = 1.0 / (1.0 + 2.0 * ratio)
    r = ratio * q
    m0, m1 = np.zeros(many), np.zeros(many)
    p00, p01, p11 = np.full(many, 1e4), np.zeros(many), np.full(many, 1e-2)
    like = np.zeros(many)
    past = []
    seen = ~np.isnan(z)
    for t in range(length):
        d = dt[t]
        before = (m0, m1, p00, p01, p11)
        m0 = m0 + d * m1
        p00, p01, p11 = (
            p00 + 2 * d * p01 + d * d * p11 + q * (d + SLOPE * d**3 / 3),
            p01 + d * p11 + q * SLOPE * d * d / 2,
            p11 + q * SLOPE * d,
        )
        if keep:
            past.append((before, (m0, m1, p00, p01, p11)))
        has = seen[t]
        if has.any():
            s = p00 + r
            e = np.where(has, z[t] - m0, 0.0)
            k0, k1 = np.where(has, p00 / s, 0.0), np.where(has, p01 / s, 0.0)
            like -= np.where(has, 0.5 * (np.log(s) + e * e / s), 0.0)
            m0, m1 = m0 + k0 * e, m1 + k1 * e
            p11 = p11 - k1 * p01
            p00, p01 = (1 - k0) * p00, (1 - k0) * p01
    if not keep:
        return like
    level, variance = np.empty((length, many)), np.empty((length, many))
    s0, s1, v00, v01, v11 = m0, m1, p00, p01, p11
    for t in range(length - 1, -1, -1):
        before, (a0, a1, a00, a01, a11) = past[t]
        d = dt[t]
        level[t], variance[t] = s0, v00
        b0, b1, b00, b01, b11 = before
        # gain = P F' inv(predicted P)
        c00, c01 = b00 + d * b01, b01
        c10, c11 = b01 + d * b11, b11
        det = a00 * a11 - a01 * a01
        det = np.where(np.abs(det) < 1e-300, 1e-300, det)
        g00, g01 = (c00 * a11 - c01 * a01) / det, (c01 * a00 - c00 * a01) / det
        g10, g11 = (c10 * a11 - c11 * a01) / det, (c11 * a00 - c10 * a01) / det
        d0, d1 = s0 - a0, s1 - a1
        e00, e01, e11 = v00 - a00, v01 - a01, v11 - a11
        s0, s1 = b0 + g00 * d0 + g01 * d1, b1 + g10 * d0 + g11 * d1
        v00, v01, v11 = (
            b00 + g00 * g00 * e00 + 2 * g00 * g01 * e01 + g01 * g01 * e11,
            b01 + g00 * g10 * e00 + (g00 * g11 + g01 * g10) * e01 + g01 * g11 * e11,
            b11 + g10 * g10 * e00 + 2 * g10 * g11 * e01 + g11 * g11 * e11,
        )
    return level, np.sqrt(np.maximum(variance, 0.0))


def to_grid(
    readings: DataFrame, source: str, block: str, start: str, end: str, at: str, value: str, order: list[str], step: int
) -> DataFrame:
    """One row for each source, block of time and grid step in ``[start, end)``.

    ``readings`` holds usable readings only, each with the bounds ``start`` and ``end`` of its block. All of them go
    into the smoother at their own times; of several with one stamp ``at`` the last by ``order`` counts, before
    anything is gathered. What is gathered is a source's block, which its length and the finest time between readings
    bound: choose blocks (days, sessions) that a task can hold. Each block is smoothed by itself, since what happens
    between blocks (a closed market, a sensor switched off) is no part of the process; so a gap at a block's start is
    filled from the readings after it only.

    Columns: source, block, ``grid_at`` (start of the step), ``reading`` (the step's last, null if
    there is none), ``missing``, ``filled`` and ``filled_sd``. A source without a
    reading in a block has no rows there. An empty table gives no rows.
    """
    last = readings.groupBy(source, block, start, end, at).agg(
        F.max(F.struct(*[F.col(c) for c in order], F.col(value).cast("double").alias("_v")))["_v"].alias("_v")
    )
    kind = dict(readings.dtypes)
    gathered = last.groupBy(source, block, start, end).agg(
        F.sort_array(F.collect_list(F.struct((F.col(at) - F.col(start)).alias("o"), F.col("_v").alias("v")))).alias("_all")
    )
    packed = gathered.select(source, block, start, end, F.col("_all.o").alias("_o"), F.col("_all.v").alias("_v"))
    schema = (
        f"`{source}` {kind[source]}, `{block}` {kind[block]}, `{start}` long,"
        " reading array<double>, filled array<double>, filled_sd array<double>"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            steps = -(-(pdf[end].to_numpy("int64") - pdf[start].to_numpy("int64")) // step)
            for width in np.unique(steps):
                rows = np.flatnonzero(steps == width)
                # series with about as many readings come together, so that few places stay empty
                rows = rows[np.argsort([len(pdf["_o"].iloc[i]) for i in rows], kind="stable")]
                for lo in range(0, len(rows), AT_ONCE):
                    yield part(pdf.iloc[rows[lo : lo + AT_ONCE]], int(width))

    def part(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
        longest = max(map(len, pdf["_o"]))
        at, y, last = np.full((len(pdf), longest), np.nan), np.full((len(pdf), longest), np.nan), np.full((len(pdf), width), np.nan)
        for k, (o, v) in enumerate(zip(pdf["_o"], pdf["_v"], strict=True)):
            at[k, : len(o)], y[k, : len(o)] = np.asarray(o, float) / step, v
            last[k, np.asarray(o, np.int64) // step] = v  # in order, so the last one of a step stays
        level, deviation = smooth(at, y, width)
        out = pdf[[source, block, start]].copy()
        out["reading"], out["filled"], out["filled_sd"] = list(last), list(level), list(deviation)
        return out

    dense = packed.mapInPandas(run, schema)
    return dense.select(
        source, block, F.col(start), F.posexplode(F.arrays_zip("reading", "filled", "filled_sd")).alias("_i", "_z")
    ).select(
        source,
        block,
        (F.col(start) + F.col("_i").cast("long") * F.lit(step)).alias("grid_at"),
        F.when(~F.isnan("_z.reading"), F.col("_z.reading")).alias("reading"),
        (F.col("_z.reading").isNull() | F.isnan("_z.reading")).alias("missing"),
        F.col("_z.filled").alias("filled"),
        F.col("_z.filled_sd").alias("filled_sd"),
    )


def minute_grid(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Closes of minute bars on the minutes of each regular session, both profiles together.

    A close is usable if it is not null, finite and above 0; rows with an unknown
    profile, a null stamp or a null ticker are no readings. Ties of one stamp go to
    the row loaded last, then to the greater ``bar_id``. Exact copies change nothing.
    A session is a block: its smoother begins anew at the open.
    """
    readings = in_session(
        bars.select("bar_id", "ticker", "close", "loaded_at", bar_ns(F.col("profile"), F.col("window_start")).alias("ns"))
        .where(F.col("ticker").isNotNull() & F.col("ns").isNotNull() & finite(F.col("close")) & (F.col("close") > 0)),
        sessions,
    )
    return to_grid(readings, "ticker", "session_date", "open_ns", "close_ns", "ns", "close", ["loaded_at", "bar_id"], MINUTE_NS)
