"""Implausible readings: phase-space thresholding, runs of stuck values, bounds.

A reading is a point in phase space: its value (how far it lies from its level, or its size
against the usual one), first and second difference. Robust ellipsoids in the three planes of
these are made of medians over all readings of the series; what lies outside is taken out, and
the ellipsoids are made again, over ``ROUNDS`` rounds, so that in the end they are those of the clean series.
Then each reading is put back alone, and its radius is how many times the ellipsoids must grow to reach it.
Radii that join up with the clean readings' without a gap of ``times`` are the series' usual swing; a
reading beyond ``times`` that radius lies outside the series' ellipsoids and is a spike if its excursion ends within ``back`` rows.
Runs of equal values (differences of zero) and bounds catch the other faults.

A series is one field of one source in order. Series of up to ``TILE`` rows are hashed into groups and looked at once.
A longer one is cut by rank into tiles of at most ``TILE`` rows, each with ``HALO`` rows of its neighbours, and is looked at once
a round: what ellipsoids are made of (counts by bins of fixed ratio, sums) is added up over its tiles, so they are those of the
whole series and the result is that of one tile. No series, however long, comes into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tapeline.functions.clean import bar_ns, finite
from tapeline.operators.sessions import in_session
from tapeline.session import buckets

TILE, HALO = 50_000, 64
#: Readings on either side of the level around a reading.
AROUND = 7
#: Rounds of ellipsoids before those of the clean series.
ROUNDS = 3
#: Ratio of neighbouring bins of what is counted.
BIN = 1.02

SERIES = ["src", "source", "block", "field"]


def rolling_median(x: np.ndarray, around: int) -> np.ndarray:
    """Median of up to ``around`` values on either side and the value itself."""
    if len(x) <= 2 * around:
        return pd.Series(x).rolling(2 * around + 1, center=True, min_periods=1).median().to_numpy()
    out = np.empty(len(x))
    window = np.lib.stride_tricks.sliding_window_view(x, 2 * around + 1)
    out[around : len(x) - around] = np.median(window, axis=1)
    for i in range(around):
        out[i] = np.median(x[: i + around + 1])
        out[-1 - i] = np.median(x[len(x) - 1 - i - around :])
    return out


def signal(x: np.ndarray, rule: Rule, usual: float = np.nan) -> np.ndarray:
    """How far out each usable reading lies; 0 is where it should be.

    ``level``: distance from the level around it. ``size``: its size against the series' median, less one. ``around``: its
    size against the level around it, where the level is at least the median of the sizes above zero, less one. ``usual``
    is that median over the whole series; NaN if ``x`` is the whole series.
    """
    if rule.how == "level":
        return x - rolling_median(x, AROUND)
    if np.isnan(usual):
        usual = np.median(x[x > 0]) if (x > 0).any() else 1.0
    return x / (usual if rule.how == "size" else np.maximum(rolling_median(x, AROUND), usual)) - 1.0


def differences(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(s) < 2:
        return np.zeros(len(s)), np.zeros(len(s))
    first = np.gradient(s)
    return first, np.gradient(first)


def _bin(d: np.ndarray) -> np.ndarray:
    return np.ceil(np.log(np.maximum(d, 1e-300)) / np.log(BIN)).astype(np.int64)


def moments(s: np.ndarray, own: np.ndarray) -> dict:
    """What ellipsoids are made of, to be added up over the tiles of a series."""
    first, second = differences(s)
    out = {"n": int(own.sum()), "tilt_top": float((s * second)[own].sum()), "tilt_low": float((s * s)[own].sum())}
    for name, v in (("value", s), ("first", first), ("second", second)):
        b, n = np.unique(_bin(np.abs(v[own])), return_counts=True)
        out |= {f"{name}_bins": b.tolist(), f"{name}_counts": n.tolist()}
    return out


def ellipsoids(parts: list[dict], least: float) -> list[float]:
    """Half-axes of value, first and second difference (the greatest spread that noise of such a median reaches), and the tilt."""
    n = sum(p["n"] for p in parts)
    rate, axes = np.sqrt(2 * np.log(max(n, 2))), []
    for name in ("value", "first", "second"):
        b, counts = (np.concatenate([np.asarray(p[f"{name}_{k}"], np.int64) for p in parts]) for k in ("bins", "counts"))
        order = np.argsort(b, kind="stable")
        at = np.searchsorted(np.cumsum(counts[order]), (n + 1) // 2)
        middle = BIN ** float(b[order][min(at, len(b) - 1)]) if len(b) else 0.0
        # a series at rest most of the time has differences of zero, yet moves: they get at least a tenth of the value's axis
        axes.append(max(1.4826 * middle * rate, max(least, 1e-12) * rate, axes[0] / 10 if axes else 0.0))
    tilt = np.arctan2(sum(p["tilt_top"] for p in parts), sum(p["tilt_low"] for p in parts) or 1.0)
    return [*axes, round(float(tilt), 9)]


def radius(value: np.ndarray, first: np.ndarray, second: np.ndarray, axes: list[float]) -> np.ndarray:
    """How many times the ellipsoids must grow to reach each point: the greatest of the three planes."""
    a, b, c, tilt = axes
    a2, c2, cos2, sin2 = a * a, c * c, np.cos(tilt) ** 2, np.sin(tilt) ** 2
    flat = cos2 * cos2 - sin2 * sin2
    major, minor = (a2, c2) if abs(flat) < 1e-9 else ((a2 * cos2 - c2 * sin2) / flat, (c2 * cos2 - a2 * sin2) / flat)
    if min(major, minor) < 0.25 * min(a2, c2):  # value and second difference nearly on a line: no such ellipsoid
        major, minor, tilt = a2, c2, 0.0
    u, v = value * np.cos(tilt) + second * np.sin(tilt), second * np.cos(tilt) - value * np.sin(tilt)
    return np.sqrt(np.maximum.reduce([(value / a) ** 2 + (first / b) ** 2, (first / b) ** 2 + (second / c) ** 2, u * u / major + v * v / minor]))


def clean(s: np.ndarray, rule: Rule, rounds: list[list[float]], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The signal without what lies outside the ellipsoids of any of the rounds, and which readings those are.

    A neighbour of a spike has its differences, not its value: only what is itself off its level (of sizes, above it) is taken out.
    """
    z, out = s.copy(), np.zeros(len(s), bool)
    for axes in rounds:
        out |= (radius(z, *differences(z), axes) > 1) & ((z if rule.lift else np.abs(z)) > least)
        z[out] = 0.0
    return z, out


def alone(s: np.ndarray, z: np.ndarray, rule: Rule, axes: list[float]) -> np.ndarray:
    """The radius of each reading put back into the clean signal ``z`` by itself; sizes count from zero, and upwards only."""
    first, second = differences(z)
    r = radius(s + rule.lift, first, second + (z - s) / 2, axes)
    return np.where((s >= 0) | (rule.lift == 0), r, 0.0)


def usable(x: np.ndarray, positive: bool) -> np.ndarray:
    """Readings within the physical bounds: finite, and above zero or, if not ``positive``, at least zero."""
    with np.errstate(invalid="ignore"):
        return np.isfinite(x) & ((x > 0) if positive else (x >= 0))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values; NaN equals nothing."""
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return starts, np.diff(np.r_[starts, len(x)])


class Rule:
    """What holds for one field: how it is seen, its bounds, the least stuck run, whether zeros form runs."""

    def __init__(self, how: str, positive: bool, stuck: int, zero_runs: bool):
        self.how, self.positive, self.stuck, self.zero_runs = how, positive, stuck, zero_runs
        #: What is added to the signal where its size counts.
        self.lift = 0.0 if how == "level" else 1.0


RULES = {
    ("lob_records", "price"): Rule("level", True, 20, True),
    ("lob_records", "volume"): Rule("size", True, 20, True),
    ("minute_bars", "volume"): Rule("around", False, 12, False),
}


class Tile:
    """The readings of a tile, or of a whole series, in order; ``own`` tells them from the halo's."""

    def __init__(self, x: np.ndarray, own: np.ndarray, rule: Rule, usual: float = np.nan):
        self.x, self.own, self.rule = x, own, rule
        self.at = np.flatnonzero(usable(x, rule.positive))
        y = x[self.at]
        self.signal = signal(y, rule, usual) if len(y) else np.zeros(0)
        self.mine = own[self.at]
        # the smallest step between readings (a price's tick), which rounding noise does not make; a tenth of the usual size
        steps = np.abs(np.diff(y)) if rule.how == "level" else np.zeros(0)
        steps = steps[steps > 1e-6 * np.minimum(y[1:], y[:-1])] if len(steps) else steps
        self.least = (float(steps.min()) if len(steps) else 0.0) if rule.how == "level" else 0.1

    def moments(self, rounds: list[list[float]], least: float) -> dict:
        return moments(clean(self.signal, self.rule, rounds, least)[0], self.mine)

    def radii(self, rounds: list[list[float]], least: float) -> tuple[np.ndarray, np.ndarray]:
        """Radii in the clean series' ellipsoids, the last of ``rounds``, and which readings the rounds before took out."""
        z, out = clean(self.signal, self.rule, rounds[:-1], least)
        return alone(self.signal, z, self.rule, rounds[-1]), out

    def summary(self, rounds: list[list[float]], least: float) -> dict:
        """The widest radius of the clean readings, the bins of the others', and the runs at the tile's edges."""
        r, out = self.radii(rounds, least)
        usual = r[~out & self.mine]
        rows = self.x[self.own]
        starts, lengths = _runs(rows) if len(rows) else (np.zeros(0, int), np.zeros(0, int))
        values = rows[starts] if len(rows) else np.zeros(0)
        counted = lengths * (self.rule.zero_runs | (values != 0))
        ends = [0, len(lengths) - 1] if len(lengths) else []
        return {
            "widest": max(float(usual.max()) if len(usual) else 0.0, least / rounds[-1][0]),
            "bins": np.unique(_bin(r[out & self.mine])).tolist(),
            "edge_values": [float(values[k]) for k in ends],
            "edge_lengths": [int(counted[k]) for k in ends],
            "runs": len(lengths),
            "inner": [int(v) for v in np.sort(counted[1:-1])[::-1][:2]],
        }

    def flags(self, rounds: list[list[float]], least: float, threshold: float, stuck: int, goes_on: bool, where: str, back: int) -> np.ndarray:
        """Which own rows are cases."""
        bad = ~usable(self.x, self.rule.positive)
        far = self.radii(rounds, least)[0] > threshold
        if far.any():
            starts = np.flatnonzero(far & ~np.r_[False, far[:-1]])
            ends = np.flatnonzero(far & ~np.r_[far[1:], False])
            for s, e in zip(starts, ends, strict=True):
                if e - s + 1 <= back:
                    bad[self.at[s : e + 1]] = True
        if stuck:
            rows = np.flatnonzero(self.own)
            starts, lengths = _runs(self.x[rows])
            if where == "inner":
                k = int(np.argmax((lengths == stuck) & (self.rule.zero_runs | (self.x[rows[starts]] != 0))))
            else:
                k = 0 if where == "first" else len(lengths) - 1
            bad[rows[starts[k] + (not goes_on) : starts[k] + lengths[k]]] = True
        return bad & self.own


def merge(tiles: list[dict], rule: Rule, times: float) -> tuple[float, list[tuple[int, bool, str]]]:
    """The threshold of a series, and for each tile the length of the stuck run (0: none of it here), whether
    it goes on from the tile before, and which run of the tile it is: ``first``, ``inner`` or ``last``.

    The threshold is the widest usual radius times ``times``, after all readings have been taken in, from the
    smallest radius up, that lie within it.
    """
    widest = max(t["widest"] for t in tiles)
    for b in sorted({b for t in tiles for b in t["bins"]}):
        if BIN ** (b - 1) > times * widest:
            break
        widest = max(widest, BIN**b)
    whole: list[list] = []  # length, places [(tile, first, last)]
    for k, t in enumerate(tiles):
        if not t["runs"]:
            continue
        ends = [(t["edge_values"][0], t["edge_lengths"][0], True, t["runs"] == 1)]
        if t["runs"] > 1:
            ends.append((t["edge_values"][1], t["edge_lengths"][1], False, True))
        for value, length, first, last in ends:
            if first and whole and whole[-1][2] and whole[-1][3] == value:
                whole[-1][0] += length
                whole[-1][1].append((k, "first"))
                whole[-1][2] = last
            else:
                whole.append([length, [(k, "first" if first else "last")], last, value])
            if first and t["runs"] > 1:
                whole += [[n, [(k, "inner")], False, np.nan] for n in t["inner"]]
    order = sorted(range(len(whole)), key=lambda i: -whole[i][0])
    stuck: list[tuple[int, bool, str]] = [(0, False, "")] * len(tiles)
    if order:
        top = whole[order[0]]
        second = whole[order[1]][0] if len(order) > 1 else 0
        if top[0] >= rule.stuck and top[0] >= 3 * second:
            for j, (k, where) in enumerate(top[1]):
                own = tiles[k]["edge_lengths"][0] if where == "first" else tiles[k]["edge_lengths"][-1] if where == "last" else top[0]
                stuck[k] = (int(own), j > 0, where)
    return times * widest, stuck


def whole(x: np.ndarray, rule: Rule, times: float, back: int) -> np.ndarray:
    """Which rows of a whole series are cases."""
    tile, rounds = Tile(x, np.ones(len(x), bool), rule), []
    for _ in range(ROUNDS + 1):
        rounds.append(ellipsoids([tile.moments(rounds, tile.least)], tile.least))
    threshold, stuck = merge([tile.summary(rounds, tile.least)], rule, times)
    return tile.flags(rounds, tile.least, threshold, *stuck[0], back)


CASES = "src string, row_id long, field string, source string, block string, value double"
_KEY = "src string, source string, block string, field string, tile int, grp int"
_ROUND = (
    f"{_KEY}, least double, rounds array<array<double>>, n long, tilt_top double, tilt_low double, value_bins array<long>, value_counts array<long>, first_bins array<long>,"
    " first_counts array<long>, second_bins array<long>, second_counts array<long>"
)
_SUMMARY = f"{_KEY}, least double, rounds array<array<double>>, widest double, bins array<long>, edge_values array<double>, edge_lengths array<long>, runs int, inner array<long>"
_CONTEXT = f"{_KEY}, least double, rounds array<array<double>>"
_VERDICT = f"{_CONTEXT}, threshold double, stuck int, goes_on boolean, place string"


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _each(pdf: pd.DataFrame, key: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each key in order."""
    code = pdf.groupby(key, sort=False).ngroup().to_numpy()
    order = np.lexsort((pdf["row_id"].to_numpy(), pdf["ord"].to_numpy(), code))
    pdf, code = pdf.take(order), code[order]
    edges = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True]) if len(code) else np.zeros(1, int)
    names = [pdf[c].to_numpy() for c in key]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield tuple(n[lo] for n in names), pdf.iloc[lo:hi]


def spikes(readings: DataFrame, times: float = 3.0, back: int = 3) -> DataFrame:
    """Implausible readings of ``readings`` (src, source, block, field, ord, row_id, value).

    Null values are no readings. NaN and infinities are readings out of bounds. Ties of ``ord`` go by
    ``row_id``. Returns src, row_id, field, source, block, value, one row a case; an empty table gives none.
    Counts the rows of each series first, which sizes the groups and finds the series longer than ``TILE``.
    """
    x = readings.where(" AND ".join(f"{c} IS NOT NULL" for c in ("value", *SERIES)))
    span = x.groupBy(*SERIES).agg(
        F.min("ord").alias("_lo"), F.max("ord").alias("_hi"), F.count("*").alias("_rows"), F.count_if(_sizes()).alias("_sizes")
    )
    rows, longest = span.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.max("_rows"), F.lit(0))).first()
    many = buckets(rows, 2 * TILE, 12)
    group = lambda *by: F.pmod(F.xxhash64(*SERIES, *by), F.lit(many)).cast("int")

    def looked(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame(columns=_names(CASES))]
        for key, part in _each(pdf, SERIES):
            bad = whole(part["value"].to_numpy("float64"), RULES[key[0], key[3]], times, back)
            if bad.any():
                found.append(part[bad][_names(CASES)])
        return pd.concat(found[1:] or found)

    once = lambda df: df.select(*SERIES, "ord", "row_id", "value", group().alias("grp")).groupBy("grp").applyInPandas(looked, CASES)
    if longest <= TILE:
        return once(x)
    many_tiles = F.broadcast(span.where(F.col("_rows") > TILE))  # no more than a row for TILE readings
    long = _with_halos(_ranked(x.join(F.broadcast(_with_usual(x, many_tiles)), SERIES))).withColumn("grp", group("tile"))
    return once(x.join(many_tiles, SERIES, "left_anti")).unionByName(_in_tiles(long, times, back))


def _in_tiles(tiles: DataFrame, times: float, back: int) -> DataFrame:
    """The cases of series cut into tiles: a look a round, whose moments are added up over the tiles, one for the threshold, one for the cases."""

    def look(context: DataFrame | None, do, schema: str) -> DataFrame:
        def run(pdf: pd.DataFrame, known: pd.DataFrame | None = None) -> pd.DataFrame:
            rows = {} if known is None else {tuple(k[:5]): k[6:] for k in known.itertuples(index=False)}
            out = []
            for key, part in _each(pdf, [*SERIES, "tile"]):
                tile = Tile(part["value"].to_numpy("float64"), part["own"].to_numpy(bool), RULES[key[0], key[3]], float(part["usual"].iloc[0]))
                least, rounds, *rest = rows.get(key, (tile.least, []))
                got = do(part, tile, [list(r) for r in rounds], least, *rest)
                row = dict(zip(_names(_KEY), (*key, part["grp"].iloc[0]), strict=True), least=least, rounds=rounds)
                out.append(got if isinstance(got, pd.DataFrame) else pd.DataFrame([row | got]))
            return pd.concat(out)[_names(schema)] if out else pd.DataFrame(columns=_names(schema))

        if context is None:
            return tiles.groupBy("grp").applyInPandas(lambda pdf: run(pdf), schema)
        return tiles.groupBy("grp").cogroup(context.groupBy("grp")).applyInPandas(lambda pdf, known: run(pdf, known), schema)

    def merged(looked: DataFrame, of: str, do, schema: str) -> DataFrame:
        """What the tiles of each series give together, a row for each of them."""
        names = _names(of)[4:]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    parts = sorted(({k: t[k] for k in names} for t in row.tiles), key=lambda t: t["tile"])
                    given = do(parts, RULES[row.src, row.field], [list(r) for r in parts[0]["rounds"]])
                    out += [(row.src, row.source, row.block, row.field, t["tile"], t["grp"], *g) for t, g in zip(parts, given, strict=True)]
                yield pd.DataFrame(out, columns=_names(schema))

        return looked.groupBy(*SERIES).agg(F.collect_list(F.struct(*names)).alias("tiles")).mapInPandas(run, schema)

    def add_round(parts, rule, rounds):
        least = min((p["least"] for p in parts if p["least"] > 0), default=0.0)
        return [(least, [*rounds, ellipsoids(parts, least)])] * len(parts)

    def judge(parts, rule, rounds):
        threshold, stuck = merge(parts, rule, times)
        return [(parts[0]["least"], rounds, threshold, *s) for s in stuck]

    context = None
    for _ in range(ROUNDS + 1):
        looked = look(context, lambda part, tile, rounds, least: tile.moments(rounds, least), _ROUND)
        context = merged(looked, _ROUND, add_round, _CONTEXT)
    summaries = look(context, lambda part, tile, rounds, least: tile.summary(rounds, least), _SUMMARY)
    verdict = merged(summaries, _SUMMARY, judge, _VERDICT)
    return look(verdict, lambda part, tile, rounds, least, *rest: part[tile.flags(rounds, least, *rest, back)][_names(CASES)], CASES)


def _sizes() -> Column:
    """Usable readings above zero of the fields whose deviations are sizes."""
    fields = [f"{src}.{field}" for (src, field), rule in RULES.items() if rule.how != "level"]
    return F.concat_ws(".", "src", "field").isin(fields) & finite(F.col("value")) & (F.col("value") > 0)


def _with_usual(x: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` with ``usual``, the exact median of a series' sizes above zero: counts of its values, added up in their order."""
    counts = x.where(_sizes()).join(spans.select(*SERIES, "_sizes"), SERIES).groupBy(*SERIES, "_sizes", "value").agg(F.count("*").alias("_n"))
    below = F.sum("_n").over(W.partitionBy(*SERIES).orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    middle = [F.min(F.when(F.expr(f"_below > {k} DIV 2"), F.col("value"))) for k in ("(_sizes - 1)", "_sizes")]
    usual = counts.withColumn("_below", below).groupBy(*SERIES).agg(((middle[0] + middle[1]) / 2).alias("usual"))
    return spans.join(usual, SERIES, "left").withColumn("usual", F.coalesce("usual", F.lit(1.0)))


def _cell(lo: str, hi: str, rows: str) -> Column:
    """One of the equal ranges of ``ord`` from ``lo`` to ``hi``, four for each ``TILE`` of ``rows``; doubles, as far-off values overflow."""
    lo, hi, at = (F.col(c).cast("double") for c in (lo, hi, "ord"))
    cells = F.ceil(F.col(rows) * 4 / TILE)
    return F.least(F.floor((at - lo) / (hi - lo + 1.0) * cells), cells - 1)


def _ranked(long: DataFrame) -> DataFrame:
    """``long`` with ``_rank``, the exact place of a row in its series by ord and row_id.

    Ranges of ord are cut again between their own least and greatest, so one far-off value or a narrow stretch is
    spread too; rows are ranked in a range by a sort that spills, whatever it holds, and the ranges' counts added up.
    """
    first = long.withColumn("_c", _cell("_lo", "_hi", "_rows"))
    inner = first.groupBy(*SERIES, "_c").agg(F.min("ord").alias("_clo"), F.max("ord").alias("_chi"), F.count("*").alias("_crows"))
    cut = first.join(inner, [*SERIES, "_c"]).withColumn("_d", _cell("_clo", "_chi", "_crows"))
    before = W.partitionBy(*SERIES).orderBy("_c", "_d").rowsBetween(W.unboundedPreceding, -1)
    counts = cut.groupBy(*SERIES, "_c", "_d").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(W.partitionBy(*SERIES, "_c", "_d").orderBy("ord", "row_id"))
    return cut.withColumn("_place", place).join(starts, [*SERIES, "_c", "_d"]).withColumn("_rank", F.col("_start") + F.col("_place") - 1)


def _with_halos(ranked: DataFrame) -> DataFrame:
    """Each tile with up to ``HALO`` rows of the tiles beside it, marked as not its own; tiles of a series are alike to a row."""
    tiled = ranked.withColumn("_tiles", F.ceil(F.col("_rows") / TILE)).withColumn("_tile", F.expr("_rank * _tiles DIV _rows"))
    start = lambda t: F.expr(f"({t} * _rows + _tiles - 1) DIV _tiles")
    places = F.array_compact(
        F.array(
            F.struct(F.col("_tile").cast("int").alias("tile"), F.lit(True).alias("own")),
            F.when(
                (F.col("_rank") < start("_tile") + HALO) & (F.col("_tile") > 0),
                F.struct((F.col("_tile") - 1).cast("int").alias("tile"), F.lit(False).alias("own")),
            ),
            F.when(
                (F.col("_rank") >= start("(_tile + 1)") - HALO) & (F.col("_tile") < F.col("_tiles") - 1),
                F.struct((F.col("_tile") + 1).cast("int").alias("tile"), F.lit(False).alias("own")),
            ),
        )
    )
    return tiled.select(*SERIES, "ord", "row_id", "value", "usual", F.inline(places))


def table_readings(lob_records: DataFrame, minute_bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """The readings of both tables as :func:`spikes` takes them; bars outside a session are left out."""
    lob = lob_records.select(
        F.lit("lob_records").alias("src"),
        F.col("symbol").alias("source"),
        F.col("trade_date").alias("block"),
        F.col("seqno").alias("ord"),
        F.col("rec_id").alias("row_id"),
        F.expr("stack(2, 'price', price, 'volume', CAST(volume AS DOUBLE)) AS (field, value)"),
    )
    bars = in_session(
        minute_bars.select("bar_id", "ticker", "volume", bar_ns(F.col("profile"), F.col("window_start")).alias("ns")), sessions
    ).select(
        F.lit("minute_bars").alias("src"),
        F.col("ticker").alias("source"),
        F.col("session_date").alias("block"),
        F.col("ns").alias("ord"),
        F.col("bar_id").alias("row_id"),
        F.lit("volume").alias("field"),
        F.col("volume").alias("value"),
    )
    return lob.unionByName(bars).where(F.col("source").isNotNull() & F.col("block").isNotNull() & F.col("ord").isNotNull())
