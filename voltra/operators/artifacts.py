"""Artifact detectors: rolling windows in Catalyst, runs of hits merged to events by gaps and islands."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import selectors as sel
from ..functions.timing import clamp, scaling
from ..model import Recording
from ..plans import segments


def dense(x: Recording, names: list[str]) -> DataFrame:
    """Signal with a row for each sample between the first and last of its segment; absent ones are null.

    Each row brings the absent samples up to the next one, so a gap is as much as one row makes.
    """
    after = F.lead("_sample").over(Window.partitionBy("_id").orderBy("_sample"))
    ahead = x.signal.select("_id", "_sample", *names, F.greatest(F.coalesce(after - F.col("_sample") - 1, F.lit(0)), F.lit(0)).alias("_gap"))
    rows = ahead.select("_id", "_sample", *names, F.explode(F.sequence(F.lit(0), "_gap")).alias("_k"))
    real = F.col("_k") == 0
    return rows.select("_id", (F.col("_sample") + F.col("_k")).cast(x.signal.schema["_sample"].dataType).alias("_sample"), *[F.when(real, F.col(c)).alias(c) for c in names])


def _samples(value: float, rate: float, unit: str) -> int:
    n = clamp(value * scaling(rate, unit))
    if n < 1:
        raise ValueError("the window is shorter than a sample")
    return n


def intervals(hits: DataFrame, x: Recording, names: list[str], lim: tuple[float, float], unit: str, description: str) -> DataFrame:
    """Artifact events from boolean columns: each hit spans ``lim`` around it, overlapping or touching spans are one."""
    scale = scaling(x.rate, unit)
    low, high = (clamp(v * scale) for v in lim)
    ends = x.signal.groupBy("_id").agg(F.min("_sample").alias("_lo"), F.max("_sample").alias("_hi"))
    long = hits.unpivot(["_id", "_sample"], names, "_channel", "_hit").filter("_hit").join(ends, "_id")
    start, stop = F.col("_sample").cast("long") + low, F.col("_sample").cast("long") + high
    spans = long.select("_id", "_channel", F.when(start < F.col("_lo") - 1, F.col("_lo")).otherwise(start).cast("int").alias("_a"), F.least(stop, F.col("_hi")).cast("int").alias("_z"))
    w = Window.partitionBy("_id", "_channel").orderBy("_a", "_z")
    fresh = (F.col("_a") - 1 > F.max("_z").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    runs = spans.withColumn("_new", F.coalesce(fresh, F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    merged = runs.groupBy("_id", "_channel", "_run").agg(F.min("_a").alias("_initial"), F.max("_z").alias("_final"))
    return merged.select("_id", F.lit("artifact").alias("_type"), F.lit(description).alias("_description"), "_initial", "_final", "_channel")


def _found(x: Recording, tests: dict[str, Column], table: DataFrame, lim, unit, description) -> Recording:
    hits = table.select("_id", "_sample", *[F.coalesce(t, F.lit(False)).alias(c) for c, t in tests.items()])
    return x._with(events=intervals(hits, x, list(tests), lim, unit, description).unionByName(x.events, allowMissingColumns=True))


def _source(x: Recording, names: list[str], freq, config: dict | None) -> Recording:
    """The chosen channels filtered between the two frequencies (None: open); a segment with nulls is null."""
    if freq is None:
        return x
    from .dsp import pass_between

    config = dict(config or {})
    return pass_between(x, *names, freq=freq, method=config.pop("method", "fir"), na_rm=True, config=config)


def _narrow(window: float, lim: tuple[float, float]) -> None:
    if window > lim[1] - lim[0]:
        warnings.warn("the window is wider than what is marked", stacklevel=3)


def artif_minmax(x: Recording, *channels, threshold: float, window: float, lim=(-0.2, 0.2), direction: str = "above", unit: str = "s", freq=None, config: dict | None = None) -> Recording:
    """Range of the last ``window`` at least (or, below, at most) the threshold; nulls are ignored."""
    names, n = sel.resolve(x.channel_names, *channels), _samples(window, x.rate, unit)
    w = Window.partitionBy("_id").orderBy("_sample")
    r = w.rowsBetween(-(n - 1), 0)
    _narrow(window, lim)
    table = dense(_source(x, names, freq, config), names).withColumn("_nth", F.row_number().over(w))
    span = {c: F.max(c).over(r) - F.min(c).over(r) for c in names}
    tests = {c: (F.col("_nth") >= n) & (v >= threshold if direction == "above" else v <= threshold) for c, v in span.items()}
    return _found(x, tests, table, lim, unit, f"minmax_threshold={threshold:g}_window={window:g}")


def artif_step(x: Recording, *channels, threshold: float, window: float, lim=(-0.2, 0.2), direction: str = "above", unit: str = "s", freq=None, config: dict | None = None) -> Recording:
    """Means of the two halves of the (even) window differ by at least the threshold; a null in either is no hit."""
    names, n = sel.resolve(x.channel_names, *channels), _samples(window, x.rate, unit)
    _narrow(window, lim)
    half = (n + n % 2) // 2
    w = Window.partitionBy("_id").orderBy("_sample")
    a, b = w.rowsBetween(-(half - 1), 0), w.rowsBetween(1, half)
    table = dense(_source(x, names, freq, config), names)
    mean = lambda c, r: F.when(F.count(c).over(r) == half, F.avg(c).over(r))
    diff = {c: F.abs(mean(c, b) - mean(c, a)) for c in names}
    return _found(x, {c: d >= threshold if direction == "above" else d <= threshold for c, d in diff.items()}, table, lim, unit, f"step_threshold={threshold:g}_window={window:g}")


def artif_amplitude(x: Recording, *channels, threshold: tuple[float, float], lim=(-0.2, 0.2), unit: str = "s", freq=None, config: dict | None = None) -> Recording:
    """Values at or beyond either threshold."""
    if len(threshold) < 2:
        raise ValueError("two thresholds are needed")
    low, high = sorted(threshold)
    names = sel.resolve(x.channel_names, *channels)
    table = dense(_source(x, names, freq, config), names)
    return _found(x, {c: (F.col(c) <= low) | (F.col(c) >= high) for c in names}, table, lim, unit, f"amplitude_threshold={low:g},{high:g}")


def peaks(v: np.ndarray, least: float, apart: int, rise: float = 1e-4) -> np.ndarray:
    """Ends of a rise that a fall follows at once, of at least ``least`` and ``rise`` above the foot of the rise and of the
    fall (so nothing flat); the highest first, none less than ``apart`` samples from a higher one. Nulls end rise and fall."""
    if len(v) < 3:
        return np.zeros(0, int)
    d = np.diff(v)
    up, down = d > 0, d < 0
    at = np.flatnonzero(up[:-1] & down[1:]) + 1
    i = np.arange(len(v))
    left = np.maximum.accumulate(np.where(np.append(True, ~up), i, 0))  # where the rise to a place began
    right = np.minimum.accumulate(np.where(np.append(~down, True), i, len(v))[::-1])[::-1]
    at = at[(v[at] >= least) & (v[at] - np.maximum(v[left[at]], v[right[at]]) >= rise)]
    kept: list[int] = []
    for p in at[np.argsort(-v[at], kind="stable")].tolist():
        if all(abs(p - q) >= apart for q in kept):
            kept.append(p)
    return np.array(sorted(kept), int)


def artif_peak(x: Recording, *channels, threshold: float, window: float, lim=(-0.2, 0.2), unit: str = "s", freq=None, config: dict | None = None) -> Recording:
    """Peaks of at least the threshold; picking the highest in a window is sequential, so segments go to Python."""
    names, n = sel.resolve(x.channel_names, *channels), _samples(window, x.rate, unit)

    _narrow(window, lim)

    def pick(table, bounds):
        v = segments.values(table, names)
        hit = np.zeros(v.shape, bool)
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for i in range(len(names)):
                hit[a + peaks(v[a:z, i], threshold, n), i] = True
        return pa.table([table.column("_id"), table.column("_sample"), *(pa.array(hit[:, i]) for i in range(len(names)))], names=["_id", "_sample", *names])

    hits = segments.over(dense(_source(x, names, freq, config), names), "_sample", "_id long, _sample int, " + ", ".join(f"`{c}` boolean" for c in names), pick)
    return x._with(events=intervals(hits, x, names, lim, unit, f"peak_threshold={threshold:g}_window={window:g}").unionByName(x.events, allowMissingColumns=True))
