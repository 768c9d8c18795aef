"""Projections of electrode positions, interpolated maps, and tables for plots (no renderer)."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Recording
from .ica import IcaRecording


def polar(x, y, z):
    az, el = np.arctan2(y, x), np.arctan2(z, np.hypot(x, y))
    r = np.pi / 2 - el
    return r * np.cos(az), r * np.sin(az)


def stereographic(x, y, z):
    r = np.sqrt(x * x + y * y + z * z)
    k = 2 / (1 + z / r)
    return k * x / r, k * y / r


def orthographic(x, y, z):
    return x, y


PROJECTIONS = {"polar": polar, "stereographic": stereographic, "orthographic": orthographic}


def change_coord(channels: dict[str, dict], projection: str = "polar") -> dict[str, dict]:
    """Channel facts with _x and _y projected and _z gone; channels without _z keep x and y (with a warning)."""
    fn, out = PROJECTIONS[projection], {}
    for c, v in channels.items():
        if v.get("_x") is None or v.get("_y") is None:
            out[c] = dict(v)
        elif v.get("_z") is None:
            warnings.warn(f"{c} has no z: left as it is", stacklevel=2)
            out[c] = dict(v)
        else:
            a, b = fn(float(v["_x"]), float(v["_y"]), float(v["_z"]))
            out[c] = v | {"_x": float(a), "_y": float(b), "_z": None}
    return out


def _basis(t: np.ndarray) -> np.ndarray:
    return np.stack([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3], -1) / 6


def bspline_map(x: np.ndarray, y: np.ndarray, v: np.ndarray, gx: np.ndarray, gy: np.ndarray, levels: int = 8) -> np.ndarray:
    """Multilevel B-spline approximation of scattered values on the points (gx, gy)."""
    lo, hi = np.array([min(x.min(), gx.min()), min(y.min(), gy.min())]), np.array([max(x.max(), gx.max()), max(y.max(), gy.max())])
    span = np.where(hi > lo, hi - lo, 1)
    left, out = v.astype(float).copy(), np.zeros(len(gx))
    for level in range(levels):
        m = 1 << level
        num, den = np.zeros((m + 4, m + 4)), np.zeros((m + 4, m + 4))

        def place(px, py, m=m):
            s, t = (px - lo[0]) / span[0] * m, (py - lo[1]) / span[1] * m
            i, j = np.clip(s.astype(int), 0, m - 1), np.clip(t.astype(int), 0, m - 1)
            return i, j, _basis(s - i)[:, :, None] * _basis(t - j)[:, None, :]

        i, j, w = place(x, y)
        w2 = (w * w).sum((1, 2))
        for k in range(len(x)):
            at = np.s_[i[k] : i[k] + 4, j[k] : j[k] + 4]
            num[at] += w[k] ** 2 * (w[k] * left[k] / w2[k])
            den[at] += w[k] ** 2
        phi = np.divide(num, den, out=np.zeros_like(num), where=den > 0)

        def at_points(px, py, phi=phi, place=place):
            i, j, w = place(px, py)
            return np.array([(phi[a : a + 4, b : b + 4] * ww).sum() for a, b, ww in zip(i, j, w, strict=True)])

        out += at_points(gx, gy)
        left -= at_points(x, y)
    return out


def interpolate(table: DataFrame, groups: list[str], points: int = 40, radius: float = 1.2) -> DataFrame:
    """``groups``, _key (null on the grid), _x, _y, _value of a table with _key, _x, _y and _value: the electrodes of
    each group and a grid of values within ``radius`` times the farthest of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["_x", "_y", "_value"])
        if pdf["_key"].duplicated().any():
            raise ValueError("more than one value for a channel in a group: summarise first")
        if len(pdf) < 2:
            raise ValueError("a single point cannot be interpolated")
        x, y, v = (pdf[c].to_numpy(float) for c in ("_x", "_y", "_value"))
        r = radius * np.hypot(x, y).max()
        a, b = np.meshgrid(np.linspace(-r, r, points), np.linspace(-r, r, points))
        inside = np.hypot(a, b) <= r
        a, b = a[inside], b[inside]
        grid = pd.DataFrame({"_key": None, "_x": a, "_y": b, "_value": bspline_map(x, y, v, a, b)})
        both = pd.concat([grid, pdf[["_key", "_x", "_y", "_value"]]])
        for g in groups:
            both[g] = pdf[g].iloc[0]
        return both[[*groups, "_key", "_x", "_y", "_value"]]

    kinds = dict(table.dtypes)
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "_key string, _x double, _y double, _value double"])
    return table.groupBy(*groups).applyInPandas(run, schema)


def _places(x: Recording, projection: str) -> DataFrame:
    """_key, _x, _y: one row for each channel with a place."""
    place = change_coord({c: v for c, v in x.channels.items() if v.get("kind") != "component"}, projection)
    rows = [(c, v["_x"], v["_y"]) for c, v in place.items() if v.get("_x") is not None]
    return x.signal.sparkSession.createDataFrame(rows, "_key string, _x double, _y double")


def interpolate_recording(x: Recording, groups: list[str], projection: str = "polar", **options) -> DataFrame:
    """Mean of each channel by ``groups``, at its projected place, interpolated."""
    means = x.to_long().groupBy(*groups, "_key").agg(F.avg("_value").alias("_value"))
    return interpolate(means.join(F.broadcast(_places(x, projection)), "_key"), groups, **options)


def topo_data(maps: DataFrame, groups: list[str]) -> DataFrame:
    """The grid of ``interpolate``, with the name of each electrode as _key of the node nearest to it (ties: the lower,
    then the further left; of electrodes at one node the first by name)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf[pdf["_key"].isna()].sort_values(["_y", "_x"]).reset_index(drop=True)
        for e in pdf[pdf["_key"].notna()].sort_values("_key", ascending=False).to_dict("records"):
            grid.loc[int(np.argmin((grid["_x"] - e["_x"]) ** 2 + (grid["_y"] - e["_y"]) ** 2)), "_key"] = e["_key"]
        return grid[pdf.columns]

    return maps.groupBy(*groups).applyInPandas(run, maps.schema)


def component_maps(x: IcaRecording, projection: str = "polar", standardize: bool = True, **options) -> DataFrame:
    """_recording, _ica, _key, _x, _y, _value: the weights of each component interpolated over the head, and (if
    ``standardize``) centred and scaled within each map."""
    m = x.matrices().join(F.broadcast(_places(x, projection)), F.col("_channel") == F.col("_key")).drop("_channel")
    maps = interpolate(m, ["_recording", "_ica"], **options)
    own = Window.partitionBy("_recording", "_ica")
    if not standardize:
        return maps
    return maps.withColumn("_value", F.try_divide(F.col("_value") - F.avg("_value").over(own), F.stddev_samp("_value").over(own)))


def plot_data(x: Recording, max_sample: int | None = None) -> DataFrame:
    """Long table a plot needs, thinned out to ``max_sample`` samples a segment."""
    if max_sample and x.order == "_sample":
        from .dsp import downsample

        x = downsample(x, max_sample=max_sample)
    return x.to_long()


def plot_limits(x: Recording, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Limits of a plot by channel: quantiles times 1.5."""
    return x.to_long().groupBy("_key").agg(*[(F.percentile("_value", q) * 1.5).alias(n) for n, q in (("low", low), ("high", high))])


def event_data(x: Recording) -> DataFrame:
    """One row an event and channel it is about."""
    every = F.array(*[F.lit(c) for c in x.channel_names])
    return x.events.withColumn("_key", F.explode(F.when(F.col("_channel").isNull(), every).otherwise(F.array("_channel")))).drop("_channel")
