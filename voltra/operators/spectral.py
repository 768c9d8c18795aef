"""Power spectra by Welch's method and power in bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Recording, Spectrum
from ..plans import segments

BANDS = {"delta": (0.5, 4), "theta": (4, 8), "alpha": (8, 12), "beta": (12, 30)}


def welch(v: np.ndarray, rate: float, window: int, overlap: float, nfft: int) -> np.ndarray:
    """One-sided density of each row: mean over Hamming windows of the detrended (overall mean) signal."""
    v = v - v.mean(axis=1, keepdims=True)
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(window) / max(1, window - 1))
    step = max(1, int(window * (1 - overlap)))
    frames = np.lib.stride_tricks.sliding_window_view(v, window, axis=1)[:, ::step]
    power = np.zeros((len(v), nfft // 2 + 1))
    for k in range(frames.shape[1]):
        power += np.abs(np.fft.rfft(frames[:, k] * w, nfft, axis=1)) ** 2
    power /= frames.shape[1] * rate * (w * w).sum()
    power[:, 1 : -1 if nfft % 2 == 0 else None] *= 2
    return power


def psd(x: Recording, method: str = "welch", window: int | None = None, overlap: float = 0.5, nfft: int | None = None) -> Spectrum:
    """Spectrum of each channel of each segment; a channel with nulls is null."""
    if method != "welch":
        raise ValueError("the method must be welch")
    names, rate = x.channel_names, x.rate

    def run(table, bounds):
        v, ids, out = segments.values(table, names), table.column("_id").to_numpy(), []
        for which, rows in segments.by_length(bounds):
            n = rows.shape[1]
            w = min(n, window or 1 << int(np.ceil(np.log2(np.sqrt(n)))))
            size = nfft or w
            power = welch(v[rows].transpose(0, 2, 1).reshape(-1, n), rate, w, overlap, size).reshape(len(which), len(names), -1)  # a null makes its channel null
            freq = np.fft.rfftfreq(size, 1 / rate)
            out.append(pa.table([pa.array(np.repeat(ids[rows[:, 0]], len(freq)), pa.int64()), pa.array(np.tile(freq, len(which))), *(segments.column(power[:, i].ravel()) for i in range(len(names)))], names=["_id", "_freq", *names]))
        return pa.concat_tables(out)

    table = segments.over(x.signal.select("_id", "_sample", *names), "_sample", "_id long, _freq double, " + ", ".join(f"`{c}` double" for c in names), run)
    return Spectrum(table, None, x.segments, x.rate, {c: x.channels[c] for c in names})


def simpson_weights(table: DataFrame, partition: list[str]) -> DataFrame:
    """``table`` with _w: composite Simpson weights along _freq (trapezoid for 2 points, and for the last interval of
    an even number of points)."""
    w = Window.partitionBy(*partition).orderBy("_freq")
    n, i = F.count("*").over(Window.partitionBy(*partition)), F.row_number().over(w)
    h = F.coalesce(F.lead("_freq").over(w) - F.col("_freq"), F.col("_freq") - F.lag("_freq").over(w), F.lit(0.0))
    t = table.withColumns({"_n": n, "_i": i, "_h": h})
    m = F.col("_n") - (F.col("_n") % 2 == 0).cast("int")
    inner = F.when(m < 3, 0.0).when((F.col("_i") == 1) | (F.col("_i") == m), 1 / 3).when(F.col("_i") > m, 0.0).when(F.col("_i") % 2 == 0, 4 / 3).otherwise(2 / 3)
    tail = F.when((F.col("_n") % 2 == 0) & (F.col("_i") >= F.col("_n") - 1), 0.5).otherwise(0.0)
    return t.withColumn("_w", (inner + tail) * F.col("_h")).drop("_n", "_i", "_h")


def power_band(x: Recording | Spectrum, bands: dict[str, tuple[float, float]] | None = None, relative: bool = False, **psd_options) -> Spectrum:
    """Integral of the spectrum in each (inclusive) band; _freq becomes the name of the band."""
    s = x if isinstance(x, Spectrum) else psd(x, **psd_options)
    bands, names = bands or BANDS, s.channel_names
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in bands.items()]))
    inside = s.signal.withColumn("_band", rows).filter(F.col("_freq").between(F.col("_band.a"), F.col("_band.b"))).withColumn("_b", F.col("_band.k"))
    table = simpson_weights(inside, ["_id", "_b"]).groupBy("_id", "_b").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in names])
    if relative:
        total = simpson_weights(s.signal, ["_id"]).groupBy("_id").agg(*[F.sum(F.col(c) * F.col("_w")).alias(f"_t_{c}") for c in names])
        table = table.join(total, "_id").withColumns({c: F.try_divide(F.col(c), F.col(f"_t_{c}")) for c in names})
    return s._with(signal=table.select("_id", F.col("_b").alias("_freq"), *names))
