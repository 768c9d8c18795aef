"""Recordings from objects with the interface of raw recordings in MNE-Python (optional; nothing is imported)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from ..model import EVENTS, Recording


def from_mne(spark: SparkSession, raw, recording: str = "recording1") -> Recording:
    """Channels but the stimulus ones; annotations ``type/description`` become events, bad channels artifact events."""
    kinds = raw.get_channel_types()
    names = [c for c, k in zip(raw.ch_names, kinds, strict=True) if k != "stim"]
    data = np.asarray(raw.get_data(picks=names)).T
    rate = float(raw.info["sfreq"])
    table = pd.DataFrame(data, columns=names)
    table.insert(0, "_sample", np.arange(1, len(table) + 1, dtype="int32"))
    table.insert(0, "_id", 1)
    rows = []
    for a in raw.annotations:
        kind, _, text = str(a["description"]).partition("/")
        first = round(a["onset"] * rate) + 1
        rows.append((1, kind, text or None, first, first + max(0, round(a["duration"] * rate) - 1), None))
    rows += [(1, "artifact", "bad", 1, len(table), c) for c in raw.info.get("bads", []) if c in names]
    segments = spark.createDataFrame([(1, recording, 1)], "_id long, _recording string, segment int")
    places = {c["ch_name"]: [float(v) for v in c["loc"][:3]] for c in raw.info.get("chs", [])}
    known = lambda p: p is not None and all(np.isfinite(p)) and any(p)
    channels = {c: dict(zip(("_x", "_y", "_z"), places[c], strict=True)) if known(places.get(c)) else {} for c in names}
    return Recording.from_df(spark.createDataFrame(table), rate, spark.createDataFrame(rows, EVENTS), segments, channels)


def read_fif(spark: SparkSession, path: str, recording: str | None = None) -> Recording:
    """A FIF file through MNE-Python, where that is installed."""
    try:
        from mne.io import read_raw_fif
    except ImportError as e:
        raise ImportError("FIF files are read through MNE-Python, which is not installed") from e
    return from_mne(spark, read_raw_fif(path, preload=True), recording or path.rsplit("/", 1)[-1].removesuffix(".fif"))
