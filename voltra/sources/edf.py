"""EDF, EDF+ and BDF recordings with one sampling rate."""

from __future__ import annotations

import re
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import EVENTS, Recording


def parse_header(raw: bytes) -> dict:
    text = lambda a, b: raw[a:b].decode("latin-1").strip()
    ns, start = int(text(252, 256)), 256
    fields = {}
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("samples", 8), ("reserved", 32)):
        fields[name] = [raw[start + i * width : start + (i + 1) * width].decode("latin-1").strip() for i in range(ns)]
        start += ns * width
    if text(192, 236).startswith(("EDF+D", "BDF+D")):
        raise ValueError("only continuous files can be read")
    return fields | {"bytes": 3 if raw[0] == 255 else 2, "header": int(text(184, 192)), "records": int(text(236, 244)), "seconds": float(text(244, 252))}


def annotations(raw: bytes) -> list[tuple[float, float, str]]:
    """(onset, duration, text) of the timestamped lists of a record."""
    out = []
    for tal in raw.split(b"\x00"):
        m = re.match(rb"([+-][\d.]+)(?:\x15([\d.]+))?\x14(.*)", tal, re.S)
        if m:
            out += [(float(m[1]), float(m[2] or 0), t.decode("utf-8")) for t in m[3].split(b"\x14") if t]
    return out


def read_edf(spark: SparkSession, path: str, recording: str | None = None) -> Recording:
    """One segment with all channels; events from annotations, or from rising edges of a status channel's low 16 bits."""
    content = spark.read.format("binaryFile").load(path)
    raw = bytes(content.select(F.expr("substring(content, 1, 1048576)")).first()[0])
    h = parse_header(raw)
    n = [int(v) for v in h["samples"]]
    notes = [i for i, v in enumerate(h["label"]) if "Annotations" in v]
    status = [i for i, v in enumerate(h["label"]) if v.lower() == "status"]
    if len(notes) > 1:
        warnings.warn("only the first annotation channel is read", stacklevel=2)
    signals = [i for i in range(len(n)) if i not in notes and i not in status]
    if len({n[i] for i in signals}) != 1:
        raise ValueError("channels have different sampling rates")
    rate, width = n[signals[0]] / h["seconds"], h["bytes"]
    names = [re.sub(r"\W", "_", h["label"][i]) for i in signals]

    def split(data: bytes):
        body = np.frombuffer(data, np.uint8, offset=h["header"])
        body = body[: h["records"] * sum(n) * width].reshape(h["records"], sum(n) * width)
        edges = np.cumsum([0, *n]) * width
        return [body[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def integers(part: np.ndarray) -> np.ndarray:
        b = np.ascontiguousarray(part).reshape(-1, width).astype(np.int64)
        v = sum(b[:, k] << (8 * k) for k in range(width))
        return np.where(v >= 1 << (8 * width - 1), v - (1 << (8 * width)), v)

    def decode(batches):
        for pdf in batches:
            for data in pdf["content"]:
                parts = split(bytes(data))
                out = {}
                for name, i in zip(names, signals, strict=True):
                    lo, hi, a, b = (float(h[k][i]) for k in ("dmin", "dmax", "pmin", "pmax"))
                    out[name] = (integers(parts[i]) - lo) * (b - a) / (hi - lo) + a
                table = pd.DataFrame(out)
                table.insert(0, "_sample", np.arange(1, len(table) + 1, dtype=np.int32))
                yield table

    def marks(batches):
        for pdf in batches:
            for data in pdf["content"]:
                parts, rows = split(bytes(data)), []
                for record in parts[notes[0]] if notes else ():
                    rows += [(1, None, t, int(round(o * rate)) + 1, int(round((o + d) * rate)) + 1, None) for o, d, t in annotations(record.tobytes())]
                for i in status[:1]:
                    v = integers(parts[i]) & 0xFFFF
                    rise = np.flatnonzero((v != np.append(0, v[:-1])) & (v > 0))
                    rows += [(1, "Status", str(v[k]), int(k) + 1, int(k) + 1, None) for k in rise]
                yield pd.DataFrame(rows, columns=["_id", "_type", "_description", "_initial", "_final", "_channel"])

    signal = content.select("content").mapInPandas(decode, "_sample int, " + ", ".join(f"`{c}` double" for c in names)).withColumn("_id", F.lit(1).cast("long"))
    events = content.select("content").mapInPandas(marks, EVENTS)
    segments = spark.createDataFrame([(1, recording or re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]), 1)], "_id long, _recording string, segment int")
    channels = {c: {"unit": h["unit"][i] or None} for c, i in zip(names, signals, strict=True)}
    return Recording(signal.select("_id", "_sample", *names), events, segments, rate, channels)
