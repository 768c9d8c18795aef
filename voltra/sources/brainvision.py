"""BrainVision recordings: header, markers and binary or text samples; and writing them."""

from __future__ import annotations

import math
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EVENTS, Recording
from ..operators.timeline import unsegment

_KINDS = {"INT_16": "<i2", "UINT_16": "<u2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4", "IEEE_FLOAT_64": "<f8"}
#: Bytes of a data file (of interleaved channels) above which it is read in splits of as many, instead of as one row.
BLOCK = 64 << 20


def read_ini(text: str) -> dict[str, dict[str, str]]:
    """Sections of key=value; keys keep their case, ``;`` and ``#`` start comment lines, other lines go under ``""``."""
    out, section = {"": {}}, ""
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] in ";#":
            continue
        if line[0] == "[" and line[-1] == "]":
            section = line[1:-1]
            out.setdefault(section, {})
        elif "=" in line:
            k, v = line.split("=", 1)
            out[section][k] = v
    return out


def write_ini(sections: dict[str, dict[str, str]], title: str) -> str:
    return "\n\n".join([title, *("\n".join([f"[{s}]", *(f"{k}={v}" for k, v in kv.items())]) for s, kv in sections.items())]) + "\n"


def _read(spark: SparkSession, path: str) -> bytes:
    """One (small) file by Spark's own reader, so any store works."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def spherical_to_xyz(radius: float, theta: float, phi: float) -> tuple[float | None, float | None, float | None]:
    if not radius:
        return None, None, None
    t, p = math.radians(theta), math.radians(phi)
    return tuple(round(v, 2) for v in (radius * math.sin(t) * math.cos(p), radius * math.sin(t) * math.sin(p), radius * math.cos(t)))


def xyz_to_spherical(x: float | None, y: float | None, z: float | None) -> tuple[float, float, float]:
    if x is None or y is None or z is None:
        return 0.0, 0.0, 0.0
    r = math.sqrt(x * x + y * y + z * z)
    theta = math.degrees(math.acos(z / r)) * (-1 if x < 0 else 1)
    phi = math.degrees(math.atan(y / x)) if x else math.copysign(90.0, y) if y else 0.0
    return 1.0, round(theta, 2), round(phi, 2)


def read_header(text: str) -> dict:
    """Channels (name, resolution, unit, place), rate, format and files of a header; names are made unique."""
    ini = read_ini(text)
    common = ini["Common Infos"]
    if common.get("DataType", "TIMEDOMAIN") != "TIMEDOMAIN":
        raise ValueError("only time-domain data can be read")
    coordinates, channels = ini.get("Coordinates", {}), {}
    for k in sorted(ini["Channel Infos"], key=lambda s: int(s[2:])):
        name, ref, res, unit = ([p.replace(r"\1", ",") for p in ini["Channel Infos"][k].split(",")] + ["", "", ""])[:4]
        name = re.sub(r"\W", "_", name) or f"Ch{k[2:]}"
        while name in channels:
            name = re.sub(r"_(\d+)$", lambda m: f"_{int(m[1]) + 1}", name) if re.search(r"_\d+$", name) else f"{name}_1"
        r, t, p = (float(v) for v in coordinates.get(k, "0,0,0").split(",")[:3])
        x, y, z = spherical_to_xyz(r, t, p)
        channels[name] = {"_reference": ref or None, "resolution": float(res) if res else 1.0, "unit": unit.replace("µ", "u").replace("μ", "u") or "uV", "_x": x, "_y": y, "_z": z}
    kind = ini.get("Binary Infos", {}).get("BinaryFormat", "INT_16") if common.get("DataFormat", "BINARY") == "BINARY" else "ASCII"
    return {"channels": channels, "rate": 1e6 / float(common["SamplingInterval"]), "kind": kind, "orientation": common.get("DataOrientation", "MULTIPLEXED"), "data": common["DataFile"], "markers": common.get("MarkerFile"), "points": int(common.get("SegmentDataPoints", 0) or 0), "ascii": ini.get("ASCII Infos", {})}


def read_markers(text: str) -> list[tuple]:
    """(type, description, initial, final, channel number) of each marker; a size below 2 is one sample."""
    out = []
    for k, v in read_ini(text).get("Marker Infos", {}).items():
        if re.fullmatch(r"Mk\d+", k):
            kind, text_, at, size, channel = ([p.replace(r"\1", ",") for p in v.split(",")] + ["0"] * 5)[:5]
            first = max(1, int(at or 1))
            out.append((kind or None, text_ or None, first, first + max(0, int(size or 1) - 1), int(channel or 0)))
    return out


def _records(spark: SparkSession, path: str, width: int) -> DataFrame:
    """_at (byte place) and content of every ``width`` bytes of a file, read in splits; no DataFrame source has these."""
    conf = {"fixedlengthinputformat.record.length": str(width), "mapreduce.input.fileinputformat.split.maxsize": str(max(width, BLOCK))}
    rows = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
    return spark.createDataFrame(rows.map(lambda r: (r[0], bytes(r[1]))), "_at long, content binary", verifySchema=False)


def read_vhdr(spark: SparkSession, path: str, sep: str = "_type = 'New Segment'", zero: str = "_type = 'Time 0'", recording: str | None = None) -> Recording:
    """A recording from its header file: a segment from each event that ``sep`` picks, sample 1 at the event in it that
    ``zero`` picks (or at its start)."""
    folder, stem = os.path.dirname(path), os.path.splitext(os.path.basename(path))[0]
    local = lambda f: os.path.join(folder, f.replace("$b", stem))
    head = read_header(_text(_read(spark, path)))
    names = list(head["channels"])
    n, scale, kind, multi = len(names), np.array([c["resolution"] for c in head["channels"].values()]), head["kind"], head["orientation"] == "MULTIPLEXED"
    skip = int(head["ascii"].get("SkipLines", 0)), int(head["ascii"].get("SkipColumns", 0))

    def decode(batches):
        for pdf in batches:
            # records of one sample each go together; a whole file is one row
            contents = [b"".join(pdf["content"])] if "_at" in pdf else pdf["content"]
            for content in contents:
                if kind == "ASCII":
                    lines = bytes(content).decode("latin-1").replace(",", ".").splitlines()[skip[0] :]
                    m = np.array([[float(x) for x in ln.split()[skip[1] :]] for ln in lines if ln.strip()])
                    m = (m if multi else m.T) * scale
                else:
                    flat = np.frombuffer(bytes(content), _KINDS[kind]).astype(float)
                    m = (flat.reshape(-1, n) if multi else flat.reshape(n, -1).T) * scale
                sample = pdf["_at"].to_numpy() // width + 1 if "_at" in pdf else np.arange(1, len(m) + 1)
                k = np.searchsorted(bounds[:, 1], sample, side="right") - 1  # the segment a sample lies in
                ok = k >= 0
                k, m, sample = k[ok], m[ok], sample[ok]
                yield pd.DataFrame(m, columns=names).assign(_id=bounds[k, 0], _sample=(sample - bounds[k, 2] + 1).astype(np.int32))[["_id", "_sample", *names]]

    marks = read_markers(_text(_read(spark, local(head["markers"])))) if head["markers"] else []
    rows = [(1, t, d, i, f, names[c - 1] if 0 < c <= n else None) for t, d, i, f, c in marks]
    events = spark.createDataFrame(rows, EVENTS)
    starts = sorted(r["_initial"] for r in events.filter(sep).select("_initial").distinct().collect())  # markers of one file
    if not starts:
        raise ValueError("no event separates segments")
    zeros = sorted(r["_initial"] for r in events.filter(zero).select("_initial").distinct().collect())
    spans = []
    for i, s in enumerate(starts):
        stop = starts[i + 1] - 1 if i + 1 < len(starts) else 2_000_000_000
        spans.append((i + 1, s, next((z for z in zeros if s <= z <= stop), s), stop))
    spans_df = spark.createDataFrame(spans, "_new long, _lower int, _first int, _upper int")
    bounds = np.array(spans, np.int64)
    width = 0 if kind == "ASCII" else n * np.dtype(_KINDS[kind]).itemsize
    whole = spark.read.format("binaryFile").load(local(head["data"]))
    large = width and multi and whole.select("length").first()[0] > BLOCK
    content = _records(spark, local(head["data"]), width) if large else whole.select("content")
    signal = content.mapInPandas(decode, "_id long, _sample int, " + ", ".join(f"`{c}` double" for c in names))
    cut = events.drop("_id").join(F.broadcast(spans_df), (F.col("_initial") <= F.col("_upper")) & (F.col("_final") >= F.col("_lower"))).select(F.col("_new").alias("_id"), "_type", "_description", (F.greatest("_initial", "_lower") - F.col("_first") + 1).alias("_initial"), (F.least("_final", "_upper") - F.col("_first") + 1).alias("_final"), "_channel")
    segments = spark.createDataFrame([(i, recording or stem, i) for i, *_ in spans], "_id long, _recording string, segment int")
    return Recording(signal, cut, segments, head["rate"], head["channels"])


def _encoded(batches):
    for b in batches:
        m = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["content"])


def write_vhdr(x: Recording, path: str, overwrite: bool = False) -> list[str]:
    """One header, marker and float32 data file per recording in the local folder of ``path``; the names written."""
    recordings = sorted(r["_recording"] for r in x.segments.select("_recording").distinct().collect())
    stem = os.path.splitext(path)[0]
    written = []
    for r in recordings:
        base = stem if len(recordings) == 1 else f"{stem}_{r}"
        if not overwrite and os.path.exists(base + ".vhdr"):
            raise FileExistsError(base + ".vhdr")
        one = unsegment(x.filter(F.col("_recording") == r).na_omit())
        names, b = one.channel_names, os.path.basename(base)
        with open(base + ".dat", "wb") as f:  # encoded by tasks, streamed a partition at a time
            for row in one.signal.orderBy("_sample").select(*names).mapInArrow(_encoded, "content binary").toLocalIterator():
                f.write(row["content"])
        info = {f"Ch{i}": f"{c},{x.channels[c].get('_reference') or ''},1,{x.channels[c].get('unit') or 'uV'}" for i, c in enumerate(names, 1)}
        place = {f"Ch{i}": ",".join(f"{v:g}" for v in xyz_to_spherical(*(x.channels[c].get(k) for k in ("_x", "_y", "_z")))) for i, c in enumerate(names, 1)}
        head = {"Common Infos": {"Codepage": "UTF-8", "DataFile": b + ".dat", "MarkerFile": b + ".vmrk", "DataFormat": "BINARY", "DataOrientation": "MULTIPLEXED", "DataType": "TIMEDOMAIN", "NumberOfChannels": str(len(names)), "SamplingInterval": f"{1e6 / x.rate:.10g}"}, "Binary Infos": {"BinaryFormat": "IEEE_FLOAT_32"}, "Channel Infos": info, "Coordinates": place}
        events = one.events.fillna("", ["_type", "_description"]).distinct().orderBy("_initial", "_type").collect()
        marks = {f"Mk{i}": f"{(e['_type'] or '').replace(',', chr(92) + '1')},{(e['_description'] or '').replace(',', chr(92) + '1')},{e['_initial']},{e['_final'] - e['_initial'] + 1},{names.index(e['_channel']) + 1 if e['_channel'] in names else 0}" for i, e in enumerate(events, 1)}
        with open(base + ".vhdr", "w", encoding="utf-8") as f:
            f.write(write_ini(head, "Brain Vision Data Exchange Header File Version 2.0"))
        with open(base + ".vmrk", "w", encoding="utf-8") as f:
            f.write(write_ini({"Common Infos": {"Codepage": "UTF-8", "DataFile": b + ".dat"}, "Marker Infos": marks}, "Brain Vision Data Exchange Marker File, Version 2.0"))
        written.append(base + ".vhdr")
    return written


def write_tables(x: Recording, path: str) -> None:
    """The three tables as Parquet, signal clustered by id."""
    x.signal.repartitionByRange("_id", "_sample").sortWithinPartitions("_id", "_sample").write.parquet(f"{path}/signal")
    for n, t in (("events", x.events), ("segments", x.segments)):
        if t is not None:
            t.write.parquet(f"{path}/{n}")


def read_tables(spark: SparkSession, path: str, rate: float, channels: dict[str, dict] | None = None) -> Recording:
    t: dict[str, DataFrame] = {n: spark.read.parquet(f"{path}/{n}") for n in ("signal", "events", "segments")}
    return Recording.from_df(t["signal"], rate, t["events"], t["segments"], channels)
