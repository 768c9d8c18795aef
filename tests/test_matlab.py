"""FieldTrip and EEGLAB files (written here byte by byte), elliptic filters, layouts and component maps."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from voltra.model import Recording
from voltra.operators import dsp, ica, topography
from voltra.sources import layout, matlab


def element(kind, body):
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def array(value, name=""):
    """A matrix element of a str, a list (cell), a dict or tuple of dicts (struct) or numbers."""
    rows = (value,) if isinstance(value, dict) else value
    if isinstance(value, str):
        group, dims, parts = 4, (1, len(value)), [element(4, value.encode("utf-16-le"))]
    elif isinstance(value, list):
        group, dims, parts = 1, (1, len(value)), [array(v) for v in value]
    elif isinstance(rows, tuple):
        fields = list(rows[0])
        group, dims = 2, (1, len(rows))
        parts = [struct.pack("<HHI", 5, 4, 32), element(1, b"".join(f.encode().ljust(32, b"\0") for f in fields)), *(array(r[f]) for r in rows for f in fields)]
    else:
        v = np.atleast_2d(np.asarray(value, float))
        group, dims, parts = 6, v.shape, [element(9, v.tobytes(order="F"))]
    head = [element(6, struct.pack("<II", group, 0)), element(5, struct.pack(f"<{len(dims)}i", *dims)), element(1, name.encode())]
    return element(14, b"".join([*head, *parts]))


def write(path, compress=True, **variables):
    body = b"".join(array(v, k) for k, v in variables.items())
    if compress:
        packed = [zlib.compress(array(v, k)) for k, v in variables.items()]
        body = b"".join(struct.pack("<II", 15, len(p)) + p for p in packed)
    path.write_bytes(b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H2s", 0x0100, b"IM") + body)
    return str(path)


def test_fieldtrip(spark, tmp_path):
    rng = np.random.default_rng(1)
    trials = [rng.normal(size=(2, 30)) for _ in range(3)]
    events = tuple({"type": "trigger", "value": float(k) if k else "start", "sample": 105 + 100 * k, "duration": np.zeros((0, 0)) if k else 4.0, "offset": 0.0} for k in range(3))
    trl = [[101 + 100 * k, 130 + 100 * k, -10] for k in range(3)]
    data = {"label": ["Fz", "C z"], "fsample": 100.0, "time": [(np.arange(30) - 10) / 100] * 3, "trial": trials, "cfg": {"event": events, "trl": np.array(trl)}, "trialinfo": np.array([[7.0], [8.0], [9.0]])}
    layout = write(tmp_path / "lay.mat", lay={"pos": np.array([[0.5, 1.0], [2.0, 3.0]]), "label": ["Fz", "Oz"]})
    for compress in (True, False):
        with pytest.warns(UserWarning, match="not in the"):
            x = matlab.read_fieldtrip(spark, write(tmp_path / "s1.mat", compress, data=data), layout)
        s = x.signal.orderBy("_id", "_sample").toPandas()
        assert x.rate == 100 and x.channel_names == ["Fz", "C_z"] and x.channels["Fz"] == {"_x": 0.5, "_y": 1.0}
        assert np.array_equal(s[["Fz", "C_z"]].to_numpy(), np.concatenate([t.T for t in trials]))
        assert list(s["_sample"][:30]) == list(range(-9, 21))
        assert [tuple(r) for r in x.events.orderBy("_id").collect()] == [(1, "trigger", "start", -5, -2, None), (2, "trigger", "1", -5, -5, None), (3, "trigger", "2", -5, -5, None)]
        assert [(r._recording, r.V1) for r in x.segments.orderBy("_id").collect()] == [("s1", 7.0), ("s1", 8.0), ("s1", 9.0)]


def eeglab(data, trials, **more):
    return {"srate": 250.0, "trials": float(trials), "nbchan": 2.0, "pnts": 50.0, "data": data, "chanlocs": ({"labels": "Fz", "X": 1.0, "Y": 2.0, "Z": 3.0}, {"labels": "Cz", "X": 0.0, "Y": np.nan, "Z": 1.0})} | more


@pytest.mark.parametrize("kind", ["inline", "fdt", "dat"])
def test_eeglab_continuous(spark, tmp_path, kind):
    values = np.random.default_rng(2).normal(size=(2, 50)).astype("f4")
    (tmp_path / "a.fdt").write_bytes(values.T.tobytes())
    (tmp_path / "a.dat").write_bytes(values.tobytes())
    event = ({"type": "s1", "latency": 10.4, "duration": np.nan, "code": "Stimulus", "channel": 0.0}, {"type": 5.0, "latency": 20.0, "duration": 3.0, "code": "Bad", "channel": 2.0})
    eeg = eeglab(values if kind == "inline" else f"a.{kind}", 1, times=np.arange(50) * 4.0 - 40, event=event)
    x = matlab.read_eeglab(spark, write(tmp_path / "a.set", **(eeg if kind == "dat" else {"EEG": eeg})), "r1")
    s = x.signal.orderBy("_sample").toPandas()
    assert np.array_equal(s[["Fz", "Cz"]].to_numpy("f4"), values.T) and list(s["_sample"]) == list(range(-9, 41))
    assert x.channels["Fz"] == {"_x": 1.0, "_y": 2.0, "_z": 3.0} and x.channels["Cz"]["_y"] is None
    assert [tuple(r) for r in x.events.orderBy("_initial").collect()] == [(1, "Stimulus", "s1", 10, 10, None), (1, "Bad", "5", 20, 22, "Cz")]
    assert [tuple(r) for r in x.segments.collect()] == [(1, "r1", 1)]


def test_eeglab_epochs(spark, tmp_path):
    values = np.random.default_rng(3).normal(size=(2, 100))
    event = ({"type": "go", "latency": 11.0, "epoch": 1.0}, {"type": "late", "latency": 16.0, "epoch": 1.0}, {"type": "stop", "latency": 61.0, "epoch": 2.0})
    epoch = ({"event": np.array([1.0, 2.0]), "eventlatency": [0.0, 20.0]}, {"event": 3.0, "eventlatency": 0.0})
    for more in ({"epoch": epoch}, {}):
        x = matlab.read_eeglab(spark, write(tmp_path / "b.set", EEG=eeglab(values, 2, times=np.arange(50) * 4.0 - 40, event=event, **more)))
        s = x.signal.orderBy("_id", "_sample").toPandas()
        assert np.array_equal(s[["Fz", "Cz"]].to_numpy(), values.T) and list(s["_id"]) == [1] * 50 + [2] * 50
        assert [(r._id, r._description, r._initial, r._final) for r in x.events.orderBy("_id", "_initial").collect()] == [(1, "go", 1, 1), (1, "late", 6, 6), (2, "stop", 1, 1)]
        assert [(r._id, r.description) for r in x.segments.orderBy("_id").collect()] == [(1, "go"), (2, "stop")]


def test_other_files_are_refused(tmp_path):
    for raw in (b"\x89HDF\r\n\x1a\n" + bytes(200), b"MATLAB 7.3 MAT-file".ljust(200), bytes(200)):
        with pytest.raises(ValueError):
            matlab.load(raw)


@pytest.mark.parametrize("order", [3, 4, 6])
@pytest.mark.parametrize("low,high", [(None, 30), (30, None), (20, 40), (40, 20)])
def test_elliptic_ripples(order, low, high):
    f = np.linspace(0.5, 249, 4000)
    z = np.exp(-2j * np.pi * f / 500)
    db = 20 * np.log10(np.abs(np.prod([np.polyval(b[::-1], z) / np.polyval(a[::-1], z) for b, a in dsp.iir(500, low, high, "ellip", order)], axis=0)) + 1e-300)
    passes = f <= high if low is None else f >= low if high is None else (f >= low) & (f <= high) if low < high else (f <= high) | (f >= low)
    assert db[passes].min() > -1.001 and db[passes].max() < 1e-6
    assert (db[~passes] < -39.99).mean() > 0.3 and db[np.abs(f - (low or high)) > 60].max() < 1e-6


def test_layout_has_the_published_places():
    places = layout.layout_32_1020()
    assert len(places) == 34 and [places["F3"][k] for k in ("_x", "_y", "_z")] == [-0.55, 0.67, 0.5] and places["M1"]["_x"] is None
    assert [places["Oz"][k] for k in ("_x", "_y", "_z")] == pytest.approx([0, -1, 0])


def test_component_maps_and_nearest_nodes(spark):
    rng = np.random.default_rng(5)
    names = ["Fz", "Cz", "C3", "Pz"]
    mixed = rng.laplace(size=(400, 4)) @ rng.normal(size=(4, 4))
    signal = spark.createDataFrame([(1, k + 1, *map(float, v)) for k, v in enumerate(mixed)], "_id long, _sample int, " + ", ".join(f"{n} double" for n in names))
    every = layout.layout_32_1020()
    x = ica.fit(Recording.from_df(signal, 100, channels={n: every[n] for n in names}))
    maps = topography.component_maps(x, points=15)
    by = maps.groupBy("_ica").agg(F.avg("_value").alias("m"), F.stddev_samp("_value").alias("s"), F.count("_key").alias("n")).collect()
    assert len(by) == 4 and all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 and r.n == 4 for r in by)
    node = topography.topo_data(maps, ["_recording", "_ica"]).toPandas()
    assert len(node) == maps.filter("_key is null").count()
    first, places = node[node["_ica"] == node["_ica"].iloc[0]], maps.filter("_key is not null").toPandas().drop_duplicates("_key")
    for e in places.to_dict("records"):
        d = np.hypot(first["_x"] - e["_x"], first["_y"] - e["_y"])
        assert d[first["_key"] == e["_key"]].tolist() == pytest.approx([d.min()])
