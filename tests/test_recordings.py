"""Expectations on small recordings with known samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltra.functions import channels as chf
from voltra.functions import selectors as sel
from voltra.functions import timing
from voltra.model import EVENTS, Recording
from voltra.operators import artifacts, dsp, ica, spectral, timeline, topography
from voltra.plans.routing import na_mean, names, over
from voltra.sources import brainvision, edf, mne_bridge, synthetic
from voltra.streaming import detectors


def make(spark, columns, ids=(1,), first=1, events=(), conditions=None, rate=500):
    n = len(next(iter(columns.values()))) // len(ids)
    rows = [(i, first + k, *[None if columns[c][j * n + k] is None else float(columns[c][j * n + k]) for c in columns]) for j, i in enumerate(ids) for k in range(n)]
    signal = spark.createDataFrame(rows, "_id long, _sample int, " + ", ".join(f"{c} double" for c in columns))
    segments = spark.createDataFrame([(i, "recording1", j + 1, (conditions or "aba")[j % 3]) for j, i in enumerate(ids)], "_id long, _recording string, segment int, condition string")
    return Recording.from_df(signal, rate, spark.createDataFrame(list(events), EVENTS), segments)


@pytest.fixture(scope="module")
def sincos(spark):
    n = np.arange(1, 31)
    e = [(1, "New Segment", None, -4, -4, None), (1, "Bad", None, -2, 0, None), (1, "Time 0", None, 1, 1, None), (1, "Bad", None, 2, 3, "X"), (2, "New Segment", None, -4, -4, None), (2, "Time 0", None, 1, 1, None), (2, "Bad", None, 2, 2, "Y"), (3, "New Segment", None, -4, -4, None), (3, "Time 0", None, 1, 1, None), (3, "Bad", None, 2, 2, "Y")]
    return make(spark, {"X": np.sin(n), "Y": np.cos(n)}, (1, 2, 3), -4, e)


@pytest.fixture(scope="module")
def data0(spark):
    n = np.arange(1, 21)
    e = [(1, "New Segment", None, 1, 1, None), (1, "Bad", None, 3, 5, None), (1, "Time 0", None, 6, 6, None), (1, "Bad", None, 7, 8, "X"), (1, "New Segment", None, 11, 11, None), (1, "Time 0", None, 16, 16, None), (1, "Bad", None, 17, 17, "Y")]
    return make(spark, {"X": np.sin(n), "Y": np.cos(n)}, (1,), 1, e)


def values(x, *cols):
    return [tuple(r) for r in x.signal.orderBy("_id", "_sample").select(*cols).collect()]


def spans(x):
    return sorted((r._channel, r._initial, r._final) for r in x.events.filter("_type = 'artifact'").collect())


def test_time_and_samples(spark):
    assert [timing.as_sample(t, 256) for t in (0, 1 / 256, -1 / 256)] == [1, 2, 0]
    assert timing.as_sample(5, 1, "s") == 6 and timing.as_sample(5, 500, "sample") == 5
    assert timing.clamp(float("-inf")) == -2_000_000_000 and timing.clamp(2.5) == 2
    with pytest.raises(ValueError):
        timing.scaling(500, "hours")


def test_segmentation(data0):
    one = timeline.segment(data0, "_type = 'Time 0'", lim=(0, 1 / 500))
    assert one.signal.count() == 4 and one.segments.count() == 2
    assert values(one, "_id", "_sample", "X")[0] == (1, 1, pytest.approx(np.sin(6)))
    for lim, unit in (((0, 1), "sample"), ((0, 2), "ms")):
        assert values(timeline.segment(data0, "_type = 'Time 0'", lim=lim, unit=unit), "_id", "_sample", "X") == values(one, "_id", "_sample", "X")
    assert timeline.segment(data0, "_type = 'Time 0'", lim=(-20, 20), unit="samples").signal.count() == 40
    assert timeline.segment(data0, "_type = 'Time 0'", lim=(float("-inf"), float("inf"))).signal.count() == 40
    with pytest.raises(ValueError):
        timeline.segment(data0, "_type = 'Time 0'", lim=(1, 0))
    with pytest.warns(UserWarning):
        ended = timeline.segment(data0, "_type = 'New Segment'", end="_type = 'Time 0'")
    assert ended.signal.groupBy("_id").count().orderBy("_id").collect() == [(1, 6), (2, 6)]
    back = timeline.unsegment(timeline.segment(data0, "_type = 'New Segment'", lim=(0, 9), unit="samples"))
    assert values(back, "_sample", "X") == values(data0, "_sample", "X")
    late = timeline.unsegment(timeline.segment(data0, "_type = 'New Segment'", lim=(0, 9), unit="samples"), start=101, sep={"_type": "cut", "_description": "a"}, zero={"_type": "zero"})
    assert values(late, "_sample")[0] == (101,) and late.signal.count() == 20
    assert sorted((e._type, e._initial) for e in late.events.filter("_type in ('cut', 'zero')").collect()) == [("cut", 101), ("cut", 111), ("zero", 101), ("zero", 111)]
    once = timeline.unsegment(data0)
    assert once.events.filter("_type = 'New Segment'").count() == 3 and once.events.filter("_type = 'Time 0'").count() == 2


def test_events_to_na_and_baseline(sincos):
    two = sincos.filter("_id < 3")
    seg = timeline.events_to_na(two, "_type = 'Bad'")
    assert seg.events.count() == 4
    assert seg.signal.filter("_id = 1 and (X is not null or Y is not null)").count() == 0
    assert seg.signal.filter("_id = 2 and X is not null and Y is null").count() == 10
    part = timeline.events_to_na(two, "_type = 'Bad'", entire_seg=False, drop_events=False)
    got = {(r._id, r._sample): (r.X is None, r.Y is None) for r in part.signal.collect()}
    assert {k for k, v in got.items() if v == (True, True)} == {(1, -2), (1, -1), (1, 0)} and got[(1, 2)] == got[(1, 3)] == (True, False) and got[(2, 2)] == (False, True)
    many = timeline.events_to_na(two, "_type = 'Bad'", n_chs=1)
    assert many.signal.filter("X is not null or Y is not null").count() == 0
    base = timeline.baseline(sincos).signal.filter("_sample <= 0").groupBy("_id").agg(F.avg("X").alias("m"))
    assert all(abs(r.m) < 1e-12 for r in base.collect())


def test_verbs(sincos, spark):
    m = sincos.mutate(X="X * 2", Y="X + 1", both="upper(condition)")
    assert values(m, "Y")[0][0] == pytest.approx(np.sin(1) + 1) and "both" in m.segments.columns
    assert sincos.mutate(c2="_sample + 1").channel_names == ["X", "Y"]
    g = sincos.group_by("condition").mutate(D="X - avg(X)")
    assert abs(g.signal.join(g.segments, "_id").groupBy("condition").agg(F.avg("D").alias("m")).agg(F.max("m")).first()[0]) < 1e-9
    t = sincos.transmute(Z="X + Y")
    assert t.signal.columns == ["_id", "_sample", "Z"] and t.segments.columns == ["_id", "_recording"] and t.events.filter("_channel is not null").count() == 0
    f = sincos.filter("_sample > 1")
    assert f.events.filter("_type = 'Time 0'").count() == 0 and f.signal.count() == 12
    assert sincos.filter("condition = 'b'").signal.count() == 10 and sincos.filter("_id = 1", "X > 0").segments.count() == 1
    s = sincos.select("-Y")
    assert s.channel_names == ["X"] and s.events.filter("_channel = 'Y'").count() == 0 and sincos.signal.columns == ["_id", "_sample", "X", "Y"]
    r = sincos.rename(ZZ="Y")
    assert r.events.filter("_channel = 'ZZ'").count() == 2 and r.channel_names == ["X", "ZZ"]
    assert sincos.rename_with(str.lower).channel_names == ["x", "y"]
    with pytest.raises(ValueError):
        sincos.rename_with(str.lower, "_recording")
    with pytest.raises(ValueError):
        sincos.group_by("nothing")
    with pytest.warns(UserWarning):
        assert "condition" in sincos.group_by("condition").select("X", "segment").segments.columns
    assert sincos.slice_signal(11, 30).signal.select("_id").distinct().count() == 2
    assert sincos.select(sel.starts_with("X") | sel.ends_with("Y")).nchannels == 2 and sel.resolve(["a1", "a2", "b"], -sel.num_range("a", [1])) == ["a2", "b"]
    assert over("X - avg(X) + lag(X)", ["g"], ["_sample"]) == "X - avg(X) OVER (PARTITION BY `g`) + lag(X) OVER (PARTITION BY `g` ORDER BY _sample)"
    assert sincos.to_long().count() == 60 and sincos.nsamples().filter("n_samples = 10").count() == 3
    assert sincos["X"] is not None and sincos.validate() == [] and sincos.channels_table().count() == 2
    with pytest.raises(KeyError):
        sincos["nothing"]
    with pytest.raises(TypeError):
        sincos.left_join([1], ["a"])
    with pytest.raises(TypeError):
        Recording.from_df(spark.createDataFrame([(1, 1, "a")], "_id int, _sample int, X string"), channels={"X": {}})


def test_summaries_joins_and_binding(sincos, spark):
    one = sincos.summarize(m=F.avg("X"))
    assert one.segments.count() == 1 and one.events.count() == 0 and one.signal.count() == 1
    by = sincos.group_by("condition", "_sample").summarize(X=na_mean("X"), v="var_samp(Y)")
    assert by.signal.count() == 20 and by.segments.select("condition").distinct().count() == 2
    assert timeline.events_to_na(sincos, "_type = 'Bad'").count_complete_cases("condition").orderBy("condition").collect() == [("a", 0), ("b", 0)]
    twice = Recording.bind(sincos, sincos.filter("_id > 1"))
    assert twice.signal.count() == 50 and twice.segments.agg(F.max("_id")).first()[0] == 5 and twice.events.count() == 16
    with pytest.warns(UserWarning):
        assert Recording.bind(sincos, sincos.select("X")).signal.filter("Y is null").count() == 30
    t = spark.createDataFrame([("a", 1)], "condition string, extra int")
    assert sincos.left_join(t, ["condition"]).segments.filter("extra is null").count() == 1
    assert sincos.semi_join(t, ["condition"]).signal.count() == 20 and sincos.anti_join(t, ["condition"]).events.count() == 3
    assert sincos.na_omit().signal.count() == 30 and timeline.events_to_na(sincos, "_type = 'Bad'").drop_incomplete_segments().segments.count() == 0
    assert {r._recording: (r.n_segments, r.n_incomplete) for r in sincos.summary()["segments"].collect()} == {"recording1": (3, 0)}
    ref = chf.rereference(sincos, ref=["X", "Y"])
    assert values(ref, "X")[0][0] == pytest.approx((np.sin(1) - np.cos(1)) / 2) and ref.channels["X"]["_reference"] == "X, Y"
    assert chf.chs_mean(sincos).channel_names == ["mean"]
    got = values(chf.chs_fun(sincos, {"sd": "sd", "median": "median"}), "sd", "median")[0]
    assert got == (pytest.approx(np.std([np.sin(1), np.cos(1)], ddof=1)), pytest.approx((np.sin(1) + np.cos(1)) / 2))


def test_step_and_minmax(spark):
    x = make(spark, {"X": [0] * 4 + [10] * 5})
    step = lambda lim, w=2, y=x: spans(artifacts.artif_step(y, threshold=0.01, window=w, lim=lim, unit="samples"))
    mm = lambda lim, w=2, t=0.01, y=x: spans(artifacts.artif_minmax(y, threshold=t, window=w, lim=lim, unit="samples"))
    assert [step(v) for v in ((0, 1), (0, 0), (-1, 0), (-1000, 1000))] == [[("X", 4, 5)], [("X", 4, 4)], [("X", 3, 4)], [("X", 1, 9)]]
    assert [mm(v) for v in ((0, 1), (0, 0), (-1, 0), (-1000, 1000))] == [[("X", 5, 6)], [("X", 5, 5)], [("X", 4, 5)], [("X", 1, 9)]]
    assert step((0, 1), 3) == step((0, 1), 4)
    assert mm((0, 4), 2, 19, make(spark, {"X": [0, 0, 0, -10, 10, 0, 0, 0, 0]})) == [("X", 5, 9)]
    gap = x.filter("_sample not in (4, 5)")
    assert step((-1000, 1000), 2, gap) == [] and mm((-1000, 1000), 2, 0.01, gap) == [] and mm((-1000, 1000), 4, 0.01, gap) == [("X", 1, 9)]


def test_amplitude_and_peak(spark):
    v = np.zeros(50)
    v[9], v[10], v[30], v[33] = 10, 5, -10, 4
    x = make(spark, {"X": v})
    assert spans(artifacts.artif_amplitude(x, threshold=(-5, 5), lim=(-1, 1), unit="samples")) == [("X", 9, 12), ("X", 30, 32)]  # 5 is at the threshold
    with pytest.raises(ValueError):
        artifacts.artif_amplitude(x, threshold=(5,))
    assert spans(artifacts.artif_peak(x, threshold=3, window=5, lim=(0, 0), unit="samples")) == [("X", 10, 10), ("X", 34, 34)]
    y = np.array([0, 5, 0, 6, 0, 0, 0, 4, 0.0])
    assert artifacts.peaks(y, 1, 2).tolist() == [1, 3, 7] and artifacts.peaks(y, 1, 3).tolist() == [3, 7]
    assert artifacts.peaks(np.array([0, 5, 5, 0, 3, 3 - 1e-6, 4, np.nan, 7, 1, 1.00001, 1]), 1, 1).tolist() == []  # flat, too small, at a null
    flat = make(spark, {"X": [0, 10, 10, 0, 3, 0]})
    assert spans(artifacts.artif_peak(flat, threshold=3, window=1, lim=(0, 0), unit="samples")) == [("X", 5, 5)]


def test_detectors_filter_what_they_look_at(spark):
    n = np.arange(1, 601)
    v = np.sin(2 * np.pi * 80 * n / 500) * 5
    v[300:] += 50
    x = make(spark, {"X": v, "Y": [None if i == 7 else 0.0 for i in range(600)]})
    bare = artifacts.artif_step(x, "X", threshold=20, window=10, lim=(0, 0), unit="samples")
    for freq in ((None, 40), (None, None), (0.5, 200)):
        assert spans(artifacts.artif_step(x, "X", threshold=20, window=10, lim=(0, 0), unit="samples", freq=freq)) != [] != spans(bare)
    assert spans(artifacts.artif_amplitude(x, threshold=(-9, 1000), lim=(0, 0), unit="samples", freq=(None, 40))) == []  # 80 Hz is gone, Y has a null
    assert spans(artifacts.artif_amplitude(x, "X", threshold=(-48, 48), lim=(0, 0), unit="samples", freq=(40, None), config={"method": "iir"})) == []


def test_fir_stops_what_it_should_and_keeps_each_width():
    gain = lambda h, f, rate=500: abs(np.sum(h * np.exp(-2j * np.pi * f / rate * np.arange(len(h)))))
    for stop in ((52, 48), (55, 45)):
        with pytest.raises(ValueError, match="cross"):
            dsp.fir(500, *stop)
    notch = dsp.fir(500, 52, 48, low_width=1, high_width=1)
    assert gain(notch, 50) < 0.01 and abs(gain(notch, 40) - 1) < 0.01 and abs(gain(notch, 60) - 1) < 0.01
    assert gain(dsp.fir(500, 222.8, 119.4), 158) < 0.01
    h = dsp.fir(500, 1, 40)
    assert len(h) == 1651 and abs(gain(h, 20) - 1) < 0.01 and gain(h, 60) < 0.01
    # the upper transition (10 Hz) is that of a filter of 165 taps, centred
    wide = h - dsp.fir(500, 1, None)
    assert np.allclose(wide + np.eye(1651)[825], np.pad(dsp.fir(500, None, 40), 743), atol=1e-12)
    assert len(dsp.fir(500, None, 40, window="hann")) == 155 and len(dsp.fir(500, None, 40, window="blackman")) == 251
    with pytest.raises(ValueError, match="too few"):
        dsp.fir(500, None, 40, length=51)
    with pytest.raises(ValueError, match="unknown window"):
        dsp.fir(500, None, 40, window="x")


@pytest.mark.parametrize("kind", ["butter", "cheby1", "cheby2", "ellip"])
def test_least_orders_meet_their_losses(kind):
    def loss(sections, f):
        z = np.exp(-2j * np.pi * np.asarray(f, float) / 500 * np.arange(3)[:, None])
        return -20 * np.log10(np.abs(np.prod([(b @ z) / (a @ z) for b, a in sections], axis=0)) + 1e-30)

    for edges, passed, stopped in (((None, 60), [1, 30, 60], [75, 100, 200]), ((40, None), [40, 90, 200], [1, 15, 30]), ((30, 90), [30, 60, 90], [5, 22.5, 112.5, 200]), ((120, 60), [5, 60, 120, 200], [75, 80, 90])):
        s = dsp.iir(500, *edges, kind=kind, gpass=1, gstop=40)
        assert loss(s, passed).max() <= 1 + 1e-6 and loss(s, stopped).min() >= 40 - 1e-6
        assert loss(s, [f for f in edges if f]).max() == pytest.approx(1, abs=1e-6)
    if kind == "ellip":
        assert len(dsp.iir(500, None, 60, kind=kind, gpass=1, gstop=40)) < len(dsp.iir(500, None, 60, kind="butter", gpass=1, gstop=40))
    for wrong in ({"gpass": 1}, {"gpass": 1, "gstop": 40, "order": 2}, {"gpass": 3, "gstop": 2}):
        with pytest.raises(ValueError, match="gpass"):
            dsp.iir(500, None, 60, kind=kind, **wrong)
    with pytest.raises(ValueError, match="stop bands"):
        dsp.iir(500, 1, 60, kind=kind, gpass=1, gstop=40)


def _by_the_sample(b, a, v):
    out, s1, s2 = [], 0.0, 0.0
    for x in v:
        y = b[0] * x + s1
        s1, s2 = b[1] * x - a[1] * y + s2, b[2] * x - a[2] * y
        out.append(y)
    return np.array(out)


def test_blocks_are_the_recursion_and_the_convolution():
    rng = np.random.RandomState(3)
    v = rng.standard_normal((3, 1000))
    for b, a in dsp.iir(500, 20, 80, "ellip", rp=0.5):
        assert np.allclose(dsp._section(b, a, v, np.zeros((3, 2))), [_by_the_sample(b, a, r) for r in v], atol=1e-9)
    h = dsp.fir(500, None, 100)
    pad = min(len(h) - 1, 999)
    for n in (1, 2, 50, 1000):
        r, p = v[0, :n], min(pad, n - 1)
        wide = np.concatenate([2 * r[0] - r[p:0:-1], r, 2 * r[-1] - r[-2 : -p - 2 : -1]]) if p else r
        assert np.allclose(dsp.apply_fir(r, h), np.convolve(wide, h)[p + len(h) // 2 :][:n])
    long = rng.standard_normal((1, 30_000))
    assert np.allclose(dsp.apply_fir(long, h)[0, 5000:5100], [long[0, i - len(h) // 2 : i + len(h) // 2 + 1] @ h for i in range(5000, 5100)])


def test_sections_and_polynomials_can_be_given(sines):
    sections = dsp.iir(500, None, 100)
    b, a = np.ones(1), np.ones(1)
    for t, u in sections:
        b, a = np.convolve(b, t), np.convolve(a, u)
    want = np.array(values(dsp.low_pass(sines, freq=100, method="iir"), "X4"))
    for config in ({"sos": [[*t, *u] for t, u in sections]}, {"b": b, "a": a}):
        assert np.allclose(np.array(values(dsp.low_pass(sines, freq=100, method="iir", config=config), "X4")), want, atol=1e-6)
    with pytest.raises(ValueError, match="unstable"):
        dsp.low_pass(sines, freq=100, method="iir", config={"b": [1], "a": [1, -2]})


def test_segments_of_all_lengths_stay_whole(spark, monkeypatch):
    from voltra.plans import segments

    monkeypatch.setattr(segments, "ROWS", 50)
    rng = np.random.RandomState(5)
    rows = [(i, s, float(rng.standard_normal())) for i, n in enumerate([1, 2, 30, 200, 30, 7, 30]) for s in range(1, n + 1)]
    x = Recording.from_df(spark.createDataFrame(rows, "_id long, _sample int, X double").repartition(3), 500, channels={"X": {}})
    h = dsp.fir(500, None, 60)
    got = {(r._id, r._sample): r.X for r in dsp.low_pass(x, freq=60).signal.collect()}
    for i in range(7):
        v = np.array([r[2] for r in rows if r[0] == i])
        assert np.allclose([got[i, s + 1] for s in range(len(v))], dsp.apply_fir(v, h))
    assert dsp.downsample(x, q=4).signal.count() == sum(-(-n // 4) for n in [1, 2, 30, 200, 30, 7, 30])


@pytest.fixture(scope="module")
def sines(spark):
    n = np.arange(1, 1001)
    s = {f"X{k}": np.sin(k * n) for k in (1, 2, 3)}
    return make(spark, s | {"X4": sum(s.values())})


@pytest.mark.parametrize("method", ["fir", "iir"])
def test_filters_isolate_sines(sines, method):
    def off(y, *parts):
        rows = np.array(values(y, "X4", "X1", "X2", "X3"))[150:-150]
        want = sum(np.sin(k * np.arange(151, 851)) for k in parts)
        return np.abs(rows[:, 0] - want).max()

    o = {"method": method}
    assert off(dsp.low_pass(sines, "X4", freq=100, **o), 1) < 0.06
    assert off(dsp.high_pass(sines, "X4", freq=210 if method == "fir" else 200, **o, config={"low_width": 40} if method == "fir" else None), 3) < 0.06
    assert off(dsp.band_pass(sines, "X4", freq=(119.4, 175.1), **o), 2) < 0.06
    assert off(dsp.band_stop(sines, "X4", freq=(222.8, 119.4), **o), 1, 3) < 0.06
    with pytest.raises(ValueError):
        dsp.band_pass(sines, freq=(5, 2))


def test_nulls_downsampling_and_spectra(sines, spark):
    holed = sines.mutate(X1="CASE WHEN _sample <> 5 THEN X1 END")
    assert dsp.low_pass(holed, freq=100, na_rm=True).signal.filter("X1 is not null").count() == 0
    with pytest.raises(Exception, match="na_rm"):
        dsp.low_pass(holed, freq=100).signal.count()
    d = dsp.downsample(sines, q=2)
    assert d.signal.count() == 500 and d.rate == 250 and dsp.downsample(sines, max_sample=100).signal.count() == 100
    assert dsp.factors(60) and np.prod(dsp.factors(60)) == 60
    with pytest.raises(ValueError):
        dsp.downsample(sines, q=1)
    n = np.arange(1, 1001)
    slow = make(spark, {"A": np.sin(2 * np.pi * 62.5 * n / 500)})
    p = spectral.psd(slow).signal.orderBy(F.desc("A")).first()
    assert p._freq == 62.5
    total = spectral.power_band(slow, bands={"all": (0, 250)}, relative=True).signal.first()
    assert total.A == pytest.approx(1)
    with pytest.raises(ValueError):
        spectral.psd(slow, method="other")


def test_components_are_reversible_and_remove_a_source(spark):
    rng = np.random.RandomState(0)
    n = 2000
    source = np.column_stack([np.sign(np.sin(np.arange(n) / 30)), rng.laplace(size=n), np.sin(np.arange(n) / 7)])
    mix = np.array([[1, 0.5, 0.3], [0.4, 1, 0.6], [0.2, 0.3, 1]])
    m = source @ mix
    x = make(spark, {"Fz": m[:, 0], "Cz": m[:, 1], "EOGV": source[:, 0]} | {"Pz": m[:, 2]})
    for method in ("parallel", "deflation", "adaptive"):
        fitted = ica.fit(x, "Fz", "Cz", "Pz", method=method)
        whole = np.array(values(ica.keep(fitted, *fitted.models["recording1"][3]), "Fz", "Cz", "Pz"))
        assert np.allclose(whole, m, atol=1e-6)
        best = ica.cor_table(fitted, "EOGV").first()
        assert abs(best.cor) > 0.98
        rest = np.array(values(ica.keep(fitted, "-" + best._ica), "Fz", "Cz", "Pz"))
        without = source[:, 1:] @ mix[1:]
        assert all(np.corrcoef(rest[:, i], without[:, i])[0, 1] > 0.97 for i in range(3))
    assert ica.show(fitted).ncomponents == 3 and ica.summary_table(fitted, "EOGV").count() == 3
    assert 0.9 < ica.var_table(fitted).agg(F.sum("var")).first()[0] < 1.1 and fitted.matrices().count() == 9


@pytest.mark.parametrize("config", [{"g": "pow3"}, {"g": "gaus"}, {"method": "deflation", "g": "pow3"}, {"method": "adaptive"}, {"method": "adaptive", "kj": 1}, {"method": "adaptive", "kj": 3}])
def test_every_start_and_nonlinearity_separates(config):
    rng = np.random.RandomState(5)
    s = np.stack([rng.uniform(-1, 1, 20_000), rng.laplace(size=20_000), np.sign(rng.standard_normal(20_000))], 1)
    w = ica.fast_ica(s @ np.array([[1, 0.4, 0.2], [0.3, 1, -0.5], [-0.2, 0.6, 1]]), **config)
    c = np.abs(np.corrcoef(np.concatenate([s, s @ np.array([[1, 0.4, 0.2], [0.3, 1, -0.5], [-0.2, 0.6, 1]]) @ w], 1), rowvar=False)[:3, 3:])
    assert sorted(c.argmax(1).tolist()) == [0, 1, 2] and c.max(1).min() > 0.99
    with pytest.raises(ValueError, match="nonlinearity"):
        ica.fast_ica(s, g="x")


def test_joint_rotation_diagonalises():
    rng = np.random.RandomState(2)
    q, _ = np.linalg.qr(rng.standard_normal((4, 4)))
    m = np.array([q.T @ np.diag(rng.standard_normal(4)) @ q for _ in range(5)])
    r = ica._joint_diagonal(m.copy(), 1e-12, 100)
    left = r @ m @ r.T
    assert np.abs(left * (1 - np.eye(4))).max() < 1e-9 and np.allclose(r @ r.T, np.eye(4))


def test_maps(spark):
    table = spark.createDataFrame([("a", c, x, y, x + y) for c, x, y in (("p", 1.0, 0.0), ("q", -1.0, 0.0), ("r", 0.0, 1.0), ("s", 0.0, -1.0))], "g string, _key string, _x double, _y double, _value double")
    got = topography.interpolate(table, ["g"], points=15).toPandas()
    assert got._key.notna().sum() == 4 and len(got) > 100
    grid = got[got._key.isna()]
    assert np.corrcoef(grid._value, grid._x + grid._y)[0, 1] > 0.9
    place = topography.change_coord({"c": {"_x": 0.0, "_y": 1.0, "_z": 0.0}}, "polar")["c"]
    assert place["_y"] == pytest.approx(np.pi / 2) and place["_z"] is None


def test_brainvision_round_trip(spark, sincos, tmp_path):
    seg = sincos.filter("_id < 3")
    (path,) = brainvision.write_vhdr(seg, str(tmp_path / "a.vhdr"))
    with pytest.raises(FileExistsError):
        brainvision.write_vhdr(seg, str(tmp_path / "a.vhdr"))
    back = brainvision.read_vhdr(spark, path)
    assert back.rate == 500 and back.segments.count() == 2
    assert np.allclose(values(back, "X", "Y"), values(seg, "X", "Y"), atol=1e-6)
    assert [s for (s,) in values(back, "_sample")] == [s for (s,) in values(seg, "_sample")]
    assert back.events.filter("_type = 'Bad'").count() == 3
    brainvision.write_tables(seg, str(tmp_path / "t"))
    assert brainvision.read_tables(spark, str(tmp_path / "t"), 500).signal.count() == 20


@pytest.mark.parametrize("kind,orientation", [("INT_16", "MULTIPLEXED"), ("INT_16", "VECTORIZED"), ("IEEE_FLOAT_32", "VECTORIZED"), ("ASCII", "MULTIPLEXED")])
def test_brainvision_formats_agree(spark, tmp_path, kind, orientation):
    m = np.arange(1, 21).reshape(10, 2)
    d = m if orientation == "MULTIPLEXED" else m.T
    if kind == "ASCII":
        (tmp_path / "x.dat").write_text("a b\n" + "\n".join(" ".join(map(str, r)) for r in d) + "\n")
    else:
        (tmp_path / "x.dat").write_bytes(d.astype({"INT_16": "<i2", "IEEE_FLOAT_32": "<f4"}[kind]).tobytes())
    fmt = "DataFormat=ASCII" if kind == "ASCII" else "DataFormat=BINARY"
    (tmp_path / "x.vhdr").write_text(f"Title\n[Common Infos]\nDataFile=$b.dat\nMarkerFile=$b.vmrk\n{fmt}\nDataOrientation={orientation}\nSamplingInterval=2000\n[Binary Infos]\nBinaryFormat={kind}\n[ASCII Infos]\nSkipLines=1\n[Channel Infos]\nCh1=HEOG,,0.5,uV\nCh2=HEOG,,0.5,uV\n[Coordinates]\nCh1=1,90,0\n")
    (tmp_path / "x.vmrk").write_text("T\n[Marker Infos]\nMk1=New Segment,,1,1,0\nMk2=Stimulus,S 1,4,3,2\n")
    x = brainvision.read_vhdr(spark, str(tmp_path / "x.vhdr"))
    assert x.channel_names == ["HEOG", "HEOG_1"] and x.channels["HEOG"]["_x"] == 1.0
    assert np.allclose(values(x, "HEOG", "HEOG_1"), m * 0.5)
    assert x.events.filter("_type = 'Stimulus'").select("_initial", "_final", "_channel").first() == (4, 6, "HEOG_1")


def test_large_brainvision_files_are_read_in_splits(spark, synthetic_file, monkeypatch):
    whole = brainvision.read_vhdr(spark, synthetic_file)
    monkeypatch.setattr(brainvision, "BLOCK", 4096)
    split = brainvision.read_vhdr(spark, synthetic_file)
    assert split.signal.rdd.getNumPartitions() > 4 > whole.signal.rdd.getNumPartitions()
    assert values(split, "_id", "_sample", "A", "B", "C") == values(whole, "_id", "_sample", "A", "B", "C")
    assert split.segments.count() == 2 and split.signal.count() == 5000


@pytest.fixture
def synthetic_file(spark, tmp_path):
    rng = np.random.RandomState(4)
    x = make(spark, {c: rng.standard_normal(5000).astype("f4") for c in "ABC"}, (1, 2), 1, [(1, "New Segment", None, 1, 1, None), (2, "New Segment", None, 1, 1, None)])
    (path,) = brainvision.write_vhdr(x, str(tmp_path / "big.vhdr"))
    back = brainvision.read_vhdr(spark, path)
    assert np.allclose(values(back, "A", "B", "C"), values(x, "A", "B", "C"))
    assert back.events.filter("_type = 'New Segment'").count() == 2
    return path


def test_edf(spark, tmp_path):
    pad = lambda s, n: str(s).ljust(n).encode()
    labels, n = ["Fz", "Cz", "EDF Annotations"], [4, 4, 16]
    head = b"".join([pad("0", 8), pad("", 80), pad("", 80), pad("01.01.2001.01.01", 16), pad(256 * 4, 8), pad("EDF+C", 44), pad(2, 8), pad(1, 8), pad(3, 4)])
    for vals, w in ((labels, 16), ([""] * 3, 80), (["uV"] * 3, 8), ([-100] * 3, 8), ([100] * 3, 8), ([-100] * 3, 8), ([100] * 3, 8), ([""] * 3, 80), (n, 8), ([""] * 3, 32)):
        head += b"".join(pad(v, w) for v in vals)
    body = b""
    for r in range(2):
        tal = f"+{r}\x14\x14\x00+{r}.5\x150.25\x14blink\x14\x00".encode().ljust(32, b"\x00")
        body += np.arange(r * 4, r * 4 + 4).astype("<i2").tobytes() + (-np.arange(r * 4, r * 4 + 4)).astype("<i2").tobytes() + tal
    (tmp_path / "a.edf").write_bytes(head + body)
    x = edf.read_edf(spark, str(tmp_path / "a.edf"))
    assert x.rate == 4 and np.allclose(values(x, "Fz", "Cz"), [(k, -k) for k in range(8)])
    assert sorted((e._description, e._initial, e._final) for e in x.events.collect()) == [("blink", 3, 4), ("blink", 7, 8)]


def test_generators():
    assert len(synthetic.rpink(200, seed=1)) == 200 and np.isfinite(synthetic.rpink(200, seed=1)).all()


def test_text_and_literals_are_no_names(spark):
    assert over("concat('max(', X, ')', '''avg(') || max(X)", [], []) == "concat('max(', X, ')', '''avg(') || max(X) OVER ()"
    x = make(spark, {"X": [1, 2, 3, 4]}, (1, 2)).mutate(X="X + 1")
    assert names(F.col("_recording") == "X") == {"_recording"} and names(F.when(F.expr("Y > 'Z'"), F.col("`A`")).otherwise(3)) == {"Y", "A"}
    assert x.filter(F.col("condition") == "X").segments.count() == 0 and x.filter(F.col("condition") == "X").signal.count() == 0
    assert x.mutate(t="concat('max(', condition, ')')").segments.filter("t = 'max(a)'").count() == 1


def test_spectra_and_components_bind(spark, sines):
    p = spectral.psd(sines)
    both = spectral.Spectrum.bind(p, p)
    assert both.events is None and both.signal.count() == 2 * p.signal.count() and both.segments.count() == 2
    fitted = ica.fit(sines, "X1", "X2", "X3", ignore=None)
    two = ica.IcaRecording.bind(fitted, fitted)
    assert two.models.keys() == fitted.models.keys() and ica.show(two).signal.count() == 2000
    a, w = fitted.models["recording1"][1:3]
    again = ica.with_models(ica.without_models(fitted), {"recording1": (a, w)}, "X1", "X2", "X3")
    assert not isinstance(ica.without_models(fitted), ica.IcaRecording)
    assert np.allclose(values(ica.show(again), "ICA1"), values(ica.show(fitted), "ICA1"))
    assert ica.summary_table(fitted, "X4", max_sample=500).count() == 3
    with pytest.raises(ValueError):
        ica.with_models(sines, {"recording1": (a, w)}, "X1")


def test_components_have_a_model_for_each_recording(spark):
    rng = np.random.RandomState(7)
    rows, sources = [], {}
    for i, r in ((1, "a"), (2, "b")):
        sources[i] = np.column_stack([rng.laplace(size=600), np.sign(np.sin(np.arange(600) / 9))])
        m = sources[i] @ rng.standard_normal((2, 2))
        rows += [(i, s + 1, float(x), float(y)) for s, (x, y) in enumerate(m)]
    x = Recording.from_df(spark.createDataFrame(rows, "_id long, _sample int, X double, Y double"), 100, segments=spark.createDataFrame([(1, "a"), (2, "b")], "_id long, _recording string"), channels={"X": {}, "Y": {}})
    shown = ica.show(ica.fit(x, ignore=None))
    for i in (1, 2):
        got = np.array(values(shown.filter(f"_id = {i}"), "ICA1", "ICA2"))
        c = np.abs(np.corrcoef(got.T, sources[i].T)[:2, 2:])
        assert c.max(0).min() > 0.95


def test_components_of_many_channels_stay_a_small_plan(spark):
    rng = np.random.RandomState(7)
    m, w = rng.standard_normal((60, 34)), rng.standard_normal((34, 34))
    x = make(spark, {f"c{i}": m[:, i] for i in range(34)}, (1, 2)).mutate(c3="CASE WHEN _sample <> 5 THEN c3 END")
    y = ica.show(ica.with_models(x, {"recording1": (np.linalg.inv(w), w)}))
    got = np.array(values(y, *y.component_names), float)
    held = m.copy()
    held[[4, 34], 3] = np.nan
    assert np.allclose(got, (held - np.nanmean(held, 0)) @ w * ica.COMPONENT_SCALE, equal_nan=True) and np.isnan(got).any(1).sum() == 2
    back = ica.keep(y)
    assert np.allclose(np.array(values(back, *back.channel_names), float)[:4], m[:4]) and not back.component_names
    shares = {r["_ica"]: r["var"] for r in ica.var_table(y).collect()}
    assert len(shares) == 34
    assert np.allclose(np.array(values(ica.show(y, "ICA2"), "ICA2"), float), np.array(values(y, "ICA2"), float), equal_nan=True)
    with pytest.raises(ValueError, match="not those"):
        ica.with_models(x, {"recording1": (w[:3], w[:, :3].T)})


def test_numbers_over_whole_tables(spark):
    from voltra.plans import numbering

    rng = np.random.RandomState(8)
    ids = rng.choice(100_000, 300, replace=False)
    t = spark.createDataFrame([(int(i), int(i) % 7) for i in ids], "_id long, n long")
    got = {r._id: r.at for r in numbering.before(t, "_id", "n", "at").collect()}
    order = sorted(ids.tolist())
    assert got == {i: sum(j % 7 for j in order[:k]) for k, i in enumerate(order)}
    rows = spark.createDataFrame([(int(i), k) for i in ids[:40] for k in range(3)], "_id long, k int")
    assert [tuple(r) for r in numbering.numbered(rows, "_id", ["k"], "at").orderBy("at").select("_id", "k", "at").collect()] == [(i, k, 3 * n + k + 1) for n, i in enumerate(sorted(ids[:40].tolist())) for k in range(3)]


def test_limits_of_each_event(data0):
    wide = data0._with(events=data0.events.withColumn("rt", F.when(F.col("_initial") == 6, 2.0).otherwise(4.0)))
    got = timeline.segment(wide, "_type = 'Time 0'", lim=(0, "rt"), unit="samples")
    assert got.signal.groupBy("_id").count().orderBy("_id").collect() == [(1, 3), (2, 5)]
    assert got.segments.count() == 2 and "rt" in got.segments.columns


def test_selection_by_type_and_clock(sincos):
    assert sincos.select(sincos.where(lambda kind: kind == "double")).channel_names == ["X", "Y"]
    assert set(sincos.across(F.upper, sincos.where(lambda kind: kind == "string"))) == {"_recording", "condition"}
    assert sincos.summary()["total"].collect() == [(500.0, "00:00:00")]
    assert sincos._with(rate=1 / 7200).summary()["total"].first().duration == "60:00:00"


def test_warnings_of_options_without_effect(sincos):
    with pytest.warns(UserWarning, match="preserve"):
        sincos.filter("X > 0", preserve=True)
    with pytest.warns(UserWarning, match="_groups"):
        sincos.summarize(_groups="drop", m=F.avg("X"))
    assert list(sincos.across([F.abs, F.sqrt], "X")) == ["X_1", "X_2"] and list(sincos.across(F.upper, "condition")) == ["condition"]
    assert sincos.mutate(**sincos.across_ch({"twice": lambda c: c * 2}, "Y")).channel_names == ["X", "Y", "Y_twice"]
    assert sincos.transmute(m=chf.c_across_ch(sincos, "max")).channel_names == ["m"]
    part = chf.chs_fun(sincos, {"big": lambda a, least: F.size(F.filter(a, lambda v: v > least)).cast("double")}, least=2.0)
    assert part.signal.agg(F.max("big")).first()[0] == 0 and sincos.pull("X").count() == 30
    assert topography.plot_data(sincos).count() == 60 and topography.event_data(sincos).filter("_key = 'X'").count() == 8


class _Raw:
    """The interface of a raw recording."""

    ch_names = ["Fz", "Cz", "STI"]
    info = {"sfreq": 10.0, "bads": ["Cz"], "chs": [{"ch_name": "Fz", "loc": [1.0, 2.0, 3.0, 0.0]}, {"ch_name": "Cz", "loc": [0.0, 0.0, 0.0]}]}
    annotations = [{"description": "Stimulus/S1", "onset": 0.5, "duration": 0.2}]

    def get_channel_types(self):
        return ["eeg", "eeg", "stim"]

    def get_data(self, picks):
        return np.arange(40.0).reshape(2, 20)


def test_recordings_from_objects(spark):
    x = mne_bridge.from_mne(spark, _Raw())
    assert x.channel_names == ["Fz", "Cz"] and x.rate == 10 and x.channels["Fz"] == {"_x": 1.0, "_y": 2.0, "_z": 3.0} and x.channels["Cz"].get("_x") is None
    assert sorted((e._type, e._description, e._initial, e._final, e._channel or "") for e in x.events.collect()) == [("Stimulus", "S1", 6, 7, ""), ("artifact", "bad", 1, 20, "Cz")]
    assert values(x, "Fz", "Cz") == [(float(i), 20.0 + i) for i in range(20)]


def test_detection_on_a_stream(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    rows = [("r", at + dt.timedelta(milliseconds=100 * i), 0.0 if i < 25 else float(i % 2) * 9, 1.0) for i in range(40)] + [("r", at + dt.timedelta(minutes=1), 0.0, 1.0)]
    spark.createDataFrame(rows, "_recording string, _ts timestamp, X double, Y double").coalesce(1).write.parquet(str(tmp_path / "in"))
    found = detectors.stream_minmax(spark.readStream.schema("_recording string, _ts timestamp, X double, Y double").parquet(str(tmp_path / "in")), ["X", "Y"], 5.0, late="1 second")
    q = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.window.start.second, r._channel, r["range"]) for r in spark.table("found").collect()) == [(2, "X", 9.0), (3, "X", 9.0)]
