"""Segmentation around events, and putting segments back together."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import LIMIT, clamp, scaling
from ..model import Recording
from ..plans import numbering, rangejoin


def _cut_events(x: Recording, spans: DataFrame) -> DataFrame:
    """Events inside the spans (_id, _new, _lower, _first, _upper), cut to them and counted from their zero."""
    s = spans.select(F.col("_id").alias("_old"), "_new", "_lower", "_first", "_upper")
    e = x.events.join(s, (x.events["_id"] == s["_old"]) & (F.col("_initial") <= F.col("_upper")) & (F.col("_final") >= F.col("_lower")))
    shifted = {"_id": F.col("_new"), "_initial": F.greatest("_initial", "_lower") - F.col("_first") + 1, "_final": F.least("_final", "_upper") - F.col("_first") + 1}
    return e.withColumns(shifted).select(*x.events.columns)


def segment(x: Recording, where: Column | str, lim: tuple[float, float] = (-0.5, 0.5), end: Column | str | None = None, unit: str = "s") -> Recording:
    """Segments around each event that ``where`` picks: ``lim`` before and after it (inclusive), or up to the next
    event that ``end`` picks. Sample 1 is the event; segments may overlap. Facts of the event go to the segments. A limit
    may be an expression over the columns of the events, so that each event has limits of its own."""
    pick = F.expr(where) if isinstance(where, str) else where
    anchors = x.events.filter(pick).drop("_channel", "_final").distinct().withColumn("_first", F.col("_initial"))
    if end is None:
        scale = scaling(x.rate, unit)
        own = [isinstance(v, (Column, str)) for v in lim]
        if not any(own) and lim[1] < lim[0]:
            raise ValueError("the second limit is below the first")
        far = F.lit(float(LIMIT))
        low, high = (F.greatest(-far, F.least(far, F.rint((F.expr(v) if isinstance(v, str) else v) * scale))).cast("long") if o else F.lit(clamp(v * scale)) for v, o in zip(lim, own, strict=True))
        if any(own):  # from the events themselves, which may have further columns
            anchors = x.events.filter(pick).withColumns({"_low": low, "_high": high}).drop("_channel", "_final").distinct().withColumn("_first", F.col("_initial"))
            low, high = F.col("_low"), F.col("_high")
        spans = anchors.withColumns({"_lower": F.col("_first").cast("long") + low, "_upper": F.col("_first").cast("long") + high}).drop("_low", "_high")
        anchors = anchors.drop("_low", "_high")
    else:
        stop = F.expr(end) if isinstance(end, str) else end
        marks = x.events.filter(pick | stop).withColumn("_start", F.coalesce(pick, F.lit(False))).select("_id", "_initial", "_start").distinct()
        w = Window.partitionBy("_id").orderBy("_initial", F.desc("_start"))
        pairs = marks.withColumns({"_end": F.lead("_initial").over(w), "_next": F.lead("_start").over(w)}).filter("_start")
        matched = pairs.select("_id", F.col("_initial").alias("_first"), F.when(~F.col("_next"), F.col("_end")).alias("_end"))
        spans = anchors.join(matched, ["_id", "_first"]).withColumns({"_lower": F.col("_first").cast("long"), "_upper": F.coalesce("_end", F.col("_first") - 1).cast("long"), "_type": F.when(F.col("_end").isNull(), "incorrect segment").otherwise(F.col("_type"))}).drop("_end")
    bounds = x.signal.groupBy("_id").agg(F.min("_sample").alias("_a"), F.max("_sample").alias("_z"))
    order = ["_id", "_first", *[c for c in anchors.columns if c not in ("_id", "_initial", "_first")]]
    spans = numbering.numbered(spans, "_id", order[1:], "_new")
    spans = spans.join(bounds, "_id").withColumns({"_lower": F.greatest("_lower", "_a").cast("int"), "_upper": F.least("_upper", "_z").cast("int")}).drop("_a", "_z")
    real = spans.filter("_lower <= _upper")
    hit = rangejoin.within(x.signal, "_sample", real.select("_id", "_new", "_first", "_lower", "_upper"), "_lower", "_upper", ["_id"])
    signal = hit.withColumn("_sample", (F.col("_sample") - F.col("_first") + 1).cast("int")).withColumn("_id", F.col("_new")).select(*x.signal.columns)
    facts = [c for c in anchors.columns if c not in ("_id", "_initial", "_first")]
    named = {c: (n if (n := c.lstrip("_")) not in x.segments.columns else f"i_{n}") for c in facts}
    segments = spans.join(x.segments.drop("segment").withColumnRenamed("_id", "_old"), F.col("_id") == F.col("_old"), "left")
    segments = segments.select(F.col("_new").alias("_id"), *[c for c in x.segments.columns if c not in ("_id", "segment")], *[F.col(c).alias(n) for c, n in named.items() if c not in x.segments.columns])
    segments = segments.withColumn("segment", F.row_number().over(Window.partitionBy("_recording").orderBy("_id")))
    if end is not None:
        warnings.warn("starts without an end become empty segments of type 'incorrect segment'", stacklevel=2)
    return x._with(signal=signal, events=_cut_events(x, real), segments=segments, groups=())


def unsegment(x: Recording, start: int = 1, sep: dict[str, str] | None = None, zero: dict[str, str] | None = None) -> Recording:
    """One id with all segments one after the other, from sample ``start``. An event with the columns of ``sep`` (by default
    _type New Segment) starts each and, where there are several, one with those of ``zero`` (Time 0) marks its zero; equal
    events are one."""
    sep, zero = sep or {"_type": "New Segment", "_description": ""}, zero or {"_type": "Time 0", "_description": ""}
    ends = x.signal.groupBy("_id").agg(F.min("_sample").alias("_lo"), (F.max("_sample") - F.min("_sample") + 1).alias("_n"))
    at = numbering.before(ends, "_id", "_n", "_off")
    shift = at.select("_id", (F.col("_off") - F.col("_lo") + start).alias("_by"), "_off", "_n", "_lo")
    move = lambda t, cols: t.join(shift.select("_id", "_by"), "_id").withColumns({c: (F.col(c) + F.col("_by")).cast("int") for c in cols} | {"_id": F.lit(1).cast("long")})
    new = lambda facts, sample: shift.select(F.lit(1).cast("long").alias("_id"), *[F.lit(v).cast("string").alias(k) for k, v in facts.items()], sample.cast("int").alias("_initial"), sample.cast("int").alias("_final"), F.lit(None).cast("string").alias("_channel"))
    starts = new(sep, F.col("_off") + start)
    zeros = new(zero, F.lit(1) + F.col("_by")).join(shift.agg(F.count("*").alias("_m")), F.col("_m") > 1).drop("_m")
    events = move(x.events, ["_initial", "_final"]).select(*x.events.columns).unionByName(starts, allowMissingColumns=True).unionByName(zeros, allowMissingColumns=True).distinct()
    names = x.segments.agg(F.array_join(F.array_sort(F.collect_set("_recording")), ";").alias("_recording"))
    segments = names.select(F.lit(1).cast("long").alias("_id"), "_recording", F.lit(1).alias("segment"))
    return x._with(signal=move(x.signal, ["_sample"]).select(*x.signal.columns), events=events, segments=segments, groups=())


def baseline(x: Recording, *channels: str, lim: float = float("-inf"), unit: str = "s") -> Recording:
    """Each channel less its mean (nulls ignored) over the samples from ``lim`` to 0, in each segment."""
    low = clamp(lim * scaling(x.rate, unit))
    w = Window.partitionBy("_id")
    names = channels or tuple(x.channel_names)
    return x._with(signal=x.signal.withColumns({c: F.col(c) - F.avg(F.when(F.col("_sample").between(low, 0), F.col(c))).over(w) for c in names}))


def events_to_na(x: Recording, where: Column | str, n_chs: int | None = None, entire_seg: bool = True, drop_events: bool = True) -> Recording:
    """Null where bad events are: whole segments of their channel (null channel: all), or their samples only.

    With ``n_chs``, a segment with that many bad event rows is bad in all channels.
    """
    pick = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    bad = x.events.filter(pick)
    if n_chs is not None:
        many = bad.groupBy("_id").agg((F.count("*") >= n_chs).alias("_many"))
        bad = bad.join(many, "_id").withColumn("_channel", F.when(~F.col("_many"), F.col("_channel"))).drop("_many")
    sets = [F.collect_set("_channel").alias("_bad"), F.max(F.col("_channel").isNull()).alias("_all")]
    if entire_seg:
        marks = bad.groupBy("_id").agg(*sets)
        on = ["_id"]
    else:
        hit = rangejoin.within(x.signal.select("_id", "_sample"), "_sample", bad.select("_id", "_initial", "_final", "_channel"), "_initial", "_final", ["_id"])
        marks = hit.groupBy("_id", "_sample").agg(*sets)
        on = ["_id", "_sample"]
    wide = x.signal.join(marks, on, "left")
    clean = wide.withColumns({c: F.when(~F.coalesce(F.col("_all") | F.array_contains("_bad", c), F.lit(False)), F.col(c)) for c in x.channel_names})
    return x._with(signal=clean.select(*x.signal.columns), events=x.events.filter(~pick) if drop_events else x.events)

