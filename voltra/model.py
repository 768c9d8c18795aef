"""The recording: a wide signal table, interval events and a table of segments, all lazy and kept consistent."""

from __future__ import annotations

import copy
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import selectors as sel
from .functions.timing import as_time, scaling
from .plans import routing
from .plans.numbering import numbered

EVENTS = "_id long, _type string, _description string, _initial int, _final int, _channel string"


class Recording:
    """``signal`` (_id, _sample, channels…), ``events`` (_id, _type, _description, _initial, _final, _channel) and
    ``segments`` (_id, _recording, …). Every verb returns a new object; nothing runs until a result is asked for, but for counts of
    what a join by intervals may broadcast."""

    order = "_sample"

    def __init__(self, signal: DataFrame, events: DataFrame | None, segments: DataFrame, rate: float, channels: dict[str, dict], groups: tuple[str, ...] = ()):
        self.signal, self.events, self.segments, self.rate, self.channels, self.groups = signal, events, segments, rate, channels, groups

    @classmethod
    def from_df(cls, signal: DataFrame, rate: float = 500, events: DataFrame | None = None, segments: DataFrame | None = None, channels: dict[str, dict] | None = None, order_by: list[str] | None = None) -> Recording:
        """Missing parts get defaults: _id 1, _sample 1..n in the order of ``order_by`` (needed then), no events, and one
        recording. NaN becomes null."""
        if "_id" not in signal.columns:
            signal = signal.withColumn("_id", F.lit(1).cast("long"))
        if cls.order == "_sample" and "_sample" not in signal.columns:
            if not order_by:
                raise ValueError("rows have no order of their own: name order_by")
            signal = signal.withColumn("_sample", F.row_number().over(Window.partitionBy("_id").orderBy(*order_by)))
        keys = ["_id", cls.order]
        free = [f for f in signal.schema if f.name not in keys]
        chosen = channels if channels is not None else {f.name: {} for f in free if f.dataType.typeName() in ("double", "float")}
        if wrong := [f.name for f in free if f.name in chosen and f.dataType.typeName() not in ("double", "float")]:
            raise TypeError(f"channels must be doubles: {wrong}")
        signal = signal.select(F.col("_id").cast("long").alias("_id"), cls.order, *[F.when(~F.isnan(f.name), F.col(f.name)).cast("double").alias(f.name) if f.name in chosen else F.col(f.name) for f in free])
        if segments is None:
            segments = signal.select("_id").distinct().select("_id", F.lit("recording1").alias("_recording")).withColumn("segment", F.row_number().over(Window.partitionBy("_recording").orderBy("_id")))
        if events is None and cls.order == "_sample":
            events = signal.sparkSession.createDataFrame([], EVENTS)
        elif events is not None:
            for c, kind in (("_type", "string"), ("_description", "string"), ("_channel", "string")):
                if c not in events.columns:
                    events = events.withColumn(c, F.lit(None).cast(kind))
            if "_final" not in events.columns:
                events = events.withColumn("_final", F.col("_initial"))
        return cls(signal, events, segments, rate, dict(chosen))

    def _with(self, **parts) -> Recording:
        out = copy.copy(self)
        for k, v in parts.items():
            setattr(out, k, v)
        return out

    # -- facts ---------------------------------------------------------------------------------------------------
    @property
    def keys(self) -> list[str]:
        return ["_id", self.order]

    @property
    def vars(self) -> list[str]:
        return [c for c in self.signal.columns if c not in self.keys]

    @property
    def channel_names(self) -> list[str]:
        return [c for c in self.vars if c in self.channels and self.channels[c].get("kind") != "component"]

    @property
    def component_names(self) -> list[str]:
        return [c for c in self.vars if self.channels.get(c, {}).get("kind") == "component"]

    nchannels = property(lambda self: len(self.channel_names))
    ncomponents = property(lambda self: len(self.component_names))
    sampling_rate = property(lambda self: self.rate)

    @property
    def segment_vars(self) -> list[str]:
        return [c for c in self.segments.columns if c != "_id"]

    def channels_table(self) -> DataFrame:
        names = ["_channel", "_x", "_y", "_z", "_reference"]
        rows = [(c, *[None if self.channels[c].get(k) is None else (float(self.channels[c][k]) if k != "_reference" else self.channels[c][k]) for k in names[1:]]) for c in self.channel_names]
        return self.signal.sparkSession.createDataFrame(rows, "_channel string, _x double, _y double, _z double, _reference string")

    def with_events(self, events: DataFrame) -> Recording:
        return self._with(events=events)

    def with_channels(self, channels: dict[str, dict]) -> Recording:
        """Replace names (in order) and facts of the channels."""
        new = dict(zip(self.channel_names, channels, strict=True))
        return self.rename(**{v: k for k, v in new.items() if k != v})._with(channels=dict(channels))

    def validate(self) -> list[str]:
        """Problems that need a job to see; each is also warned of."""
        found = []
        lone = self.signal.select("_id").distinct().join(self.segments, "_id", "left_anti").limit(1).count() + self.segments.join(self.signal, "_id", "left_anti").limit(1).count()
        if lone:
            found.append("the ids of signal and segments differ")
        if self.segments.groupBy("_id").count().filter("count > 1").limit(1).count():
            found.append("ids of segments are repeated")
        if self.events is not None and self.events.filter(F.col("_channel").isNotNull() & ~F.col("_channel").isin(self.channel_names or [""])).limit(1).count():
            found.append("events name unknown channels")
        for x in found:
            warnings.warn(x, stacklevel=2)
        return found

    def cache(self) -> Recording:
        for t in (self.signal, self.events, self.segments):
            if t is not None:
                t.cache()
        return self

    def __getitem__(self, name: str) -> Column:
        if name in self.signal.columns:
            return self.signal[name]
        if name in self.segments.columns:
            return self.segments[name]
        raise KeyError(name)

    def pull(self, name: str | None = None) -> DataFrame:
        return self.signal.select(name or self.vars[-1])

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.rate:g} Hz, channels {self.channel_names}, groups {list(self.groups)})"

    # -- helpers -------------------------------------------------------------------------------------------------
    def extended(self, needed: set[str]) -> DataFrame:
        """The signal with the segment columns needed; segments are the small side of a star."""
        extra = [c for c in self.segment_vars if c in needed and c not in self.signal.columns]
        return self.signal.join(self.segments.select("_id", *extra), "_id", "left") if extra else self.signal

    def _is_main(self, target: str, e) -> bool:
        return target in self.signal.columns or bool(routing.names(e) & set(self.signal.columns) - {"_id"})

    def _prune_events(self, channels: list[str]) -> DataFrame | None:
        if self.events is None:
            return None
        return self.events.filter(F.col("_channel").isNull() | F.col("_channel").isin(channels or [""]))

    def _clip(self, signal: DataFrame) -> DataFrame | None:
        """Events cut to what is left of each segment."""
        if self.events is None:
            return None
        ends = signal.groupBy("_id").agg(F.min("_sample").alias("_lo"), F.max("_sample").alias("_hi"))
        inside = self.events.join(ends, "_id").filter("_initial <= _hi and _final >= _lo")
        return inside.withColumns({"_initial": F.greatest("_initial", "_lo"), "_final": F.least("_final", "_hi")}).select(*self.events.columns)

    def _keep_ids(self, ids: DataFrame, signal: DataFrame | None = None) -> Recording:
        ids = ids.select("_id").distinct()
        on = lambda t: None if t is None else t.join(ids, "_id", "left_semi")
        return self._with(signal=on(self.signal) if signal is None else signal, events=on(self.events), segments=on(self.segments))

    # -- projection ----------------------------------------------------------------------------------------------
    def mutate(self, **new) -> Recording:
        """New or changed columns, each in the table its expression is about; all see the old values."""
        return self._mutate(new, keep=True)

    def transmute(self, **new) -> Recording:
        """As mutate, and only the new columns stay beside the keys."""
        return self._mutate(new, keep=False)

    def _mutate(self, new: dict, keep: bool) -> Recording:
        main = {k: e for k, e in new.items() if self._is_main(k, e)}
        other = {k: e for k, e in new.items() if k not in main}
        part = list(self.groups)
        out = self
        if main or not keep:
            needed = set().union(*(routing.names(e) for e in main.values())) | set(part) if main else set()
            wide = self.extended(needed).withColumns({f"_new_{k}": routing.column(e, part, self.keys) for k, e in main.items()}) if main else self.signal
            stay = [c for c in (self.signal.columns if keep else self.keys) if c not in main]
            signal = wide.select(*stay, *[F.col(f"_new_{k}").alias(k) for k in main])
            order = [*self.keys, *[c for c in self.signal.columns if c in signal.columns and c not in self.keys], *[k for k in main if k not in self.signal.columns]]
            signal = signal.select(*order)
            kinds = dict(signal.dtypes)
            channels = {c: self.channels.get(c, {}) for c in signal.columns if c not in self.keys and (c in self.channels or c in main) and kinds[c] in ("double", "float")}
            out = out._with(signal=signal, channels=channels, events=self._prune_events(list(channels)))
        if other or not keep:
            seg_part = [g for g in part if g in self.segments.columns]
            if other:
                segments = self.segments.withColumns({f"_new_{k}": routing.column(e, seg_part, ["_id"]) for k, e in other.items()})
                stay = [c for c in (self.segments.columns if keep else ["_id", "_recording"]) if c not in other]
                segments = segments.select(*stay, *[F.col(f"_new_{k}").alias(k) for k in other])
            else:
                segments = self.segments.select("_id", "_recording")
            out = out._with(segments=segments)
        return out

    def select(self, *wanted, **renamed) -> Recording:
        """Columns of signal or segments; a table none of whose columns is asked for stays whole. Keys, and grouping
        columns (with a warning), always stay."""
        pool = self.vars + [c for c in self.segment_vars if c not in self.vars]
        names = sel.resolve(pool, *wanted, *renamed.values())
        new = {v: k for k, v in renamed.items()}
        if lost := [g for g in self.groups if g in pool and g not in names]:
            warnings.warn(f"grouping columns stay: {lost}", stacklevel=2)
            names += lost
        out = self
        drops = any(isinstance(w, str) and w.startswith("-") for w in wanted)
        if drops or any(n in self.vars for n in names):
            own = [n for n in names if n in self.vars]
            channels = {new.get(c, c): self.channels[c] for c in own if c in self.channels}
            events = self._prune_events([c for c in own])
            if events is not None and new:
                pairs = F.create_map(*[F.lit(x) for kv in new.items() for x in kv])
                events = events.withColumn("_channel", F.coalesce(F.try_element_at(pairs, F.col("_channel")), F.col("_channel")))
            out = out._with(signal=self.signal.select(*self.keys, *[F.col(c).alias(new.get(c, c)) for c in own]), channels=channels, events=events)
        if drops or any(n in self.segment_vars and n not in self.vars for n in names):
            own = [n for n in names if n in self.segment_vars and n != "_recording"]
            out = out._with(segments=self.segments.select("_id", "_recording", *[F.col(c).alias(new.get(c, c)) for c in own]))
        return out._with(groups=tuple(new.get(g, g) for g in self.groups))

    def rename(self, **renamed: str) -> Recording:
        """new=old, in whichever table; events and groups follow."""
        old = {v: k for k, v in renamed.items()}
        if keys := set(old) & {*self.keys, "_recording"}:
            warnings.warn(f"renaming obligatory columns: {sorted(keys)}", stacklevel=2)
        if missing := set(old) - set(self.signal.columns) - set(self.segments.columns):
            raise ValueError(f"no such columns: {sorted(missing)}")
        events = self.events
        if events is not None and old:
            pairs = F.create_map(*[F.lit(x) for kv in old.items() for x in kv])
            events = events.withColumn("_channel", F.coalesce(F.try_element_at(pairs, F.col("_channel")), F.col("_channel")))
        return self._with(signal=self.signal.withColumnsRenamed(old), segments=self.segments.withColumnsRenamed(old), events=events, channels={old.get(c, c): v for c, v in self.channels.items()}, groups=tuple(old.get(g, g) for g in self.groups))

    def rename_with(self, fn: Callable[[str], str], *wanted) -> Recording:
        names = sel.resolve(self.vars + self.segment_vars, *wanted) if wanted else self.channel_names
        if set(names) & {*self.keys, "_recording"}:
            raise ValueError("obligatory columns can't be renamed")
        if not names:
            raise ValueError("nothing to rename")
        return self.rename(**{fn(n): n for n in names if fn(n) != n})

    def across_ch(self, fn: Callable[[Column], Column] | dict[str, Callable], *wanted) -> dict[str, Column]:
        """One expression a channel: ``x.mutate(**x.across_ch(f))``; a dict of functions names them ch_name."""
        names = sel.resolve(self.channel_names, *wanted)
        if isinstance(fn, dict):
            return {f"{c}_{k}": f(F.col(c)) for c in names for k, f in fn.items()}
        return {c: fn(F.col(c)) for c in names}

    def across(self, fns: Callable[[Column], Column] | dict[str, Callable] | list[Callable], *wanted) -> dict[str, Column]:
        """One expression for each column wanted, of the signal or the segments: named like it, or (a dict of functions)
        column_name, or (a list) column_1, column_2, …"""
        names = sel.resolve(self.vars + self.segment_vars, *wanted)
        if isinstance(fns, list):
            fns = {str(i): f for i, f in enumerate(fns, 1)}
        if isinstance(fns, dict):
            return {f"{c}_{k}": f(F.col(c)) for c in names for k, f in fns.items()}
        return {c: fns(F.col(c)) for c in names}

    def where(self, test: Callable[[str], bool]) -> sel.Selector:
        """Selector of the columns whose type (``double``, ``string``, …) passes the test."""
        return sel.any_of(c for t in (self.signal, self.segments) for c, kind in t.dtypes if test(kind))

    # -- rows ----------------------------------------------------------------------------------------------------
    def filter(self, *conditions, preserve: bool = False) -> Recording:
        """Rows of the signal (events are cut to what stays) or, for conditions on segments alone, whole segments."""
        if preserve:
            warnings.warn("groups are names and always stay: preserve has no effect", stacklevel=2)
        main = [c for c in conditions if routing.names(c) & set(self.signal.columns) - {"_id"}]
        rest = [c for c in conditions if c not in main]
        out = self
        if rest:
            part = [g for g in self.groups if g in self.segments.columns]
            tests = {f"_t{i}": routing.column(c, part, ["_id"]) for i, c in enumerate(rest)}
            segments = self.segments.withColumns(tests).filter(reduce(lambda a, b: a & b, [F.col(t) for t in tests])).drop(*tests)
            out = out._keep_ids(segments)._with(segments=segments)
        if main:
            needed = set().union(*(routing.names(c) for c in main)) | set(self.groups)
            tests = {f"_t{i}": routing.column(c, list(self.groups), self.keys) for i, c in enumerate(main)}
            signal = out.extended(needed).withColumns(tests).filter(reduce(lambda a, b: a & b, [F.col(t) for t in tests])).select(*out.signal.columns)
            clipped = out._clip(signal) if self.order == "_sample" else None
            out = out._with(signal=signal, events=clipped, segments=out.segments.join(signal.select("_id").distinct(), "_id", "left_semi"))
        return out

    def slice_signal(self, first: int, last: int) -> Recording:
        """Rows first..last (from 1) of the signal by id and sample, in each group if grouped."""
        part = list(self.groups)
        wide = self.extended(set(part))
        if part:
            nth = F.row_number().over(Window.partitionBy(*part).orderBy(*self.keys))
            signal = wide.withColumn("_nth", nth)
        else:  # positions over the whole table without one task: ids are counted, then rows inside an id
            signal = numbered(wide, "_id", [self.order], "_nth")
        signal = signal.filter(F.col("_nth").between(first, last)).select(*self.signal.columns)
        return self._with(signal=signal, events=self._clip(signal), segments=self.segments.join(signal.select("_id").distinct(), "_id", "left_semi"))

    def na_omit(self) -> Recording:
        signal = self.signal.dropna(subset=self.vars)
        return self._with(signal=signal, events=self._clip(signal), segments=self.segments.join(signal.select("_id").distinct(), "_id", "left_semi"))

    def drop_incomplete_segments(self) -> Recording:
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.channel_names])
        return self._keep_ids(self.signal.groupBy("_id").agg(F.bool_and(whole).alias("_ok")).filter("_ok"))

    # -- joins ---------------------------------------------------------------------------------------------------
    def left_join(self, other: DataFrame, by: list[str]) -> Recording:
        if not isinstance(other, DataFrame):
            raise TypeError("only tables can be joined")
        return self._with(segments=self.segments.join(other, by, "left").select("_id", *[c for c in self.segments.columns if c != "_id"], *[c for c in other.columns if c not in by]))

    def semi_join(self, other: DataFrame, by: list[str]) -> Recording:
        return self._keep_ids(self.segments.join(other.select(*by), by, "left_semi"))

    def anti_join(self, other: DataFrame, by: list[str]) -> Recording:
        o = other.select(*[F.col(b).alias(f"_o_{b}") for b in by]).distinct()
        on = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_o_{b}")) for b in by])
        return self._keep_ids(self.segments.join(o, on, "left_anti"))

    # -- groups --------------------------------------------------------------------------------------------------
    def group_by(self, *names: str, add: bool = False) -> Recording:
        if missing := [n for n in names if n not in self.signal.columns and n not in self.segments.columns]:
            raise ValueError(f"no such columns: {missing}")
        return self._with(groups=tuple(dict.fromkeys([*(self.groups if add else ()), *names])))

    def ungroup(self) -> Recording:
        return self._with(groups=())

    def summarize(self, _groups: str | None = None, **aggregates) -> Recording:
        """One row a group. Without _id among the groups each combination of the segment-side groups becomes a new
        segment; events are emptied."""
        if _groups is not None:
            warnings.warn("groups always stay as they are: _groups has no effect", stacklevel=2)
        by = list(self.groups)
        aggregates = {k: routing.column(a, [], []) if not isinstance(a, str) else F.expr(a) for k, a in aggregates.items()}
        flat = self.extended(set(by)).groupBy(*by).agg(*[a.alias(k) for k, a in aggregates.items()])
        side = [g for g in by if g in self.segments.columns and g != "_id"]
        if self.order not in by:
            flat = flat.withColumn(self.order, F.lit(None).cast(dict(self.signal.dtypes)[self.order]))
        if "_id" in by:
            segments = self.segments.join(flat.select("_id").distinct(), "_id", "left_semi")
        elif side:
            ids = flat.select(*side).distinct().withColumn("_id", F.row_number().over(Window.orderBy(*side)).cast("long"))  # as many rows as groups
            named = ids.select(F.col("_id").alias("_new"), *[F.col(c).alias(f"_s_{c}") for c in side])
            on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in side])
            flat = flat.join(named, on).select(F.col("_new").alias("_id"), *flat.columns)
            segments = ids.select("_id", *([] if "_recording" in side else [F.lit(None).cast("string").alias("_recording")]), *side)
        else:
            flat = flat.withColumn("_id", F.lit(1).cast("long"))
            segments = flat.select("_id").distinct().withColumn("_recording", F.lit(None).cast("string"))
        kinds = dict(flat.dtypes)
        signal = flat.select("_id", self.order, *[c for c in flat.columns if c in aggregates or (c in by and c not in side and c not in self.keys)])
        channels = {c: self.channels.get(c, {}) for c in aggregates if kinds[c] == "double"}
        return self._with(signal=signal, segments=segments, channels=channels, events=None if self.events is None else self.events.limit(0))

    # -- sets ----------------------------------------------------------------------------------------------------
    @classmethod
    def bind(cls, *parts: Recording) -> Recording:
        """All rows of all parts; ids are numbered anew by part and id, once, for the three tables. Spectra have no events.
        Models of components go along (of recordings with one name, the last part's)."""
        rate = {p.rate for p in parts}
        if len(rate) > 1:
            raise ValueError(f"sampling rates differ: {sorted(rate)}")
        if len({tuple(sorted(p.channels)) for p in parts}) > 1:
            warnings.warn("channels differ; missing ones are null", stacklevel=2)
        segments = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.segments.withColumn("_src", F.lit(i)) for i, p in enumerate(parts)])
        seen = segments.select("_src", "_id").distinct()
        counts = {r["_src"]: r["n"] for r in seen.groupBy("_src").agg(F.count("*").alias("n")).collect()}  # a row a part
        ids = reduce(lambda a, b: a.unionByName(b), [numbered(seen.filter(F.col("_src") == i), "_id", ["_src"], "_new").withColumn("_new", F.col("_new") + sum(counts.get(k, 0) for k in range(i))) for i in range(len(parts))])

        def join(get):
            if any(get(p) is None for p in parts):
                return None
            t = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [get(p).withColumn("_src", F.lit(i)) for i, p in enumerate(parts)])
            return t.join(ids, ["_src", "_id"]).drop("_src", "_id").withColumnRenamed("_new", "_id")

        signal, events, segs = join(lambda p: p.signal), join(lambda p: p.events), join(lambda p: p.segments)
        front = lambda t, *k: t.select(*k, *[c for c in t.columns if c not in k])
        channels = reduce(lambda a, b: b | a, [p.channels for p in parts])
        out = type(parts[0])(front(signal, "_id", parts[0].order), None if events is None else front(events, "_id"), front(segs, "_id", "_recording"), rate.pop(), channels)
        if hasattr(parts[0], "models"):
            out.models = reduce(lambda a, b: a | b, [p.models for p in parts])
        return out

    # -- output --------------------------------------------------------------------------------------------------
    def to_long(self, unit: str = "s") -> DataFrame:
        """_time (or _freq), _id, _key, _value and the columns of the segments."""
        names = self.channel_names + self.component_names
        if not names:
            raise ValueError("no channels or components")
        long = self.signal.unpivot(self.keys, names, "_key", "_value")
        if self.order == "_sample":
            long = long.withColumn("_time", as_time(F.col("_sample"), self.rate, unit)).drop("_sample")
        return long.join(self.segments, "_id", "left")

    def nsamples(self) -> DataFrame:
        return self.signal.groupBy("_id").agg((F.max("_sample") - F.min("_sample") + 1).cast("long").alias("n_samples"))

    def duration(self, unit: str = "s") -> DataFrame:
        return self.nsamples().select("_id", (F.col("n_samples") / scaling(self.rate, unit)).alias("duration"))

    def count_complete_cases(self, *by: str) -> DataFrame:
        """Segments without any null channel value, by segment columns; a group without one has 0."""
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.channel_names])
        ok = self.signal.groupBy("_id").agg(F.bool_and(whole).alias("_ok"))
        return self.segments.join(ok, "_id").groupBy(*by).agg(F.sum(F.col("_ok").cast("long")).alias("n"))

    def summary(self) -> dict[str, DataFrame]:
        """Rate and duration (HH:MM:SS) of all, segments by recording, events by kind, and the duration of each id."""
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.channel_names])
        ok = self.signal.groupBy("_id").agg(F.bool_and(whole).alias("_ok"))
        per = self.segments.join(ok, "_id", "left").groupBy("_recording").agg(F.count("*").alias("n_segments"), F.sum((~F.col("_ok")).cast("long")).alias("n_incomplete"))
        seconds = F.floor(F.count("*") / self.rate)
        clock = [F.lpad(v.cast("string"), 2, "0") for v in (F.floor(seconds / 60) % 60, seconds % 60)]
        hours = F.floor(seconds / 3600).cast("string")
        total = self.signal.agg(F.lit(float(self.rate)).alias("sampling_rate"), F.concat_ws(":", F.lpad(hours, F.greatest(F.length(hours), F.lit(2)), "0"), *clock).alias("duration"))
        return {"total": total, "segments": per, "events": self.events.groupBy("_type", "_description").agg(F.count("*").alias("n")), "duration": self.duration()}


class Spectrum(Recording):
    """Power by frequency: ``signal`` is keyed by _id and _freq, and there are no events."""

    order = "_freq"
