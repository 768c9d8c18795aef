"""Functions over channels of one row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Recording
from . import selectors as sel


def row_mean(names: list[str], na_rm: bool = False) -> Column:
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) if na_rm else F.col(c) for c in names])
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in names]) if na_rm else F.lit(len(names))
    return F.try_divide(total, n)


def row_apply(names: list[str], fn: str | Callable[..., Column], **pars) -> Column:
    """A named function (mean, sum, min, max, var, sd, median) or one over the array of the channels and ``pars``."""
    a = F.array(*[F.col(c) for c in names])
    total = F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = total / len(names)
    var = F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / (len(names) - 1) if len(names) > 1 else F.lit(None).cast("double")
    known = {"mean": mean, "sum": total, "min": F.array_min(a), "max": F.array_max(a), "var": var, "sd": F.sqrt(var), "median": (lambda s: (F.get(s, F.lit((len(names) - 1) // 2)) + F.get(s, F.lit(len(names) // 2))) / 2)(F.array_sort(a))}
    return known[fn] if isinstance(fn, str) else fn(a, **pars)


def chs_mean(x: Recording, *channels, na_rm: bool = False) -> Recording:
    """The channels replaced by their mean; events of single channels go."""
    names = sel.resolve(x.channel_names, *channels)
    events = None if x.events is None else x.events.filter("_channel is null")
    return x._with(signal=x.signal.select(*x.keys, row_mean(names, na_rm).alias("mean")), channels={"mean": {}}, events=events)


def chs_fun(x: Recording, fns: dict[str, str | Callable], *channels, **pars) -> Recording:
    """The channels replaced by one for each function; ``pars`` go to those that are callables."""
    names = sel.resolve(x.channel_names, *channels)
    events = None if x.events is None else x.events.filter("_channel is null")
    return x._with(signal=x.signal.select(*x.keys, *[row_apply(names, f, **pars).alias(k) for k, f in fns.items()]), channels={k: {} for k in fns}, events=events)


def rereference(x: Recording, *channels, ref: list[str], na_rm: bool = False) -> Recording:
    """Channels less the mean of the reference channels in the same row."""
    names = sel.resolve(x.channel_names, *channels)
    by = row_mean(ref, na_rm)
    signal = x.signal.withColumns({c: F.col(c) - by for c in names})
    return x._with(signal=signal, channels=x.channels | {c: x.channels[c] | {"_reference": ", ".join(ref)} for c in names})


def c_across_ch(x: Recording, fn: str | Callable, *channels) -> Column:
    return row_apply(sel.resolve(x.channel_names, *channels), fn)
