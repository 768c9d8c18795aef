"""Independent components: one model per recording, fitted in a group of its own and applied to Arrow batches."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import selectors as sel
from ..functions.channels import row_mean
from ..model import Recording
from ..plans import segments
from .timeline import events_to_na

#: Size of a component signal relative to its unit-variance source.
COMPONENT_SCALE = 10.0


class IcaRecording(Recording):
    """A recording with ``models``: recording → (channels, mixing A, unmixing W, component names); X = S·A and S = X·W."""

    models: dict[str, tuple[list[str], np.ndarray, np.ndarray, list[str]]]

    def filter(self, *conditions, preserve: bool = False) -> IcaRecording:
        out = super().filter(*conditions, preserve=preserve)
        left = {r["_recording"] for r in out.segments.select("_recording").distinct().collect()}
        return out._with(models={k: v for k, v in self.models.items() if k in left})

    def summary(self) -> dict[str, DataFrame]:
        """As of a recording, with the table of the components."""
        return super().summary() | {"components": summary_table(self) if _eyes(self) else var_table(self)}

    def matrices(self) -> DataFrame:
        rows = [(r, n, c, float(a[i, j])) for r, (chs, a, _, names) in self.models.items() for i, n in enumerate(names) for j, c in enumerate(chs)]
        return self.signal.sparkSession.createDataFrame(rows, "_recording string, _ica string, _channel string, _value double")


def _whiten(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x - x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    keep = values > values.max() * 1e-12
    k = vectors[:, keep][:, ::-1] / np.sqrt(values[keep][::-1])
    return x @ k, k


#: Nonlinearities and the means of their slopes.
_NONLINEAR = {
    "tanh": lambda y: ((g := np.tanh(y)), (1 - g * g).mean(0)),
    "pow3": lambda y: (y**3, (3 * y * y).mean(0)),
    "gaus": lambda y: (y * (e := np.exp(-y * y / 2)), ((1 - y * y) * e).mean(0)),
}


def _cumulants(z: np.ndarray, k: int) -> np.ndarray:
    """Fourth-order cumulant matrices of the pairs of columns of white ``z`` less than ``k`` apart."""
    n, out = z.shape[1], []
    for i in range(n):
        for j in range(i, min(n, i + k)):
            own = np.zeros((n, n))
            own[i, j] += 1
            own[j, i] += 1
            out.append((z * (z[:, i] * z[:, j])[:, None]).T @ z / len(z) - (i == j) * np.eye(n) - own)
    return np.array(out)


def _joint_diagonal(m: np.ndarray, tol: float, sweeps: int) -> np.ndarray:
    """Rotation R for which the matrices R·m·Rᵀ are as diagonal as can be, by plane rotations."""
    n, r = m.shape[1], np.eye(m.shape[1])
    for _ in range(sweeps):
        largest = 0.0
        for p in range(n - 1):
            for q in range(p + 1, n):
                d, o = m[:, p, p] - m[:, q, q], m[:, p, q] + m[:, q, p]
                angle = np.arctan2(2 * (d @ o), d @ d - o @ o) / 4
                largest = max(largest, abs(angle))
                turn = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
                m[:, [p, q], :] = np.einsum("ab,kbc->kac", turn, m[:, [p, q], :])
                m[:, :, [p, q]] = np.einsum("kcb,ab->kca", m[:, :, [p, q]], turn)
                r[[p, q]] = turn @ r[[p, q]]
        if largest < tol:
            break
    return r


def fast_ica(x: np.ndarray, method: str = "parallel", tol: float = 1e-6, iterations: int = 1000, start: np.ndarray | None = None, g: str = "tanh", kj: int = 0) -> np.ndarray:
    """Unmixing matrix W (channels × components) by fixed-point iterations with the nonlinearity ``g`` (tanh, pow3, gaus);
    parallel, deflation or adaptive (deflation from a fourth-order start or, with ``kj``, from the rotation that makes
    the cumulants of columns of that start less than ``kj`` apart most diagonal)."""
    if g not in _NONLINEAR:
        raise ValueError(f"unknown nonlinearity {g!r}: {', '.join(_NONLINEAR)}")
    z, k = _whiten(x)
    n = z.shape[1]
    w = np.random.RandomState(1).standard_normal((n, n)) if start is None else np.array(start, float)
    if method == "adaptive":
        _, w = np.linalg.eigh((z * (z * z).sum(1, keepdims=True)).T @ z / len(z))
        w = w.T
        if kj:
            w = _joint_diagonal(_cumulants(z @ w.T, kj), tol, iterations) @ w
    done = True

    def step(v: np.ndarray) -> np.ndarray:
        y, slope = _NONLINEAR[g](z @ v)
        return z.T @ y / len(z) - v * slope

    if method == "parallel":
        sym = lambda m: (lambda u, s, v: u @ v)(*np.linalg.svd(m))
        w = sym(w)
        for _ in range(iterations):
            new = sym(step(w.T).T)
            moved = np.max(np.abs(np.abs((new * w).sum(1)) - 1))
            w = new
            if moved < tol:
                break
        else:
            done = False
    else:
        for i in range(n):
            v = w[i] / np.linalg.norm(w[i])
            for _ in range(iterations):
                new = step(v)
                new -= w[:i].T @ (w[:i] @ new)
                new /= np.linalg.norm(new)
                moved = abs(abs(new @ v) - 1)
                v = new
                if moved < tol:
                    break
            else:
                done = False
            w[i] = v
    if not done:
        warnings.warn("the components did not converge", stacklevel=2)
    return k @ w.T


def fit(x: Recording, *channels, ignore: Column | str | None = "_type = 'artifact'", method: str | Callable = "parallel", **config) -> IcaRecording:
    """Models of the channels for each recording, from complete rows outside the ignored events. ``method`` may be a
    function from a matrix to W, A or (A, W)."""
    names = sel.resolve(x.channel_names, *channels)
    clean = events_to_na(x, ignore, entire_seg=False, drop_events=False) if ignore is not None else x
    rows = clean.signal.select("_id", "_sample", *names).dropna().join(x.segments.select("_id", "_recording"), "_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values(["_id", "_sample"])[names].to_numpy(float)
        got = method(m, **config) if callable(method) else fast_ica(m, method, **config)
        a, w = got if isinstance(got, tuple) else (None, got)
        w = np.linalg.pinv(a) if w is None else np.asarray(w)
        a = np.linalg.pinv(w) if a is None else np.asarray(a)
        return pd.DataFrame({"_recording": [pdf["_recording"].iloc[0]], "a": [a.ravel().tolist()], "w": [w.ravel().tolist()]})

    # a matrix of channels × channels for each recording
    fitted = rows.groupBy("_recording").applyInPandas(run, "_recording string, a array<double>, w array<double>").collect()
    models = {}
    for r in fitted:
        w = np.array(r["w"]).reshape(len(names), -1)
        models[r["_recording"]] = (names, np.array(r["a"]).reshape(-1, len(names)), w, [f"ICA{i + 1}" for i in range(w.shape[1])])
    out = IcaRecording(x.signal, x.events, x.segments, x.rate, x.channels, x.groups)
    out.models = models
    return out


def _centred(x: IcaRecording) -> tuple[DataFrame, list[str]]:
    names = next(iter(x.models.values()))[0]
    means = x.signal.join(x.segments.select("_id", "_recording"), "_id").groupBy("_recording").agg(*[F.avg(c).alias(f"_m_{c}") for c in names])
    return x.signal.join(x.segments.select("_id", "_recording"), "_id").join(means, "_recording"), names


def _applied(wide: DataFrame, names: list[str], weights: dict[str, np.ndarray], out: list[str]) -> DataFrame:
    """``wide`` with the columns ``out``: Σ (channel − mean)·weight, with the weights of the row's recording (none: null), as
    a matrix product of each Arrow batch, as expressions would have channels × components terms."""

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            v = segments.values(t, names) - segments.values(t, [f"_m_{c}" for c in names])
            which = t.column("_recording").combine_chunks().dictionary_encode()
            codes = which.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            y = np.full((len(v), len(out)), np.nan)
            for k, r in enumerate(which.dictionary.to_pylist()):
                if r in weights:
                    y[codes == k] = v[codes == k] @ weights[r]
            yield pa.RecordBatch.from_arrays([*b.columns, *(segments.column(y[:, j]) for j in range(len(out)))], names=schema.names)

    schema = T.StructType([*wide.schema.fields, *(T.StructField(c, T.DoubleType()) for c in out)])
    return wide.mapInArrow(run, schema)


def with_models(x: Recording, models: dict[str, tuple[np.ndarray, np.ndarray]], *channels) -> IcaRecording:
    """``x`` with given models: recording → (mixing, unmixing) for the channels."""
    names = sel.resolve(x.channel_names, *channels)
    out = IcaRecording(x.signal, x.events, x.segments, x.rate, x.channels, x.groups)
    out.models = {}
    for r, (a, w) in models.items():
        a, w = np.asarray(a, float), np.asarray(w, float)
        if w.shape[0] != len(names) or a.shape != w.T.shape:
            raise ValueError(f"the matrices of {r} are not those of {len(names)} channels")
        out.models[r] = (names, a, w, [f"ICA{i + 1}" for i in range(w.shape[1])])
    return out


def without_models(x: IcaRecording) -> Recording:
    """The recording alone; components shown stay as ordinary columns of it."""
    return Recording(x.signal, x.events, x.segments, x.rate, x.channels, x.groups)


def show(x: IcaRecording, *components) -> IcaRecording:
    """Components as further columns."""
    wide, names = _centred(x)
    all_ = next(iter(x.models.values()))[3]
    chosen = sel.resolve(all_, *components)
    weights = {r: m[2][:, [all_.index(c) for c in chosen]] * COMPONENT_SCALE for r, m in x.models.items()}
    signal = _applied(wide.drop(*chosen), names, weights, chosen).select(*[c for c in x.signal.columns if c not in chosen], *chosen)
    return x._with(signal=signal, channels=x.channels | {c: {"kind": "component"} for c in chosen})


def keep(x: IcaRecording, *components, **by_recording) -> IcaRecording:
    """Channels rebuilt from the components kept (``-ICA1`` drops one), for all recordings or each by name."""
    wide, names = _centred(x)
    parts, models = {}, {}
    for r, (chs, a, w, comps) in x.models.items():
        wanted = by_recording.get(r, components)
        chosen = sel.resolve(comps, *([wanted] if isinstance(wanted, str) else wanted))
        at = [comps.index(c) for c in chosen]
        parts[r] = w[:, at] @ a[at]
        models[r] = (chs, a[at], w[:, at], chosen)
    back = {c: (F.col(f"_r_{c}") + F.col(f"_m_{c}")).alias(c) for c in names}
    signal = _applied(wide, names, parts, [f"_r_{c}" for c in names]).select(*[back.get(c, c) for c in x.signal.columns if c not in x.component_names])
    return x._with(signal=signal, models=models, channels={c: v for c, v in x.channels.items() if v.get("kind") != "component"})


def _eyes(x: IcaRecording) -> tuple[str, ...]:
    return tuple(c for c in x.channel_names if c.lower().startswith("eog") or c.lower().endswith("eog"))


def cor_table(x: IcaRecording, *eog: str, max_sample: int | None = None) -> DataFrame:
    """_recording, _ica, _eog, cor: correlation of each component with each eye channel, strongest first."""
    eog = eog or _eyes(x)
    shown = show(_thinned(x, max_sample))
    comps = shown.component_names
    wide = shown.signal.join(x.segments.select("_id", "_recording"), "_id").dropna(subset=[*comps, *eog])
    flat = wide.groupBy("_recording").agg(F.array(*[F.struct(F.lit(c).alias("_ica"), F.lit(e).alias("_eog"), F.corr(c, e).alias("cor")) for c in comps for e in eog]).alias("_all"))
    return flat.select("_recording", F.inline("_all")).orderBy(F.desc(F.abs("cor")))


def _thinned(x: IcaRecording, max_sample: int | None) -> IcaRecording:
    if not max_sample:
        return x
    from .dsp import downsample

    return downsample(x, max_sample=max_sample)


def var_table(x: IcaRecording, max_sample: int | None = None) -> DataFrame:
    """_recording, _ica, var: share of the variance a component explains, largest first; from sums over channels, as the
    mean of a covariance matrix is the variance of the row mean."""
    wide, names = _centred(_thinned(x, max_sample))
    total = row_mean(names)
    comps = next(iter(x.models.values()))[3]
    parts = [f"_part_{c}" for c in comps]
    wide = _applied(wide, names, {r: m[2] * m[1].mean(1) for r, m in x.models.items()}, parts)
    middle = reduce(lambda a, b: a + b, [F.col(f"_m_{n}") for n in names]) / len(names)
    rest = [F.col(c) + middle - total for c in parts]
    flat = wide.dropna(subset=names).groupBy("_recording").agg(*[(1 - F.var_samp(r) / F.var_samp(total)).alias(c) for c, r in zip(comps, rest, strict=True)])
    return flat.unpivot(["_recording"], comps, "_ica", "var").orderBy(F.desc("var"))


def summary_table(x: IcaRecording, *eog: str, max_sample: int | None = None) -> DataFrame:
    return cor_table(x, *eog, max_sample=max_sample).join(var_table(x, max_sample), ["_recording", "_ica"]).orderBy(F.desc("var"), F.desc(F.abs("cor")))
