"""Filters and resampling. Coefficients are designed on the driver; segments of one length are filtered as a matrix."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import selectors as sel
from ..model import Recording
from ..plans import segments


# -- design ------------------------------------------------------------------------------------------------------
#: Length of a filter times its transition width, in units of the rate, for each window.
LENGTHS = {"hann": 3.1, "hamming": 3.3, "blackman": 5.0}
#: Cosine terms of the windows.
_TERMS = {"hann": (0.5, 0.5, 0.0), "hamming": (0.54, 0.46, 0.0), "blackman": (0.42, 0.5, 0.08)}


def _lowpass(rate: float, cut: float, n: int, window: str = "hamming") -> np.ndarray:
    """Windowed sinc of n taps and gain 1 at 0 Hz."""
    t, turn = np.arange(n) - (n - 1) / 2, 2 * np.pi * np.arange(n) / max(1, n - 1)
    a, b, c = _TERMS[window]
    h = np.sinc(2 * cut / rate * t) * (a - b * np.cos(turn) + c * np.cos(2 * turn))
    return h / h.sum()


def fir(rate: float, low: float | None, high: float | None, low_width: float | None = None, high_width: float | None = None, length: int | None = None, window: str = "hamming") -> np.ndarray:
    """Windowed-sinc taps passing ``low``..``high`` Hz (None: open); low > high stops high..low instead.

    Each transition has a filter as long as its own width asks for, centred in the longest one. A band-stop has its
    transitions inside the stopped band, and is refused where they would cross.
    """
    nyquist = rate / 2
    if window not in LENGTHS:
        raise ValueError(f"unknown window {window!r}: {', '.join(LENGTHS)}")
    for f in (low, high):
        if f is not None and not 0 < f < nyquist:
            raise ValueError(f"frequencies must be between 0 and {nyquist}")
    lw = low_width or (min(max(0.25 * low, 2), low) if low else None)
    hw = high_width or (min(max(0.25 * high, 2), nyquist - high) if high else None)
    stop = low is not None and high is not None and low > high
    if stop and high + hw > low - lw:
        raise ValueError(f"the transitions of {hw:g} and {lw:g} Hz cross inside the stopped band {high:g}..{low:g} Hz: set a smaller low_width and high_width")
    if low and low - lw < 0 or high and high + hw > nyquist:
        raise ValueError(f"a transition leaves the range from 0 to {nyquist} Hz")
    odd = lambda w: (n := max(1, int(round(LENGTHS[window] * rate / w)))) + 1 - n % 2
    needed = max(odd(w) for w in (lw, hw) if w)
    n = length or needed
    n += 1 - n % 2
    if n < needed:
        raise ValueError(f"{n} taps are too few for these transitions, which need {needed}")

    def part(cut: float, width: float) -> np.ndarray:
        h = _lowpass(rate, cut, odd(width), window)
        return np.pad(h, (n - len(h)) // 2)

    unit = np.zeros(n)
    unit[n // 2] = 1
    if low is None and high is None:
        return unit
    if low is None:
        return part(high + hw / 2, hw)
    if high is None:
        return unit - part(low - lw / 2, lw)
    if stop:  # pass below high and above low
        return part(high + hw / 2, hw) + unit - part(low - lw / 2, lw)
    return part(high + hw / 2, hw) - part(low - lw / 2, lw)


def _reflected(v: np.ndarray, pad: int) -> np.ndarray:
    """Rows of ``v`` with ``pad`` values of odd reflection at both ends."""
    if not pad:
        return v
    return np.concatenate([2 * v[:, :1] - v[:, pad:0:-1], v, 2 * v[:, -1:] - v[:, -2 : -pad - 2 : -1]], axis=1)


def apply_fir(v: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Zero phase along the last axis: odd reflection at both ends, products of transformed blocks, the delay taken off."""
    rows = np.atleast_2d(v).astype(float)
    n, pad = rows.shape[1], min(len(h) - 1, rows.shape[1] - 1)
    wide = np.concatenate([_reflected(rows, pad), np.zeros((len(rows), len(h) - 1))], axis=1)
    size = 1 << int(np.ceil(np.log2(min(max(8 * len(h), 4096), wide.shape[1] + len(h) - 1))))
    step = size - len(h) + 1
    blocks = -(-wide.shape[1] // step)
    wide = np.pad(wide, ((0, 0), (len(h) - 1, blocks * step - wide.shape[1])))
    frames = np.lib.stride_tricks.sliding_window_view(wide, size, axis=1)[:, ::step]
    full = np.fft.irfft(np.fft.rfft(frames, axis=2) * np.fft.rfft(h, size), size, axis=2)[:, :, len(h) - 1 :].reshape(len(rows), -1)
    at = pad + (len(h) - 1) // 2
    return full[:, at : at + n].reshape(np.shape(v))


def _prototype(kind: str, order: int, rp: float, rs: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of an analogue low-pass with edge 1."""
    k = np.arange(1, order + 1)
    angle = np.pi * (2 * k - 1) / (2 * order)
    if kind == "butter":
        p = 1j * np.exp(1j * angle)
        return np.zeros(0), p, 1.0
    if kind == "cheby1":
        mu = np.arcsinh(1 / np.sqrt(10 ** (rp / 10) - 1)) / order
        p = -np.sinh(mu) * np.sin(angle) + 1j * np.cosh(mu) * np.cos(angle)
        gain = np.prod(-p).real / (1 if order % 2 else 10 ** (rp / 20))
        return np.zeros(0), p, gain
    if kind == "cheby2":
        mu = np.arcsinh(np.sqrt(10 ** (rs / 10) - 1)) / order
        c = np.cos(angle)
        z = 1j / c[np.abs(c) > 1e-12]
        p = 1 / (-np.sinh(mu) * np.sin(angle) + 1j * np.cosh(mu) * c)
        return z, p, (np.prod(-p) / np.prod(-z)).real
    return _elliptic(order, rp, rs)


def _moduli(k: float) -> list[float]:
    """Descending Landen moduli below ``k``."""
    out = []
    while k > 1e-15:
        k = (k / (1 + np.sqrt(1 - k * k))) ** 2
        out.append(k)
    return out


def _ascend(w, k: float):
    """From sine or cosine of the quarter-period angle to the elliptic sn or cd of modulus ``k``."""
    for v in reversed(_moduli(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _inverse_sn(w: complex, k: float) -> complex:
    """u with sn(u K, k) = w, in quarter periods."""
    for v in _moduli(k):
        w = 2 * w / ((1 + v) * (1 + np.sqrt(1 - (k * w) ** 2 + 0j)))
        k = v
    return 2 / np.pi * np.arcsin(w + 0j)


def _elliptic(order: int, rp: float, rs: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Equal ripple in both bands; the pass band of ripple ``rp`` dB ends at 1 and the stop band lies ``rs`` dB down."""
    ripple = np.sqrt(10 ** (rp / 10) - 1)
    k1 = ripple / np.sqrt(10 ** (rs / 10) - 1)
    u = (2 * np.arange(1, order // 2 + 1) - 1) / order
    rest = np.sqrt(1 - k1 * k1)
    k = np.sqrt(1 - (rest**order * np.prod(_ascend(np.sin(u * np.pi / 2), rest) ** 4)) ** 2)
    v = (-1j * _inverse_sn(1j / ripple, k1) / order).real
    z = 1j / (k * _ascend(np.cos(u * np.pi / 2), k))
    p = 1j * _ascend(np.cos((u - 1j * v) * np.pi / 2), k)
    z, p = np.concatenate([z, z.conj()]), np.concatenate([p, p.conj()])
    if order % 2:
        p = np.append(p, (1j * _ascend(np.sin(1j * v * np.pi / 2), k)).real)
    return z, p, (np.prod(-p) / np.prod(-z)).real / (1 if order % 2 else 10 ** (rp / 20))


def _quarter(k: float) -> float:
    """Quarter period of the modulus ``k``, by the arithmetic-geometric mean."""
    a, b = 1.0, np.sqrt(1 - k * k)
    while a - b > 1e-15:
        a, b = (a + b) / 2, np.sqrt(a * b)
    return np.pi / (2 * a)


def _least(kind: str, reach: float, gpass: float, gstop: float) -> tuple[int, float]:
    """Least order of a low-pass that loses at most ``gpass`` dB up to 1 and at least ``gstop`` dB from ``reach`` on, and
    the factor that moves the edge of its prototype to where it loses ``gpass``."""
    ripple = np.sqrt(10 ** (gpass / 10) - 1)
    drop = np.sqrt(10 ** (gstop / 10) - 1) / ripple
    whole = lambda v: max(1, int(np.ceil(v - 1e-9)))
    if kind == "butter":
        n = whole(np.log(drop) / np.log(reach))
        return n, ripple ** (-1 / n)
    if kind == "ellip":
        k, k1 = 1 / reach, 1 / drop
        return whole(_quarter(k) * _quarter(np.sqrt(1 - k1 * k1)) / (_quarter(np.sqrt(1 - k * k)) * _quarter(k1))), 1.0
    n = whole(np.arccosh(drop) / np.arccosh(reach))
    return n, np.cosh(np.arccosh(drop) / n) if kind == "cheby2" else 1.0


def _reach(rate: float, low: float | None, high: float | None, low_width: float | None, high_width: float | None, warp) -> float:
    """Where the prototype's stop band begins, if its pass band ends at 1."""
    lw, hw = low_width or (low and max(0.25 * low, 2)), high_width or (high and max(0.25 * high, 2))
    stops = [f for f in (low and low - lw, high and high + hw) if f is not None]
    if any(not 0 < f < rate / 2 for f in stops) or (low and high and low > high and stops[0] < stops[1]):
        raise ValueError(f"the stop bands cannot begin at {stops} Hz: set low_width and high_width")
    if low is None or high is None:
        return warp(high + hw) / warp(high) if low is None else warp(low) / warp(low - lw)
    a, b = sorted((warp(low), warp(high)))
    each = [abs(w * w - a * b) / (w * (b - a)) for w in map(warp, stops)]
    return min(each) if low < high else 1 / max(each)


def iir(rate: float, low: float | None, high: float | None, kind: str = "butter", order: int | None = None, rp: float = 1.0, rs: float = 40.0, gpass: float | None = None, gstop: float | None = None, low_width: float | None = None, high_width: float | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections by the bilinear transform; the same meaning of low and high as ``fir``.

    With ``gpass`` and ``gstop`` (dB of one of the two passes) the order is the least that loses at most the one inside
    low..high and at least the other beyond the transitions of ``low_width`` and ``high_width`` Hz.
    """
    both = low is not None and high is not None
    if kind not in ("butter", "cheby1", "cheby2", "ellip"):
        raise ValueError(f"unknown filter {kind!r}: butter, cheby1, cheby2 or ellip")
    n, edge = order or (4 if both else 6), 1.0
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    if (gpass is None) != (gstop is None) or gpass is not None and (order or not 0 < gpass < gstop):
        raise ValueError("give an order, or both gpass and gstop with 0 < gpass < gstop")
    if gpass is not None:
        n, edge = _least(kind, _reach(rate, low, high, low_width, high_width, warp), gpass, gstop)
        rp, rs = gpass, gstop
    z, p, k = _prototype(kind, n, rp, rs)
    degree = len(p) - len(z)
    z, p, k = z * edge, p * edge, k * edge**degree
    if not both:
        w = warp(high if low is None else low)
        if low is None:
            z, p, k = z * w, p * w, k * w**degree
        else:
            k = (k * np.prod(-z) / np.prod(-p)).real
            z, p = np.append(w / z, np.zeros(degree)), w / p
    else:
        a, b = sorted((warp(low), warp(high)))
        width, mid = b - a, np.sqrt(a * b)
        if low < high:
            zl, pl = z * width / 2, p * width / 2
            extra = np.zeros(degree)
            k = k * width**degree
        else:
            k = (k * np.prod(-z) / np.prod(-p)).real
            zl, pl = width / 2 / z, width / 2 / p
            extra = np.concatenate([np.full(degree, 1j * mid), np.full(degree, -1j * mid)])
        pair = lambda r: np.concatenate([r + np.sqrt(r.astype(complex) ** 2 - mid**2), r - np.sqrt(r.astype(complex) ** 2 - mid**2)])
        z, p = np.concatenate([pair(zl), extra]), pair(pl)
    s = 2 * rate
    k = (k * np.prod(s - z) / np.prod(s - p)).real
    z, p = np.concatenate([(s + z) / (s - z), np.full(len(p) - len(z), -1.0)]), (s + p) / (s - p)
    if np.any(np.abs(p) >= 1):
        raise ValueError("the filter is unstable: poles outside the unit circle")
    order_p = sorted(p, key=lambda r: (round(abs(r.imag), 12) == 0, -abs(r), round(r.real, 12), r.imag))
    order_z = sorted(z, key=lambda r: (round(abs(r.imag), 12) == 0, round(r.real, 12), round(abs(r.imag), 12), r.imag))
    order_p, order_z = _paired(order_p), _paired(order_z)
    out = []
    for i in range(0, len(order_p), 2):
        a, b = np.poly(order_p[i : i + 2]).real, np.poly(order_z[i : i + 2]).real
        out.append((np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))))
    out[0] = (out[0][0] * k, out[0][1])
    return out


def _paired(roots: list[complex]) -> list[complex]:
    """Conjugates next to each other, then the real ones."""
    rest, out = [r for r in roots if abs(r.imag) > 1e-10], []
    while rest:
        r = rest.pop(0)
        i = min(range(len(rest)), key=lambda j: abs(rest[j] - r.conjugate()))
        out += [r, rest.pop(i)]
    return out + sorted((complex(r.real) for r in roots if abs(r.imag) <= 1e-10), key=lambda r: r.real)


#: Samples of a block of the recursion; inside a block it is a matrix product.
_BLOCK = 64


def _section(b: np.ndarray, a: np.ndarray, v: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A second-order section along the rows of ``v`` from ``state`` (rows by 2).

    The recursion is one matrix product for what the samples of a block give its outputs and its last state, and a step a
    block for what the state before it adds.
    """
    m, n = v.shape
    size = min(_BLOCK, n)
    blocks = -(-n // size)
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    enter = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(size):
        powers.append(step @ powers[-1])
    seen = np.array([p[0] for p in powers[:size]])  # what a state gives each output of its block
    impulse = np.concatenate([[b[0]], [p[0] @ enter for p in powers[: size - 1]]])
    gives = np.zeros((size, size))
    for i in range(size):
        gives[i, i:] = impulse[: size - i]
    ends = np.array([powers[size - 1 - i] @ enter for i in range(size)])
    x = np.pad(v, ((0, 0), (0, blocks * size - n))).reshape(m, blocks, size)
    y, into = x @ gives, x @ ends
    states = np.empty((m, blocks, 2))
    across = powers[size].T
    for k in range(blocks):
        states[:, k] = state
        state = state @ across + into[:, k]
    y += states @ seen.T
    return y.reshape(m, -1)[:, :n]


def apply_iir(v: np.ndarray, sections) -> np.ndarray:
    """Forward and backward along the last axis, with odd reflection and steady-state starts, so the phase is zero."""
    rows = np.atleast_2d(v).astype(float)
    pad = min(3 * (2 * len(sections) + 1), rows.shape[1] - 1)
    wide = _reflected(rows, pad)
    for _ in range(2):
        level = wide[:, :1].copy()
        for b, a in sections:
            gain = b.sum() / a.sum()
            wide = _section(b, a, wide, level * np.array([gain - b[0], b[2] - a[2] * gain]))
            level = level * gain
        wide = wide[:, ::-1]
    return wide[:, pad : pad + rows.shape[1]].reshape(np.shape(v))


# -- operators ---------------------------------------------------------------------------------------------------
def _rows(v: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Segments of one length as (segments x channels) rows of samples."""
    return v[rows].transpose(0, 2, 1).reshape(-1, rows.shape[1])


def _per_segment(x: Recording, names: list[str], fn, na_rm: bool) -> Recording:
    def run(table, bounds):
        v = segments.values(table, names)
        holed = np.logical_or.reduceat(np.isnan(v), bounds[:-1])  # segments by channels
        if holed.any() and not na_rm:
            raise ValueError(f"channel {names[int(np.flatnonzero(holed.any(0))[0])]} has nulls; na_rm=True makes such segments null")
        for which, rows in segments.by_length(bounds):
            y = fn(np.nan_to_num(_rows(v, rows))).reshape(len(which), len(names), -1)
            y[holed[which]] = np.nan
            v[rows] = y.transpose(0, 2, 1)
        for i, c in enumerate(names):
            table = table.set_column(table.schema.get_field_index(c), c, segments.column(v[:, i]))
        return table

    return x._with(signal=segments.over(x.signal, "_sample", _with_doubles(x, names), run))


def _with_doubles(x: Recording, names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in names else f for f in x.signal.schema])


def _filter(x: Recording, channels, low, high, method: str, na_rm: bool, config: dict | None) -> Recording:
    names, config = sel.resolve(x.channel_names, *channels), config or {}
    if method == "fir":
        h = fir(x.rate, low, high, **config)
        return _per_segment(x, names, lambda v: apply_fir(v, h), na_rm)
    if method == "iir":
        sections = _sections(x.rate, low, high, **config)
        return _per_segment(x, names, lambda v: apply_iir(v, sections), na_rm)
    raise ValueError("method must be fir or iir")


def _sections(rate: float, low: float | None, high: float | None, sos=None, b=None, a=None, **design) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections given as they are (rows b0 b1 b2 a0 a1 a2) or as polynomials b and a, else designed."""
    if sos is not None:
        rows = np.asarray(sos, float).reshape(-1, 6)
        out = [(r[:3] / r[3], r[3:] / r[3]) for r in rows]
    elif b is not None and a is not None:
        b, a = np.trim_zeros(np.asarray(b, float), "b"), np.trim_zeros(np.asarray(a, float), "b")
        out = _factored(np.roots(b), np.roots(a), b[np.flatnonzero(b)[0]] / a[0], np.flatnonzero(b)[0])
    else:
        return iir(rate, low, high, **design)
    if any(np.abs(np.roots(np.trim_zeros(s[1], "b"))).max(initial=0) >= 1 for s in out):
        raise ValueError("the filter is unstable: poles outside the unit circle")
    return out


def _factored(z: np.ndarray, p: np.ndarray, k: float, delay: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections of zeros, poles and gain; ``delay`` samples come before the first."""
    pairs = lambda r: [np.poly(r[i : i + 2]).real for i in range(0, len(r), 2)]
    tops, bottoms = pairs(_paired(list(z))), pairs(_paired(list(p)))
    out = []
    for i in range(max(len(tops), len(bottoms), 1)):
        t, u = (tops[i] if i < len(tops) else np.ones(1)), (bottoms[i] if i < len(bottoms) else np.ones(1))
        out.append((np.pad(t, (0, 3 - len(t))), np.pad(u, (0, 3 - len(u)))))
    out[0] = (out[0][0] * k, out[0][1])
    for d in range(0, delay, 2):
        out.append((np.eye(3)[min(2, delay - d)], np.array([1.0, 0, 0])))
    return out


def pass_between(x: Recording, *channels, freq: tuple[float | None, float | None], method: str = "fir", na_rm: bool = False, config: dict | None = None) -> Recording:
    """A filter with the lower and the upper frequency that passes; None leaves that side open."""
    low, high = freq
    if low is None and high is None:
        return x
    return _filter(x, channels, low, high, method, na_rm, config)


def low_pass(x: Recording, *channels, freq: float, method: str = "fir", na_rm: bool = False, config: dict | None = None) -> Recording:
    return _filter(x, channels, None, freq, method, na_rm, config)


def high_pass(x: Recording, *channels, freq: float, method: str = "fir", na_rm: bool = False, config: dict | None = None) -> Recording:
    return _filter(x, channels, freq, None, method, na_rm, config)


def band_pass(x: Recording, *channels, freq: tuple[float, float], method: str = "fir", na_rm: bool = False, config: dict | None = None) -> Recording:
    if freq[0] >= freq[1]:
        raise ValueError("the first frequency must be below the second")
    return _filter(x, channels, *freq, method, na_rm, config)


def band_stop(x: Recording, *channels, freq: tuple[float, float], method: str = "fir", na_rm: bool = False, config: dict | None = None) -> Recording:
    """Stops freq[1]..freq[0]: the first frequency is the higher."""
    if freq[0] <= freq[1]:
        raise ValueError("the first frequency must be above the second")
    return _filter(x, channels, *freq, method, na_rm, config)


def factors(q: int, largest: int = 13) -> list[int]:
    """Prime factors put together to steps of at most ``largest``."""
    primes, n, f = [], q, 2
    while n > 1:
        while n % f == 0:
            primes.append(f)
            n //= f
        f += 1
    out: list[int] = []
    for p in sorted(primes, reverse=True):
        for i, o in enumerate(out):
            if o * p <= largest:
                out[i] *= p
                break
        else:
            out.append(p)
    return out


def downsample(x: Recording, q: float = 2, max_sample: int | None = None, ftype: str = "iir", n: int | None = None, multiple_times: bool = False) -> Recording:
    """Every q-th sample after an anti-alias filter, per segment; events and the rate follow.

    ``max_sample`` sets q so that the longest segment has at most that many samples. Segments with nulls are only
    thinned out.
    """
    if max_sample:
        longest = x.nsamples().agg(F.max("n_samples")).first()[0]
        q = max(1, -(-longest // max_sample))
        if q == 1:
            return x
    if q < 2:
        raise ValueError("q must be at least 2")
    if q != int(q):
        warnings.warn(f"q is rounded to {round(q)}", stacklevel=2)
    q, rate, names = round(q), x.rate, x.channel_names
    steps = factors(q) if multiple_times else [q]

    def thin(v: np.ndarray) -> np.ndarray:
        r = rate
        for s in steps:
            if ftype == "iir":
                v = apply_iir(v, iir(r, None, 0.8 * r / 2 / s, "cheby1", n or 8, rp=0.05))
            else:
                cut = 0.8 * r / 2 / s
                v = apply_fir(v, _lowpass(r, cut + min(max(0.25 * cut, 2), r / 2 - cut) / 2, (n or 30) + 1 - (n or 30) % 2))
            v, r = v[:, ::s], r / s
        return v

    def run(table, bounds):
        v, sample = segments.values(table, names), table.column("_sample").to_numpy()
        parts, keep, renumbered = [], [], []
        for which, rows in segments.by_length(bounds):
            wide = _rows(v, rows)
            bad = np.isnan(wide).any(1) | (rows.shape[1] < 2)
            y = wide[:, ::q].copy()
            if not bad.all():
                y[~bad] = thin(wide[~bad])[:, : y.shape[1]]
            keep.append(rows[:, ::q].ravel())
            first = -(-sample[rows[:, 0]].astype(np.int64) // q)
            renumbered.append((first[:, None] + np.arange(y.shape[1])).ravel())
            parts.append(y.reshape(len(which), len(names), -1).transpose(0, 2, 1).reshape(-1, len(names)))
        out, y = table.take(pa.array(np.concatenate(keep))), np.concatenate(parts)
        for i, c in enumerate(names):
            out = out.set_column(out.schema.get_field_index(c), c, segments.column(y[:, i]))
        at = out.schema.get_field_index("_sample")
        return out.set_column(at, "_sample", pa.array(np.concatenate(renumbered), out.schema.field(at).type))

    signal = segments.over(x.signal, "_sample", _with_doubles(x, names), run)
    events = x.events.withColumns({c: F.ceil(F.col(c) / q).cast("int") for c in ("_initial", "_final")})
    return x._with(signal=signal, events=events, rate=x.rate / q)
