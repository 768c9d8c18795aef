"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature after the other with a small step, on the bins of each feature;
what they add up to is one lookup table per feature. The strongest pairs of features then get tables of their own
on the remaining error. A text is scored by binning its features and adding table cells, whole batches at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _textvec as tv
from ._shared import by_bytes, stash, string_bytes, unused

#: Features of a text; all come from its characters alone.
FEATURES = ("log_words", "word_bytes", "word_bytes_sd", "short_words", "long_words", "distinct", "top_word", "repeats", "symbols", "bars", "stops", "digits", "capitals", "spaces", "line_words", "non_ascii")
#: Labelled rows the fit uses at most (those whose hashed id is smallest); everything else covers all rows.
MAX_LABELLED = 20_000
THRESHOLD = 0.3

_KIND = np.zeros(256, np.int64)  # 0 other word bytes, 1 symbols, 2 bars, 3 stops, 4 digits, 5 capitals, 6 spaces, 7 line ends
_KIND[[ord(c) for c in "#$%&*@^~<>{}[]()\\/=+_`\"'-"]] = 1
_KIND[ord("|")] = 2
_KIND[[ord(c) for c in ".,;:!?"]] = 3
_KIND[48:58] = 4
_KIND[65:91] = 5
_KIND[[32, 9, 13]] = 6
_KIND[10] = 7


def features(text: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each (non-null) text; an empty text has zeros."""
    raw, off = string_bytes(text)
    n = len(text)
    size = np.diff(off).astype(float)
    of = np.repeat(np.arange(n) * 8, np.diff(off))
    kinds = np.bincount(of + _KIND[raw], minlength=8 * n).reshape(n, 8).astype(float)
    high = np.bincount((of >> 3)[raw >= 192], minlength=n).astype(float)
    h, s, e, row = tv.words(raw, off)
    count = np.bincount(row, minlength=n).astype(float)
    length = (e - s).astype(float)
    total = np.bincount(row, length, n)
    square = np.bincount(row, length * length, n)
    some = np.maximum(count, 1)
    mean = total / some
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    owner = (key[first] >> np.uint64(40)).astype(np.int64)
    times = np.diff(np.append(first, len(key)))
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    again = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n) if len(h) else np.zeros(n)
    chars = np.maximum(size, 1)
    return np.column_stack([
        np.log1p(count), mean, np.sqrt(np.maximum(square / some - mean * mean, 0)),
        np.bincount(row[length <= 2], minlength=n) / some, np.bincount(row[length >= 12], minlength=n) / some,
        np.bincount(owner, minlength=n) / some, top / some, again / some,
        kinds[:, 1] / chars, kinds[:, 2] / chars, kinds[:, 3] / chars, kinds[:, 4] / chars, kinds[:, 5] / chars, kinds[:, 6] / chars,
        np.log1p(count / (kinds[:, 7] + 1)), high / chars,
    ])


@dataclass
class AdditiveModel:
    """Lookup tables over binned features, and over pairs of coarser bins."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, table in self.pairs:
            z += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _shallow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values of a depth-2 tree over one feature's bins."""
    cuts = {0, len(g)}
    gain, at = _best_cut(g, h)
    if gain > 0:
        cuts.add(at)
        for lo, hi in ((0, at), (at, len(g))):
            inner, x = _best_cut(g[lo:hi], h[lo:hi])
            if inner > 0:
                cuts.add(lo + x)
    out = np.zeros(len(g))
    marks = sorted(cuts)
    for lo, hi in zip(marks[:-1], marks[1:], strict=True):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The same over two features: a cut of one, then a cut of the other on either side."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        for at in range(1, gg.shape[0]):
            value, out = 0.0, np.zeros_like(gg)
            for rows in (slice(0, at), slice(at, None)):
                gs, hs = gg[rows].sum(0), hh[rows].sum(0)
                _, cut = _best_cut(gs, hs)
                for cols in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
                    a, b = gs[cols].sum(), hs[cols].sum() + 1
                    value += a * a / b
                    out[rows, cols] = a / b
            if value > best[0]:
                best = (value, out.T if turn else out)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, step: float = 0.15, bins: int = 32, n_pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40) -> AdditiveModel:
    """Cyclic boosting of ``y`` (0/1) on the columns of ``x``. Without rows: a constant 0.5; with one class: near it."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(rate / (1 - rate))))
    if not 0 < y.sum() < len(y):
        return model
    k = x.shape[1]
    model.edges = [_edges(x[:, j], bins) for j in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    code = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j in range(k):
            p = 1 / (1 + np.exp(-z))
            size = len(model.tables[j])
            leaf = step * _shallow(np.bincount(code[j], y - p, size), np.bincount(code[j], p * (1 - p), size))
            model.tables[j] += leaf
            z += leaf[code[j]]
    model.coarse = [_edges(x[:, j], pair_bins) for j in range(k)]
    small = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    shape = lambda a, b: (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)

    def sums(a, b):
        p = 1 / (1 + np.exp(-z))
        s = shape(a, b)
        cell = small[a] * s[1] + small[b]
        return cell, np.bincount(cell, y - p, s[0] * s[1]).reshape(s), np.bincount(cell, p * (1 - p), s[0] * s[1]).reshape(s)

    ranked = sorted(((_shallow_pair(*sums(a, b)[1:])[0], a, b) for a in range(k) for b in range(a + 1, k)), reverse=True)[:n_pairs]
    model.pairs = [(a, b, np.zeros(shape(a, b))) for _, a, b in ranked]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            cell, g, h = sums(a, b)
            leaf = step * _shallow_pair(g, h)[1]
            table += leaf
            z += leaf.ravel()[cell]
    return model


def held_out(doc_id):
    """Rows kept out of every fit: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and ``FEATURES`` (one array) of every row; null texts count as empty."""

    def run(batches):
        for b in by_bytes(batches):
            x = features(b.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["doc_id", "x"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def train(table: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> AdditiveModel:
    """Fit on a stored ``feature_table``; rows without a label, null labels and held-out rows take no part.

    A document labelled more than once counts once, as 1 only if all its labels are 1.
    """
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("y"))
    n = marks.count()
    if n > 2 * max_labelled:  # so that tasks send the driver a small multiple of the bound, however many labels there are
        marks = marks.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < (1 << 30) * 2 * max_labelled // n)
    rows = table.join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_labelled).collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([float(r["y"] > 0) for r in rows]))


def scored(table: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score of a stored feature table."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, len(FEATURES))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    return table.select("doc_id", "x").mapInArrow(run, T.StructType([table.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``: null ids are not held out, null texts score as empty ones,
    texts of any length by all of their words; other columns are not looked at, and an empty table gives no rows."""
    table = stash(feature_table(docs), "features")
    out = scored(table, train(table, labels, max_labelled))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, columns as they are, of any name; their texts are not shuffled.

    Null texts score as empty ones, very long ones by all of their words; repeated rows stay or go together.
    """
    table = stash(feature_table(docs), "features")
    shared = docs.sparkSession.sparkContext.broadcast(train(table, labels, max_labelled))
    names, (whole,) = docs.columns, unused(docs, "whole")

    def run(batches):
        for b in by_bytes(batches, whole):
            keep = shared.value.score(features(b.column(len(names)))) >= threshold
            yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names=names).filter(pa.array(keep))

    return docs.withColumn(whole, F.coalesce("text", F.lit(""))).mapInArrow(run, docs.schema)
