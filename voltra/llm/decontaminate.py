"""Benchmark decontamination by winnowing.

Every window of ``t - k + 1`` consecutive k-gram hashes keeps its minimum (all tied positions), so any span of
``t`` words that a document and a benchmark item share has a fingerprint that both keep. Kept fingerprints are
hash-joined with those of the benchmark; each hit is extended word by word in both directions and counts if the
common run reaches ``t`` words. Items shorter than ``t`` words are one window and are looked up whole.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _textvec as tv
from ._shared import by_bytes, stash, string_bytes

WINDOW_WORDS = 8
GRAM_WORDS = 4
#: Bytes of benchmark text in one broadcast block; a larger benchmark goes in several blocks over the documents.
BLOCK_BYTES = 32 << 20


def winnowed(h: np.ndarray, row: np.ndarray, k: int, window: int) -> np.ndarray:
    """Mask of the k-gram positions kept: minima of ``window`` consecutive k-grams of one row, ties all kept."""
    g, ok = tv.grams(h, row, k)
    n = len(h)
    keep = np.zeros(n, bool)
    m = n - window + 1
    if m <= 0:
        return keep
    low = g[:m].copy()
    for i in range(1, window):
        np.minimum(low, g[i : i + m], out=low)
    full = ok[:m] & ok[window - 1 :] & (row[:m] == row[window - 1 :])
    for i in range(window):
        keep[i : i + m] |= full & (g[i : i + m] == low)
    return keep


class _Index:
    """Fingerprints of one benchmark block: sorted hashes with the item and word they came from."""

    def __init__(self, items: list[tuple], t: int, k: int):
        self.ids = [i for i, _ in items]
        arr = pa.array([x for _, x in items], pa.string())
        h, _, _, row = tv.words(*string_bytes(arr))
        self.h, self.t, self.k = h, t, k
        self.first = tv.row_bounds(row, len(items))
        size = np.diff(self.first)
        g, _ = tv.grams(h, row, k)
        at = np.flatnonzero(winnowed(h, row, k, t - k + 1))
        at = at[np.argsort(g[at], kind="stable")]
        self.at, self.row_of, self.key = at, row[at] if len(at) else at, g[at]
        self.mask = np.zeros(1 << 16, bool)
        self.mask[(self.key >> np.uint64(48)).astype(np.int64)] = True
        self.short: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero((size > 0) & (size < t)).tolist():
            s, n = int(self.first[i]), int(size[i])
            whole, _ = tv.grams(h[s : s + n], np.zeros(n, np.int64), n)
            self.short.setdefault(n, {}).setdefault(int(whole[0]), []).append(i)

    def find(self, h: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, list[set]]:
        """Hit mask over the words, and per row the items (by index) of which a window occurs."""
        hit, found = np.zeros(len(h), bool), [set() for _ in range(n_rows)]
        if not len(h):
            return hit, found
        for n, table in self.short.items():
            g, ok = tv.grams(h, row, n)
            keys = np.fromiter(table, np.uint64, len(table))
            for p in np.flatnonzero(ok & np.isin(g, keys)).tolist():
                hit[p : p + n] = True
                found[row[p]].update(table[int(g[p])])
        if not len(self.key):
            return hit, found
        g, _ = tv.grams(h, row, self.k)
        at = np.flatnonzero(winnowed(h, row, self.k, self.t - self.k + 1) & self.mask[(g >> np.uint64(48)).astype(np.int64)])
        lo, hi = np.searchsorted(self.key, g[at], "left"), np.searchsorted(self.key, g[at], "right")
        bounds = tv.row_bounds(row, n_rows)
        done: dict[tuple[int, int], int] = {}
        for p, a, b in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
            r = int(row[p])
            for x in range(a, b):
                q, item = int(self.at[x]), int(self.row_of[x])
                if done.get((item, p - q), -1) > p:  # this diagonal's run is known already
                    continue
                start, stop = self._run(h, p, int(bounds[r]), int(bounds[r + 1]), q, int(self.first[item]), int(self.first[item + 1]))
                done[(item, p - q)] = stop
                if stop - start >= self.t:
                    hit[start:stop] = True
                    found[r].add(item)
        return hit, found

    def _run(self, h, p, p0, p1, q, q0, q1) -> tuple[int, int]:
        back, ahead = min(p - p0, q - q0), min(p1 - p, q1 - q)
        same = h[p : p + ahead] == self.h[q : q + ahead]
        stop = ahead if same.all() else int(np.argmin(same))
        same = h[p - back : p][::-1] == self.h[q - back : q][::-1]
        return p - (back if same.all() else int(np.argmin(same))), p + stop


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The stated query set in bounded blocks, streamed through the driver one partition at a time."""
    block, held = [], 0
    for r in benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().toLocalIterator():
        block.append((r["item_id"], r["text"]))
        held += len(r["text"].encode())
        if held > BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


HITS = "n_words long, spans array<struct<start:int,end:int>>, items array<string>, n_hit long"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _described(text: pa.Array, mark) -> list[pa.Array]:
    """The ``HITS`` columns of a batch; ``mark`` gives the hit mask over its words and the items of each row."""
    raw, off = string_bytes(text)
    h, s, e, row = tv.words(raw, off)
    n = len(text)
    bounds = tv.row_bounds(row, n)
    hit, items = mark(h, row, bounds)
    ends = np.concatenate([[0], np.cumsum(hit)])
    spans: list[list] = [[] for _ in range(n)]
    at = np.flatnonzero(hit)
    if len(at):
        first = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(row[at]) > 0)])
        for i, j in zip(at[first].tolist(), at[np.append(first[1:], True)].tolist(), strict=True):
            r = int(row[i])
            spans[r].append({"start": int(s[i] - off[r]), "end": int(e[j] - off[r])})
    return [pa.array(np.diff(bounds), pa.int64()), pa.array(spans, _SPAN), pa.array([sorted(f) for f in items], pa.list_(pa.string())), pa.array(ends[bounds[1:]] - ends[bounds[:-1]], pa.int64())]


def _pass(docs: DataFrame, block: list[tuple], t: int, k: int) -> DataFrame:
    """k1, k2 (digests of the text), items, at (words hit) of each text in which an item of the block occurs, written."""
    shared, token = docs.sparkSession.sparkContext.broadcast([x for x in block if x[0] is not None]), uuid.uuid4().hex

    def run(batches):
        index = _index(shared, token, t, k)
        ids = [str(i) for i in index.ids]
        for b in by_bytes(batches):
            h, _, _, row = tv.words(*string_bytes(b.column(2)))
            hit, found = index.find(h, row, b.num_rows)
            bounds = tv.row_bounds(row, b.num_rows)
            some = [r for r, f in enumerate(found) if f]
            items = pa.array([sorted({ids[i] for i in found[r]}) for r in some], pa.list_(pa.string()))
            at = pa.array([np.flatnonzero(hit[bounds[r] : bounds[r + 1]]).tolist() for r in some], pa.list_(pa.int32()))
            rows = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), items, at], names=["k1", "k2", "items", "at"])

    hits = docs.select(*_digests(), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "k1 long, k2 long, items array<string>, at array<int>")
    out = stash(hits.dropDuplicates(["k1", "k2"]), "hits")
    shared.unpersist()
    return out


def _digests() -> list:
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]


def overlaps(docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS, gram_words: int = GRAM_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: doc_id, n_words, hit spans (byte offsets into the UTF-8 text), item ids found, n_hit.

    ``carry`` names further columns that go through as they came, named ``c_<name>``. A null text has no words;
    items without words never occur; null item ids are ignored; repeated items count once; very long texts are scanned
    whole. A benchmark of one block is looked up as the documents are read. A larger one goes over them in a pass for
    each block: a pass writes the hits of its texts before the next block leaves the benchmark, so the driver and the
    workers hold two blocks at most, and the hits of all passes are joined to the documents by the digest of the text.
    """
    spark = docs.sparkSession
    carried = [T.StructField(f"c_{c}", docs.schema[c].dataType) for c in carry]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string(HITS).fields, *carried])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry])
    blocks = _blocks(benchmark)
    block, ahead = next(blocks, []), next(blocks, None)
    if ahead is None:
        shared, token = spark.sparkContext.broadcast([x for x in block if x[0] is not None]), uuid.uuid4().hex

        def scan(batches):
            index = _index(shared, token, window_words, gram_words)
            ids = [str(i) for i in index.ids]

            def mark(h, row, bounds):
                hit, found = index.find(h, row, len(bounds) - 1)
                return hit, [{ids[i] for i in f} for f in found]

            for b in by_bytes(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), *_described(b.column(1), mark), *b.columns[2:]], names=schema.names)

        return rows.mapInArrow(scan, schema)
    parts = []
    while block is not None:
        parts.append(_pass(docs, block, window_words, gram_words))
        block, ahead = ahead, next(blocks, None)
    hits = functools.reduce(DataFrame.union, parts).groupBy("k1", "k2").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("at")).alias("at"))
    joined = rows.withColumns({"_k1": F.xxhash64("text"), "_k2": F.xxhash64(F.lit(1), "text")}).join(hits.hint("merge"), (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left")

    def describe(batches):
        for b in by_bytes(batches):
            items, at = b.column(2), b.column(3)

            def mark(h, row, bounds, items=items, at=at):
                hit, found = np.zeros(len(h), bool), [set() for _ in range(len(bounds) - 1)]
                for r in np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    hit[bounds[r] + at[r].values.to_numpy()] = True
                    found[r] = set(items[r].as_py())
                return hit, found

            yield pa.RecordBatch.from_arrays([b.column(0), *_described(b.column(1), mark), *b.columns[4:]], names=schema.names)

    return joined.select("doc_id", "text", "items", "at", *[f"`c_{c}`" for c in carry]).mapInArrow(describe, schema)


_INDEXES: dict = {}


def _index(shared, token: str, t: int, k: int) -> _Index:
    if token not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[token] = _Index(shared.value, t, k)
    return _INDEXES[token]


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated (at least ``min_items`` items have an occurring window)."""
    return overlaps(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.size("items") >= min_items).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """``docs`` without contaminated rows; in the rest the words of any occurring window are cut out of the text.

    Columns and the order of columns stay; n_chars (if there) is counted again where the text changed.
    """
    hits = overlaps(docs, benchmark, carry=tuple(docs.columns)).filter(F.size("items") < min_items)
    data = F.encode("c_text", "UTF-8")
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["end"])
    stop = lambda i: F.when(i == F.size("spans"), F.octet_length("c_text")).otherwise(F.get("spans", i)["start"])
    kept = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.decode(F.substring(data, start(i) + 1, stop(i) - start(i)), "UTF-8"))
    changed = F.size("spans") > 0
    text = F.when(changed, F.array_join(kept, "")).otherwise(F.col("c_text"))
    out = {c: F.col(f"`c_{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("c_n_chars"))
    return hits.select(*[v.alias(c) for c, v in out.items()])
