"""Sharding by histogram sort: contiguous key ranges of near-equal bytes.

Splitters start as unknown points of the key range. Each round counts the exact bytes (and rows) below a grid of
candidate boundaries over all partitions and narrows every splitter to one grid cell, until it is exact or within
the tolerance. Only then are rows exchanged, once, by the cells found; positions follow from counts of the cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stash

SHARDS = 24
#: Candidate boundaries counted in one round; also bounds what a round returns to the driver.
PROBES = 8192
#: Cells a shard is cut into at most for the exchange, and the rows a cell should have.
CELLS, CELL_ROWS = 128, 20_000
ROW_BYTES = 8


def _below(rows: DataFrame, key: str, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe."""
    shared = rows.sparkSession.sparkContext.broadcast(probes)

    def count(batches):
        p = shared.value
        size, n = np.zeros(len(p) + 1, np.int64), np.zeros(len(p) + 1, np.int64)
        for b in batches:
            cell = np.searchsorted(p, b.column(0).to_numpy(), side="right")
            size += np.bincount(cell, b.column(1).to_numpy(), len(p) + 1).astype(np.int64)
            n += np.bincount(cell, minlength=len(p) + 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(size[at]), pa.array(n[at])], names=["cell", "size", "n"])

    got = rows.select(key, "size").mapInArrow(count, "cell long, size long, n long").groupBy("cell").agg(F.sum("size"), F.sum("n")).collect()
    size, n = np.zeros(len(probes), object), np.zeros(len(probes), object)
    for cell, s, c in got:
        if cell < len(probes):
            size[cell] += s
            n[cell] += c
    return np.cumsum(size), np.cumsum(n)


def splitters(rows: DataFrame, key: str, targets: list[int], tolerance: int = 0) -> list[tuple[int, int, int, int]]:
    """For each target t: the smallest key k with at least t bytes below it (within ``tolerance``), as
    (k, bytes below k, bytes below k-1, rows with key k-1)."""
    low, high, size, n = rows.agg(F.min(key), F.max(key), F.sum("size"), F.count("*")).first()
    state = [{"lo": low, "hi": high + 1, "blo": 0, "bhi": size, "nlo": 0, "nhi": n} for _ in targets]
    while open_ := [s for s, t in zip(state, targets, strict=True) if s["hi"] - s["lo"] > 1 and not (0 <= s["bhi"] - t <= tolerance and tolerance)]:
        each = max(3, PROBES // len(open_))
        grid: set[int] = set()
        for lo, hi in {(s["lo"], s["hi"]) for s in open_}:
            grid |= {lo + (hi - lo) * i // (each + 1) for i in range(1, each + 1)} - {lo, hi}
        probes = np.array(sorted(grid), np.int64)
        size_below, rows_below = _below(rows, key, probes)
        for s, t in zip(state, targets, strict=True):
            a, b = np.searchsorted(probes, [s["lo"] + 1, s["hi"]])
            for p, bb, nn in zip(probes[a:b].tolist(), size_below[a:b], rows_below[a:b], strict=True):
                if bb >= t:
                    s |= {"hi": p, "bhi": bb, "nhi": nn}
                    break
                s |= {"lo": p, "blo": bb, "nlo": nn}
    return [(s["hi"], s["bhi"], s["blo"], s["nhi"] - s["nlo"]) for s in state]


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row: shard s has the rows whose preceding bytes, in doc_id order,
    are at least s/shards of all bytes and less than (s+1)/shards.

    size is the UTF-8 bytes of the text (null: none) plus 8, however long it is. Groups are equal texts (equal
    text_crc32); the law is about bytes and tells nothing of them: a group goes where its ids go, one that holds a third
    of all rows over as many shards as its bytes fill, and every copy keeps a row of its own. Rows that share a doc_id are ordered by a hash of their
    text and a row number, so one hot id is split like any other range. Null ids come first. An empty table has no
    rows. With a ``tolerance`` (bytes), splitters may lie that much after their place.
    """
    rows = stash(
        docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).alias("text_crc32"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.shiftrightunsigned(F.xxhash64("text", F.monotonically_increasing_id()), 2).alias("tie")), "rows"
    )
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cells = int(min(CELLS, max(4, n // (shards * CELL_ROWS))))
    marks = [-(-total * i // (shards * cells)) for i in range(1, shards * cells)]
    found = splitters(rows, "key", marks, tolerance)
    cuts: list[tuple[int, int, int]] = []  # (key, tie or -1, cell that begins there)
    shared_keys: dict[int, list[tuple[int, int]]] = {}
    for i, (t, (k, below, before, same)) in enumerate(zip(marks, found, strict=True), 1):
        if below > t and same > 1:  # the place lies inside rows that share key k-1
            shared_keys.setdefault(k - 1, []).append((i, t - before))
        else:
            cuts.append((k, -1, i))
    for k, inside in shared_keys.items():
        for (i, _), (tie, *_rest) in zip(inside, splitters(rows.filter(F.col("key") == k), "tie", [t for _, t in inside]), strict=True):
            cuts.append((k, tie, i))
    cuts.sort()
    keys = np.array([c[0] for c in cuts], np.int64)
    ties = np.array([c[1] for c in cuts], np.int64)
    names = ["doc_id", "size", "text_crc32", "key", "tie"]
    places = rows.sparkSession.sparkContext.broadcast((keys, ties, cells))

    def assign(batches):
        keys, ties, cells = places.value
        hot = np.unique(keys[ties >= 0])
        for b in batches:
            key, tie = b.column(3).to_numpy(), b.column(4).to_numpy()
            cell = np.searchsorted(keys, key, side="right")
            for k in hot.tolist():
                own, lo, hi = key == k, *np.searchsorted(keys, [k, k + 1])
                cell[own] = lo + np.searchsorted(ties[lo:hi], tie[own], side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((cell // cells).astype(np.int32)), pa.array((cell % cells).astype(np.int32))], names=[*names, "shard", "cell"])

    kind = dict(rows.dtypes)
    placed = rows.select(*names).mapInArrow(assign, ", ".join(f"{c} {kind[c]}" for c in names) + ", shard int, cell int")
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    # at most shards * CELLS rows: a proven bound
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key", "tie", "text_crc32")))
    return ranked.join(F.broadcast(counts), ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"))
