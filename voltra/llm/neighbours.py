"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised by codebooks of their own; a cell is a pair of centroids. A query walks the
pairs in the order of their summed nearness with a heap until the cells hold its budget of rows; those rows are
reranked with the exact measure. The budget is measured: the share of rows that a bounded sample of queries needs to
find ``target`` of the neighbours that brute force finds.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stash

TOP = 20
CENTROIDS = 64
#: Vectors the codebooks are fitted on, and queries the budget is measured on, at most (smallest hashed ids).
FIT_ROWS, SAMPLE_QUERIES = 10_000, 64
TARGET = 0.96
#: Rows of the index and queries that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id long, v binary (float32 or float64 components as doubles): rows that can take part.

    Null ids, null, empty or zero vectors and those with null or non-finite components are left out, and so are
    vectors of another length than ``dim`` (unset: the most frequent one, the longer on a tie).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull())
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("e", lambda x: x != 0))
    if dim is None:
        sizes = rows.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
        dim = sizes[0]["d"] if sizes else 0
    return rows.filter(F.size("e") == dim)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _packed(m: np.ndarray) -> pa.Array:
    w = m.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * w), pa.py_buffer(np.ascontiguousarray(m).tobytes())])


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[np.random.RandomState(11).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), 1)
        n = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            s = np.bincount(near, x[:, j], k)
            c[n > 0, j] = s[n > 0] / n[n > 0]
    return c


class Index:
    """Codebooks of the halves, rows in each cell, and the blocks the cells are dealt to."""

    def __init__(self, sample: np.ndarray):
        self.half = sample.shape[1] // 2
        self.c1, self.c2 = _kmeans(sample[:, : self.half], CENTROIDS), _kmeans(sample[:, self.half :], CENTROIDS)
        self.counts = np.zeros(len(self.c1) * len(self.c2), np.int64)
        self.budget = 0

    def cells(self, x: np.ndarray) -> np.ndarray:
        one = lambda a, c: np.argmax(a @ c.T - 0.5 * (c * c).sum(1), 1)
        return one(x[:, : self.half], self.c1) * len(self.c2) + one(x[:, self.half :], self.c2)

    def nearness(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return q[:, : self.half] @ self.c1.T, q[:, self.half :] @ self.c2.T

    def deal(self) -> None:
        """Blocks of whole neighbouring cells; a cell larger than a block gets several of its own."""
        self.block, self.parts, held, b = np.zeros(len(self.counts), np.int64), np.ones(len(self.counts), np.int64), 0, 0
        for c in np.flatnonzero(self.counts).tolist():
            n = int(self.counts[c])
            if held and held + n > BLOCK_ROWS:
                b, held = b + 1, 0
            self.block[c], self.parts[c] = b, -(-n // BLOCK_ROWS)
            held += n
            if self.parts[c] > 1:
                b, held = b + int(self.parts[c]), 0
        self.blocks = b + 1

    def reach(self, s1: np.ndarray, s2: np.ndarray) -> float:
        """Nearness of the last cell a query visits: pairs by falling sum, until their rows fill the budget."""
        o1, o2 = np.argsort(-s1, kind="stable").tolist(), np.argsort(-s2, kind="stable").tolist()
        a, b, k2 = s1[o1].tolist(), s2[o2].tolist(), len(s2)
        counts, total, last = self.listed, 0, 0.0
        heap, top = [(-(a[0] + b[0]), 0, 0)], self.budget
        while heap and total < top:
            near, i, j = heapq.heappop(heap)
            last = -near
            total += counts[o1[i] * k2 + o2[j]]
            if j + 1 < k2:
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
        return last if total >= top and heap else -np.inf


def _best(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, top: int, mask=None):
    """(query row, vector row, score) of each query's nearest: exact scores, ties to the smaller id."""
    near = q @ v.T
    near[qid[:, None] == vid[None, :]] = -np.inf
    if mask is not None:
        near[~mask] = -np.inf
    out = []
    for i in range(len(q)):
        row = near[i]
        if len(row) > top:
            least = np.partition(row, len(row) - top)[len(row) - top]
            at = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least))) if np.isfinite(least) else np.flatnonzero(np.isfinite(row))
        else:
            at = np.flatnonzero(np.isfinite(row))
        score = (v[at] * q[i]).sum(1)
        order = np.lexsort((vid[at], -score))[:top]
        out.append((np.full(len(order), i), at[order], score[order]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _without_idle_copies(ids: np.ndarray, m: np.ndarray, top: int) -> np.ndarray:
    """Rows kept of a batch: of equal vectors only the top+1 smallest ids can be in any answer; repeated rows count once."""
    _, same = np.unique(m.view([("", m.dtype)] * m.shape[1]).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    new = np.append(True, (s[1:] != s[:-1]) | (i[1:] != i[:-1]))
    order, s = order[new], s[new]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return np.sort(order[nth <= top])


def search(vectors: DataFrame, every: int = 20, top: int = TOP, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row whose vec_id is divisible by ``every``.

    Nearness is the inner product in double precision; ties go to the smaller vec_id. Rows with the query's own id
    take no part in its answer; a query id that has several vectors is answered for its smallest vector. Tables with
    no usable row give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    sample, n = rows, rows.count()
    if n > 2 * FIT_ROWS:  # so that all tasks together send about twice the bound, however many rows there are
        sample = rows.filter(F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 30)) < (1 << 30) * 2 * FIT_ROWS // n)
    sample = np.array([r["e"] for r in sample.orderBy(F.xxhash64("vec_id"), "vec_id", "e").limit(FIT_ROWS).collect()])
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Index(sample)
    shared = spark.sparkContext.broadcast(index)

    def locate(batches):
        for b in batches:
            if b.num_rows:
                m, ids = _matrix(b.column(1)), b.column(0).to_numpy()
                keep = _without_idle_copies(ids, m, top)
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.cells(m[keep])), pa.array(ids[keep]), _packed(m[keep])], names=["cell", "vec_id", "v"])

    cells = stash(rows.mapInArrow(locate, "cell long, vec_id long, v binary"), "cells")
    for c, n in cells.groupBy("cell").agg(F.count("*")).collect():  # at most CENTROIDS ** 2 rows
        index.counts[c] = n
    index.listed = index.counts.tolist()
    index.deal()
    queries = stash(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("e").alias("e")), "queries")
    n_queries = queries.count()
    index.budget = _measured(cells, index, queries, top, target)
    full = spark.sparkContext.broadcast(index)
    tasks = min(-(-n_queries // 128) or 1, 4 * spark.sparkContext.defaultParallelism)

    def walk(batches):
        x = full.value
        c1, c2 = np.divmod(np.arange(len(x.counts)), len(x.c2))
        for b in batches:
            if not b.num_rows:
                continue
            ids, q = b.column(0).to_numpy(), _matrix(b.column(1))
            s1, s2 = x.nearness(q)
            out: list[tuple] = []
            for i in range(len(q)):
                reach = x.reach(s1[i], s2[i])
                seen = np.flatnonzero((s1[i][c1] + s2[i][c2] >= reach - 1e-12) & (x.counts > 0))
                blocks = np.unique(np.concatenate([np.arange(x.block[c], x.block[c] + x.parts[c]) for c in seen[x.parts[seen] > 1]] + [x.block[seen]]))
                out += [(int(k), int(ids[i]), reach, q[i].tobytes()) for k in blocks]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.binary()), strict=True)], names=["block", "query_id", "reach", "q"])

    def to_block(batches):
        x = full.value
        for b in batches:
            cell, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % x.parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(x.block[cell] + part), *b.columns], names=["block", "cell", "vec_id", "v"])

    def rerank(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        x = full.value
        left = left.drop_duplicates(["vec_id", "v"])
        v = np.frombuffer(b"".join(left["v"])).reshape(len(left), -1)
        vid, cell = left["vec_id"].to_numpy(), left["cell"].to_numpy()
        got = []
        for at in range(0, len(right), 512):
            part = right.iloc[at : at + 512]
            q = np.frombuffer(b"".join(part["q"])).reshape(len(part), -1)
            s1, s2 = x.nearness(q)
            mask = s1[:, cell // len(x.c2)] + s2[:, cell % len(x.c2)] >= part["reach"].to_numpy()[:, None] - 1e-12
            qid = part["query_id"].to_numpy()
            i, j, s = _best(q, qid, v, vid, top, mask)
            got.append(pd.DataFrame({"query_id": qid[i], "vec_id": vid[j], "score": s}))
        return pd.concat(got)

    asked = stash(queries.repartition(tasks).mapInArrow(walk, "block long, query_id long, reach double, q binary"), "asked")
    # a block goes to as many tasks as the queries that asked for it fill, and to none that nobody asked for
    chunks = asked.groupBy("block").agg(F.ceil(F.count("*") / F.lit(BLOCK_QUERIES)).alias("chunks"))
    asked = asked.join(chunks, "block").select("block", F.pmod(F.xxhash64("query_id"), "chunks").alias("chunk"), "query_id", "reach", "q")
    held = cells.mapInArrow(to_block, "block long, cell long, vec_id long, v binary").join(chunks, "block").select("block", "cell", "vec_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    found = held.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _measured(cells: DataFrame, index: Index, queries: DataFrame, top: int, target: float) -> int:
    """Rows a query has to see: brute force on a sample of queries, and where their neighbours' cells come in the walk."""
    picked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).collect()
    if not picked:
        return 0
    qid, q = np.array([r["vec_id"] for r in picked]), np.array([r["e"] for r in picked])
    shared = cells.sparkSession.sparkContext.broadcast((qid, q))

    def brute(batches):
        ids, m = shared.value
        best = pd.DataFrame({"i": np.zeros(0, np.int64), "cell": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        for b in batches:
            if b.num_rows:
                v = np.frombuffer(b"".join(b.column(2).to_pylist())).reshape(b.num_rows, -1)
                vid = b.column(1).to_numpy()
                i, j, s = _best(m, ids, v, vid, top)
                both = pd.concat([best, pd.DataFrame({"i": i, "cell": b.column(0).to_numpy()[j], "vec_id": vid[j], "score": s})])
                best = both.sort_values(["i", "score", "vec_id"], ascending=[True, False, True]).groupby("i").head(top)
        yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    near = cells.mapInArrow(brute, "i long, cell long, vec_id long, score double")
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "vec_id"))).filter(F.col("nth") <= top).collect()
    s1, s2 = index.nearness(q)
    need = []
    for r in near:
        score = (s1[r["i"]][:, None] + s2[r["i"]][None, :]).ravel()
        need.append(int(index.counts[score >= score[r["cell"]]].sum()))
    n = int(index.counts.sum())
    return max(min(n, 50 * top), int(np.quantile(need, target)) if need else n)
