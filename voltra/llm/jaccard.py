"""N-gram Jaccard join by chosen paths.

Each text is the set of its word 5-grams. Texts with equal sets are collapsed first. The rest is split on sampled
shared tokens (the minimum of the set under a sampled hash is a token that two sets share with probability J):
every run starts a tree with one such token, a bucket larger than ``BUCKET`` is split again on further sampled
tokens, and small buckets are compared by brute force on signatures, keeping only a spanning forest of likely
links. Runs repeat until a pair at the threshold is missed with less than the target probability; later runs drop
buckets whose texts are connected already. Likely groups are then verified exactly on whole sets, in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _textvec as tv
from ._shared import by_bytes, stash, string_bytes

GRAM_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
SIGNATURE = 64
BUCKET = 2048
#: Sampled tokens a large bucket is split on, and how often.
BRANCHES, DEPTH = 3, 2
#: Tokens and texts of one verification block; larger groups are verified in pairs of blocks.
BLOCK_TOKENS, BLOCK_TEXTS = 1_000_000, 2500

_SEEDS = (np.random.RandomState(7).randint(1, 2**62, SIGNATURE).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct token hashes, bounds) of each text; a text of fewer than k words is one token, of none none."""
    raw, off = string_bytes(texts)
    h, _, _, row = tv.words(raw, off)
    n = len(texts)
    g, ok = tv.grams(h, row, k)
    count = np.bincount(row, minlength=n)
    first = tv.row_bounds(row, n)
    short = np.flatnonzero((count > 0) & (count < k))
    extra_h, extra_r = [], []
    for r in short.tolist():
        part = h[first[r] : first[r + 1]]
        extra_h.append(tv.grams(part, np.zeros(len(part), np.int64), len(part))[0][0])
        extra_r.append(r)
    tokens = np.concatenate([g[ok], np.array(extra_h, np.uint64)])
    rows = np.concatenate([row[ok], np.array(extra_r, np.int64)])
    order = np.lexsort((tokens, rows))
    tokens, rows = tokens[order], rows[order]
    new = np.append(True, (tokens[1:] != tokens[:-1]) | (rows[1:] != rows[:-1]))[: len(tokens)]
    tokens, rows = tokens[new], rows[new]
    return tokens, tv.row_bounds(rows, n)


def _bucket_keys(run: int, values: np.ndarray) -> np.ndarray:
    return tv.mix(values.astype(np.uint64) + (np.uint64(run + 1) << np.uint64(48)))


def profiles(docs: DataFrame, k: int = GRAM_WORDS) -> DataFrame:
    """rid, doc_id, th (digest of the text), s1, s2 (digest of the set), size, sig (minimum of each sampled hash, 32 bits
    each) of every row. Row numbers hold for the stored table only."""

    def run(batches):
        with np.errstate(over="ignore"):
            for b in by_bytes(batches, limit=1 << 19):
                tokens, bounds = _sets(b.column(3), k)
                n = b.num_rows
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                sig = np.zeros((n, SIGNATURE), np.uint32)
                s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                if len(some):
                    at = bounds[some]
                    for i in range(SIGNATURE):
                        mixed = tokens * _SEEDS[i]
                        mixed ^= mixed >> np.uint64(29)
                        sig[some, i] = np.minimum.reduceat(((mixed * _SEEDS[-1 - i]) >> np.uint64(32)).astype(np.uint32), at)
                    s1[some] = np.add.reduceat(tv.mix(tokens), at)
                    s2[some] = np.add.reduceat(tv.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), at)
                flat = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (4 * SIGNATURE)), pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(size, pa.int32()), flat], names=schema.names)

    schema = T.StructType([T.StructField("rid", T.LongType()), docs.schema["doc_id"], *T._parse_datatype_string("th long, s1 long, s2 long, size int, sig binary").fields])
    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def components(edges: DataFrame, name: str) -> DataFrame:
    """rep, label: the smallest rep of each connected component, by hooking to the smallest neighbour and halving paths.

    Only nodes that have an edge are returned. Every step is written to the shared folder.
    """
    both = stash(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), name + "-edges")
    labels = stash(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "rep"), name)
    while True:
        near = both.join(labels.select(F.col("rep").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["rep"] == near["a"]).select("rep", "label", F.least("label", "near").alias("low"))
        # a root that some member can lower takes the lowest
        roots = hooked.groupBy("label").agg(F.min("low").alias("root"))
        moved = hooked.join(roots, "label").select("rep", F.col("label").alias("old"), F.least("low", "root").alias("label"))
        step = stash(moved, name)
        up = step.select(F.col("rep").alias("label"), F.col("label").alias("above"))
        short = step.join(up, "label", "left").select("rep", "old", F.coalesce("above", "label").alias("label"))
        short = stash(short, name)
        if not short.filter("old <> label").head(1):
            return short.select("rep", "label")
        labels = short.select("rep", "label")


def _forest(sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the likely links (at least ``least`` equal entries) of a bucket."""
    left, edges = np.arange(1, len(sig)), []
    front = [0]
    while True:
        while front and len(left):
            i = front.pop()
            near = (sig[left] == sig[i]).sum(1) >= least
            edges += [(i, int(j)) for j in left[near]]
            front += left[near].tolist()
            left = left[~near]
        if not len(left):
            return edges
        front, left = [int(left[0])], left[1:]


def _likely(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b: likely links inside the buckets of rows (bucket, rep, sig), oversized ones in pairs of blocks."""
    least = math.ceil(SIGNATURE * max(0.1, threshold - 5 * math.sqrt(threshold * (1 - threshold) / SIGNATURE)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), -1)
        rep = pdf["rep"].to_numpy()
        e = np.array(_forest(sig, least), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": rep[e[:, 0]], "b": rep[e[:, 1]]})

    return rows.groupBy("bucket", "x", "y").applyInPandas(compare, "a long, b long")


def _split(spark, tree: DataFrame, sigs: DataFrame, threshold: float, labels: DataFrame | None) -> DataFrame:
    """Likely links of the buckets of ``tree`` (bucket long, rep long); large ones are split first."""
    leaves = []
    for depth in range(DEPTH + 1):
        sizes = tree.groupBy("bucket").agg(F.count("*").alias("m"))
        if labels is not None:
            known = tree.join(labels, "rep", "left").withColumn("l", F.coalesce("label", "rep"))
            sizes = known.groupBy("bucket").agg(F.count("*").alias("m"), F.min("l").alias("lo"), F.max("l").alias("hi")).filter("lo < hi")
        sizes = stash(sizes.filter("m > 1").select("bucket", "m"), "sizes")
        live = tree.join(sizes, "bucket")
        last = depth == DEPTH
        leaf = live if last else live.filter(F.col("m") <= BUCKET)
        leaves.append(leaf.select("bucket", "rep", "m"))
        if last or not sizes.filter(F.col("m") > BUCKET).head(1):
            break
        big = live.filter(F.col("m") > BUCKET).join(sigs.select("rep", "sig"), "rep")
        at = lambda i, d=depth: F.pmod(F.xxhash64("bucket", F.lit(i), F.lit(d)), F.lit(SIGNATURE)).cast("int")
        tree = stash(big.select("rep", F.explode(F.array(*[F.xxhash64("bucket", F.lit(i), F.substring(F.col("sig"), at(i) * 4 + 1, F.lit(4))) for i in range(BRANCHES)])).alias("bucket")), "tree")
    rows = leaves[0]
    for x in leaves[1:]:
        rows = rows.union(x)
    blocks = F.ceil(F.col("m") / F.lit(2 * BUCKET)).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("bucket", "rep", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    return _likely(rows.join(sigs.select("rep", "sig"), "rep"), threshold)


def _tree(owner: np.ndarray, code: np.ndarray, n: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the exact links of sets given as (owner, code) of their elements, sorted by owner.

    Each set reached is compared with those that are not yet, so sets that all link cost one comparison each.
    """
    m, bounds = len(n), np.searchsorted(owner, np.arange(len(n) + 1))
    size, edges = n.astype(float), []
    left, rest_owner, rest_code = np.ones(m, bool), owner, code
    mark = np.zeros(int(code.max(initial=-1)) + 1, bool)
    for start in range(m):
        front = [start] if left[start] else []
        left[start] = False
        while front and left.any():
            i = front.pop()
            mine = code[bounds[i] : bounds[i + 1]]
            mark[mine] = True
            common = np.bincount(rest_owner[mark[rest_code]], minlength=m)
            mark[mine] = False
            near = np.flatnonzero(left & (common > 0) & (common >= threshold * (size + size[i] - common) - 1e-6 * common))
            if len(near):
                left[near] = False
                edges += [(i, int(j)) for j in near]
                front += near.tolist()
                stay = left[rest_owner]
                rest_owner, rest_code = rest_owner[stay], rest_code[stay]
    return edges


def _verify(texts: DataFrame, k: int, threshold: float, count: bool = True) -> DataFrame:
    """kind, a, b of texts (grp, rep, weight, text): exact links on whole sets.

    kind 0: a has b further rows linked to it (only with ``count``, which compares every pair of a group); kind 1: a and
    b are linked (a spanning forest of each block).
    """

    def to_sets(batches):
        for b in by_bytes(batches):
            tokens, bounds = _sets(b.column(3), k)
            data = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(bounds.astype(np.int64) * 8), pa.py_buffer(tokens.tobytes())])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(bounds), pa.int64()), data.cast(pa.binary())], names=["grp", "rep", "weight", "n", "tokens"])

    sets = stash(texts.select("grp", "rep", "weight", "text").mapInArrow(to_sets, "grp long, rep long, weight long, n long, tokens binary"), "sets")
    blocks = sets.groupBy("grp").agg(F.ceil(F.greatest(F.sum("n") / F.lit(BLOCK_TOKENS), F.count("*") / F.lit(BLOCK_TEXTS))).cast("int").alias("blocks"))
    rows = sets.join(blocks, "grp").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).select("grp", "x", "y", "own", "rep", "weight", "n", "tokens")

    def exact(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        rep, weight, n = (pdf[c].to_numpy(np.int64) for c in ("rep", "weight", "n"))
        side = pdf["own"].to_numpy() == key[1]
        across = key[1] != key[2]
        tokens = np.frombuffer(b"".join(pdf["tokens"]), np.uint64)
        owner = np.repeat(np.arange(len(n)), n)
        _, code, times = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = times[code] > 1
        owner, code = owner[shared], code[shared]
        cols, code = np.unique(code, return_inverse=True)
        m = len(n)
        if not count:
            edges = np.array(_tree(owner, code, n, threshold), np.int64).reshape(-1, 2)
            return pd.DataFrame({"kind": np.ones(len(edges), np.int32), "a": rep[edges[:, 0]], "b": rep[edges[:, 1]]})
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        step = max(1, (1 << 23) // m)
        common = np.zeros((m, m), np.float32)
        for c in range(0, len(cols), step):
            lo, hi = np.searchsorted(code, [c, c + step])
            dense = np.zeros((m, min(step, len(cols) - c)), np.float32)
            dense[owner[lo:hi], code[lo:hi] - c] = 1
            common += dense @ dense.T
        links = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-6 * common
        np.fill_diagonal(links, False)
        if across:
            links &= side[:, None] != side[None, :]
        more = links @ weight
        a, b = [rep[more > 0]], [more[more > 0]]
        kinds = [np.zeros(len(a[0]), np.int32)]
        ea, eb = [], []
        seen = np.zeros(m, bool)
        for start in range(m):
            front = [] if seen[start] else [start]
            seen[start] = True
            while front:
                i = front.pop()
                for j in np.flatnonzero(links[i] & ~seen).tolist():
                    seen[j] = True
                    ea.append(rep[i])
                    eb.append(rep[j])
                    front.append(j)
        out = [np.append(kinds[0], np.ones(len(ea), np.int32)), np.append(a[0], ea), np.append(b[0], eb)]
        return pd.DataFrame({"kind": out[0].astype(np.int32), "a": out[1].astype(np.int64), "b": out[2].astype(np.int64)})

    return rows.groupBy("grp", "x", "y").applyInPandas(exact, "kind int, a long, b long")


def _classes(docs: DataFrame, k: int, threshold: float, recall: float, count: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): a stored row rid, doc_id, th, s1, s2, size for each of ``docs``, and rep, low, weight, label, more of
    each distinct set.

    Every row has a number of its own (rid) and a set is named by the least of its rows (rep), so neither repeated nor
    null ids of documents can stand for several texts. ``low`` is the smallest doc_id with the set, ``more`` the rows of
    other sets linked to it (null without ``count``), ``label`` the rep that names its component.
    """
    spark = docs.sparkSession
    base = stash(profiles(docs, k), "profiles")
    runs = max(2, math.ceil(math.log(1 - recall) / math.log(1 - threshold)) + 1)
    some = base.filter("size > 0")
    copies = stash(some.groupBy("s1", "s2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("low"), F.count("*").alias("weight")), "copies")
    sigs = stash(base.join(copies.select(F.col("rep").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("rep"), "doc_id", "th", "sig"), "sigs")

    def roots(which: range) -> DataFrame:
        keys = F.array(*[F.xxhash64(F.lit(r), F.substring(F.col("sig"), 4 * r + 1, 4)) for r in which])
        return sigs.select("rep", F.explode(keys).alias("bucket"))

    found = stash(_split(spark, roots(range(1)), sigs, threshold, None), "likely")
    labels = components(found, "labels")
    more = stash(_split(spark, roots(range(1, runs)), sigs, threshold, labels), "likely")
    labels = components(found.union(more), "labels")
    # groups of likely links, verified exactly; the text of a set is that of its rep, found by id and digest
    members = labels.select("rep", F.col("label").alias("grp")).join(sigs.select("rep", "doc_id", "th"), "rep").join(copies.select("rep", "weight"), "rep")
    text = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_th"), F.coalesce("text", F.lit("")).alias("text"))
    texts = text.join(members, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_th") == F.col("th"))).select("grp", "rep", "weight", "text").dropDuplicates(["rep"])
    checked = stash(_verify(texts, k, threshold, count), "checked")
    linked = checked.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("more"))
    classes = components(checked.filter("kind = 1").select("a", "b"), "classes")
    sets = copies.join(linked, "rep", "left").join(classes, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    return base, stash(sets, "distinct-sets")


def join(docs: DataFrame, k: int = GRAM_WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links of every row of ``docs``.

    A link is a pair of rows whose k-gram sets have a Jaccard similarity of at least ``threshold``; classes are the
    connected components of the links and named by their smallest doc_id (null where all its ids are); n_links counts
    the other rows linked to this one. Texts without a word (null, empty, only signs) have no set and no link. A text of
    fewer than k words is one gram. Links are between rows: a doc_id that several texts share, or none, joins nothing.
    """
    base, sets = _classes(docs, k, threshold, recall)
    named = sets.groupBy("label").agg(F.min("low").alias("class_id"))
    # only sets with links or copies have something to say, so the hot join is against few rows
    told = sets.filter("weight > 1 or more is not null").join(named, "label").select("s1", "s2", "class_id", "weight", "more")
    out = base.select("doc_id", "s1", "s2", "size").join(told, ["s1", "s2"], "left")
    known = (F.col("size") > 0) & F.col("weight").isNotNull()
    return out.select("doc_id", F.when(known, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(known, F.col("weight") - 1 + F.coalesce("more", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, k: int = GRAM_WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each class, of the smallest doc_id (null last), then the smallest digest of its text; columns as they are.

    Of rows equal in both, one stays. Texts without words are in no class and all stay. ``docs`` must give the same rows
    each time it is read.
    """
    base, sets = _classes(docs, k, threshold, recall, count=False)
    met = sets.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("m"))
    several = sets.join(met, F.col("label") == F.col("l")).filter("weight > 1 or m > 1").select("s1", "s2", "label")
    seen = base.filter("size > 0").join(several, ["s1", "s2"]).groupBy("label", "doc_id", "th").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = seen.groupBy(F.col("label").alias("l")).agg(F.min(order).alias("f"))
    # rows that go (kept false), and those of which one of n equal ones stays
    marks = stash(seen.join(first, F.col("label") == F.col("l")).select("doc_id", "th", "n", order.eqNullSafe(F.col("f")).alias("kept")).filter("not kept or n > 1"), "marks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumns({"id": F.col("row.doc_id"), "th": F.xxhash64("row.text")})
    key = marks.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "kept").hint("merge")
    same = F.col("id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
    out = rows.join(key, same, "left_anti").select("row.*")
    if marks.filter("kept").head(1):  # a second pass over the rows only where some are repeated
        out = out.union(rows.join(key.filter("kept"), same, "left_semi").dropDuplicates(["id", "th"]).select("row.*"))
    return out
