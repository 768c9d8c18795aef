"""Interval joins by bucket: an equi-join on (key, bucket) that no single long key degrades to all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of intervals, one for each bucket they touch, that may be broadcast; they are counted first (a job of its own).
BROADCAST_ROWS = 100_000


def within(points: DataFrame, at: str, spans: DataFrame, low: str, high: str, keys: list[str], width: int = 512, how: str = "inner") -> DataFrame:
    """Rows of ``points`` joined to the ``spans`` with equal ``keys`` whose [low, high] holds ``at``."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    for k in keys:
        s = s.withColumnRenamed(k, f"_k_{k}")
    s = s.withColumnRenamed("_b", "_kb")
    rows = F.floor(F.col(high) / width) - F.floor(F.col(low) / width) + 1
    if (spans.agg(F.sum(rows)).first()[0] or 0) <= BROADCAST_ROWS:  # what the explosion makes, not what it is made from
        s = F.broadcast(s)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_b") == F.col("_kb"), F.col(at).between(F.col(low), F.col(high))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return p.join(s, cond, how).drop("_b", "_kb", *[f"_k_{k}" for k in keys])
