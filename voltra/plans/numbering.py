"""Numbers over whole tables without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbouring ids that are summed in one group before sums of groups are.
SPAN = 4096


def before(sizes: DataFrame, key: str, n: Column | str, name: str) -> DataFrame:
    """``sizes`` (one row for each long ``key``) with ``name``: the sum of ``n`` over all smaller keys.

    Sums run inside groups of SPAN neighbouring keys, and over the groups; only the latter meet in one task.
    """
    n = F.col(n) if isinstance(n, str) else n
    wide = sizes.withColumns({"_g": F.floor(F.col(key) / SPAN), "_w": n})
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = wide.groupBy("_g").agg(F.sum("_w").alias("_w")).select("_g", F.coalesce(F.sum("_w").over(up_to(Window.orderBy("_g"))), F.lit(0)).alias("_top"))
    inside = F.coalesce(F.sum("_w").over(up_to(Window.partitionBy("_g").orderBy(key))), F.lit(0))
    return wide.withColumn("_in", inside).join(tops, "_g").withColumn(name, F.col("_top") + F.col("_in")).drop("_g", "_w", "_top", "_in")


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: their place (from 1) by ``key`` and then ``order``."""
    starts = before(rows.groupBy(key).agg(F.count("*").alias("_n")), key, "_n", "_before").select(F.col(key).alias("_key"), "_before")
    within = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return within.join(starts, within[key].eqNullSafe(starts["_key"])).withColumn(name, (F.col("_before") + F.col("_nth")).cast("long")).drop("_key", "_before", "_nth")
