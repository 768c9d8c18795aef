"""URL filters that know when a list entry held: a temporal list join, in DataFrame functions only.

Dated entries of a pattern become validity intervals (an entry holds until the next one of its pattern). Captures
are joined to the interval that holds at their fetch time by pattern and month, so a capture meets only the changes
of its own month, and a busy host is an ordinary skewed equi-join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the list (by month) that may be broadcast: they are counted first; larger lists are shuffled.
BROADCAST_ROWS = 20_000
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: Column) -> Column:
    """Lower-case host, null where the URL has none."""
    h = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(h != "", h)


def bare(url: Column) -> Column:
    """URL without scheme, query, fragment and final slash; the form url patterns have."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "/$", "")


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, action, since, until (null: still) of entries (kind, pattern, action, listed_on date).

    Entries with a null anywhere are ignored; of several on one day for one pattern, the last action by name holds.
    """
    whole = entries.select("kind", "pattern", "action", "listed_on").dropna()
    daily = whole.groupBy("kind", "pattern", "listed_on").agg(F.max("action").alias("action"))
    nxt = F.lead("listed_on").over(Window.partitionBy("kind", "pattern").orderBy("listed_on"))
    return daily.select("kind", "pattern", "action", F.col("listed_on").alias("since"), nxt.alias("until"))


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched_on, n_rows, verdict, pattern, since of each distinct capture.

    ``captures``: page_id, url, fetched_on date. Patterns: ``url`` (a bare URL), ``prefix`` (host and first path
    segment) and ``host`` (the host or any parent domain); the most specific that holds decides, the longer host
    first. Verdict is its action, or ``none``. Null or odd URLs and null dates match nothing. Repeated captures are
    one row with their number. URLs are taken whole, however long (one key for each label of the host). An entry makes a
    row for each month it holds up to the last capture, so very old dates make long lists, which are not broadcast. Other
    columns of either table are not looked at; empty tables give no rows, or no verdicts.
    """
    spans = intervals(entries)
    seen = captures.select("page_id", "url", "fetched_on").groupBy("page_id", "url", "fetched_on").agg(F.count("*").alias("n_rows"))
    name, path = host(F.col("url")), bare(F.col("url"))
    labels = F.split(name, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"), (F.size(labels) - i + 1).alias("rank")))
    others = F.array(F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", name, F.split_part(path, F.lit("/"), F.lit(2))).alias("pattern"), F.lit(1000).alias("rank")), F.struct(F.lit("url").alias("kind"), path.alias("pattern"), F.lit(2000).alias("rank")))
    tasks = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are light here and make several each
    asked = seen.repartition(tasks, "page_id", "url").filter("url is not null and fetched_on is not null").withColumn("_name", name).filter("_name is not null").select("page_id", "url", "fetched_on", F.explode(F.concat(parents, others)).alias("k"))
    asked = asked.select("page_id", "url", "fetched_on", "k.kind", "k.pattern", "k.rank", _month(F.col("fetched_on")).alias("month"))
    end = F.lit(captures.agg(F.max("fetched_on")).first()[0]).cast("date")  # open intervals end with the last capture
    listed = spans.withColumn("to", F.least(F.coalesce(F.date_sub("until", 1), end), end)).filter("since <= to")
    listed = listed.select("kind", "pattern", "action", "since", "until", F.explode(F.sequence(_month(F.col("since")), _month(F.col("to")))).alias("month"))
    if listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    held = asked.join(listed, ["kind", "pattern", "month"]).filter("since <= fetched_on and (until is null or fetched_on < until)")
    best = held.groupBy(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("fetched_on").alias("_f")).agg(F.max(F.struct("rank", "action", "pattern", "since")).alias("b"))
    joined = seen.join(best, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("url") == F.col("_u")) & (F.col("fetched_on") == F.col("_f")), "left")
    return joined.select("page_id", "url", "fetched_on", "n_rows", F.coalesce("b.action", F.lit("none")).alias("verdict"), F.col("b.pattern").alias("pattern"), F.col("b.since").alias("since"))
