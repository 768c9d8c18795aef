"""Registered queries of the recording engine over the shared tables, and SQL for those that SQL can express.

Vectors are read as recordings of two channels (X forward, Y backward) of 64 samples with sample 1 as time 0; users of
the event stream are recordings of one channel whose triggers are their event types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import channels as chf
from .model import Recording
from .functions.timing import as_sample, as_time
from .operators import artifacts, dsp, ica, spectral, timeline, topography
from .plans.routing import na_mean


def dense(spark: SparkSession, d: str) -> Recording:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    wide = e.select(F.col("vec_id").alias("_id"), F.col("embedding").alias("_v"), F.posexplode("embedding").alias("_p", "_x"))
    signal = wide.select("_id", (F.col("_p") - 9).cast("int").alias("_sample"), F.col("_x").cast("double").alias("X"), F.get("_v", 63 - F.col("_p")).cast("double").alias("Y"))
    segments = e.select(F.col("vec_id").alias("_id"), F.concat(F.lit("rec"), (F.col("label") % 3).cast("string")).alias("_recording"), "label", F.when(F.col("label") % 2 == 0, "a").otherwise("b").alias("condition"))
    none = F.lit(None).cast("string")
    at = (F.col("vec_id") % 60 - 9).cast("int")
    bad = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("_id"), F.lit("Bad").alias("_type"), none.alias("_description"), at.alias("_initial"), F.least(at + 3, F.lit(54)).alias("_final"), F.when(F.col("vec_id") % 3 == 0, "X").when(F.col("vec_id") % 3 == 1, "Y").alias("_channel"))
    zero = e.select(F.col("vec_id").alias("_id"), F.lit("Time 0"), none, F.lit(1), F.lit(1), none)
    return Recording(signal, bad.union(zero), segments, 500.0, {"X": {"_x": 1.0, "_y": 0.0, "_z": 1.0}, "Y": {"_x": -1.0, "_y": 1.0, "_z": 0.5}})


def stream(spark: SparkSession, d: str) -> Recording:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("_sample", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    signal = e.select(F.col("user_id").alias("_id"), "_sample", F.col("value").cast("double").alias("V"))
    none = F.lit(None).cast("string")
    events = e.select(F.col("user_id").alias("_id"), F.col("event_type").alias("_type"), none.alias("_description"), F.col("_sample").alias("_initial"), F.col("_sample").alias("_final"), none.alias("_channel"))
    segments = e.select(F.col("user_id").alias("_id")).distinct().withColumn("_recording", F.concat(F.lit("user"), F.col("_id").cast("string")))
    return Recording(signal, events, segments, 100.0, {"V": {}})


def _r(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + F.lit(0.0)).alias(name) if name else F.round(c, 6) + F.lit(0.0)


def _signal(x: Recording) -> DataFrame:
    return x.signal.select("_id", x.order, *[_r(c, c) for c in x.vars])


_EVENTS = ["_id", "_type", "_initial", "_final", "_channel"]

BASE = """
sig AS (SELECT vec_id AS _id, (i - 10)::INT AS _sample, embedding[i]::DOUBLE AS X, embedding[65 - i]::DOUBLE AS Y FROM embeddings, unnest(range(1, 65)) AS t(i)),
seg AS (SELECT vec_id AS _id, 'rec' || (label % 3) AS _recording, label, CASE WHEN label % 2 = 0 THEN 'a' ELSE 'b' END AS condition FROM embeddings),
ev AS (SELECT vec_id AS _id, 'Bad' AS _type, (vec_id % 60 - 9)::INT AS _initial, least(vec_id % 60 - 6, 54)::INT AS _final, CASE vec_id % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' END AS _channel FROM embeddings WHERE vec_id % 2 = 0
  UNION ALL SELECT vec_id, 'Time 0', 1, 1, NULL FROM embeddings),
st AS (SELECT user_id AS _id, event_type AS _type, value::DOUBLE AS V, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS _sample FROM events)
"""


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE, *ctes]) + "\n" + body


def _iir_sql(low: float | None, high: float | None, kind: str, order: int | None, rp: float, keep: str = "true", sample: str = "_sample") -> str:
    """Sections of the design run over the samples one after the other, forward and then backward, from odd reflections."""
    sections = dsp.iir(500.0, low, high, kind, order, rp)
    pad, k = min(3 * (2 * len(sections) + 1), 63), len(sections)

    def one(name: str, source: str, first: int, last: int, step: int) -> str:
        states, level = [], 1.0
        for i, (b, a) in enumerate(sections):
            gain = b.sum() / a.sum()
            states += [f"{level * (gain - b[0])!r} * x AS p{i}", f"{level * (b[2] - a[2] * gain)!r} * x AS q{i}"]
            level *= gain
        states = [x.replace("np.float64(", "").replace(")", "") for x in states]
        inner = f"SELECT r._id, r.c, r.j + {step} AS j, e.x AS y0, {', '.join(f'p{i}, q{i}' for i in range(k))} FROM {name} r JOIN {source} e ON r._id = e._id AND r.c = e.c AND e.j = r.j + {step}"
        for i, (b, a) in enumerate(sections):
            inner = f"SELECT *, {float(b[0])!r} * y{i} + p{i} AS y{i + 1} FROM ({inner})"
        news = ", ".join(f"{float(b[1])!r} * y{i} - {float(a[1])!r} * y{i + 1} + q{i}, {float(b[2])!r} * y{i} - {float(a[2])!r} * y{i + 1}" for i, (b, a) in enumerate(sections))
        return f"{name} AS (SELECT _id, c, {first - step} AS j, 0.0::DOUBLE AS x, {', '.join(states)} FROM {source} WHERE j = {first} UNION ALL SELECT _id, c, j, y{k}, {news} FROM ({inner}))"

    ctes = [
        "l AS (SELECT _id, _sample + 9 AS i, 'X' AS c, X AS v FROM sig UNION ALL SELECT _id, _sample + 9, 'Y', Y FROM sig)",
        f"e AS (SELECT l._id, l.c, j, CASE WHEN j < 0 THEN 2 * a.v - l.v WHEN j > 63 THEN 2 * z.v - l.v ELSE l.v END AS x FROM (SELECT unnest(range({-pad}, {64 + pad})) AS j) JOIN l ON l.i = CASE WHEN j < 0 THEN -j WHEN j > 63 THEN 126 - j ELSE j END JOIN l a ON a._id = l._id AND a.c = l.c AND a.i = 0 JOIN l z ON z._id = l._id AND z.c = l.c AND z.i = 63)",
        one("f", "e", -pad, 63 + pad, 1),
        one("g", f"(SELECT _id, c, j, x FROM f WHERE j >= {-pad})", 63 + pad, -pad, -1),
    ]
    return f"WITH RECURSIVE {', '.join([BASE, *ctes])} SELECT _id, {sample} AS _sample, round(any_value(CASE WHEN c = 'X' THEN x END), 6) + 0.0 AS X, round(any_value(CASE WHEN c = 'Y' THEN x END), 6) + 0.0 AS Y FROM (SELECT *, (j - 9)::INT AS _sample FROM g) WHERE j BETWEEN 0 AND 63 AND {keep} GROUP BY ALL"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_BASELINE = "b AS (SELECT _id, _sample, X - avg(CASE WHEN _sample <= 0 THEN X END) OVER (PARTITION BY _id) AS X, Y - avg(CASE WHEN _sample <= 0 THEN Y END) OVER (PARTITION BY _id) AS Y FROM sig)"


@_query(_sql("SELECT _sample, condition, round(avg(X), 6) + 0.0 AS X, round(avg(Y), 6) + 0.0 AS Y FROM b JOIN seg USING (_id) GROUP BY ALL", _BASELINE))
def erp_average(spark, d):
    x = timeline.baseline(dense(spark, d)).group_by("_sample", "condition")
    x = x.summarize(**{c: na_mean(c) for c in ("X", "Y")})
    return x.signal.join(x.segments, "_id").select("_sample", "condition", _r("X", "X"), _r("Y", "Y"))


@_query(_sql("SELECT _id, _sample, round(X, 6) + 0.0 AS X, round(Y, 6) + 0.0 AS Y FROM b", _BASELINE))
def baseline(spark, d):
    return _signal(timeline.baseline(dense(spark, d)))


@_query(_sql("SELECT _id, _sample, round(2 * X + label, 6) + 0.0 AS Z, label * 10 AS tens FROM sig JOIN seg USING (_id)"))
def mutate_routed(spark, d):
    x = dense(spark, d).mutate(Z="2 * X + label", tens="label * 10")
    return x.signal.join(x.segments.select("_id", "tens"), "_id").select("_id", "_sample", _r("Z", "Z"), "tens")


@_query(_sql("SELECT _id, _sample, round(X - avg(X) OVER (PARTITION BY condition, _sample), 6) + 0.0 AS D, count(*) OVER (PARTITION BY condition, _sample) AS n FROM sig JOIN seg USING (_id)"))
def mutate_grouped(spark, d):
    x = dense(spark, d).group_by("condition", "_sample").mutate(D="X - avg(X)", n="count(X)")
    return x.signal.select("_id", "_sample", _r("D", "D"), "n")


@_query(_sql("SELECT _id, _sample, round(abs(X) + Y, 6) + 0.0 AS A FROM sig"))
def transmute(spark, d):
    return _signal(dense(spark, d).transmute(A="abs(X) + Y"))


@_query(_sql("SELECT ev._id, _type, greatest(_initial, lo) AS _initial, least(_final, hi) AS _final, _channel FROM ev JOIN e ON ev._id = e._id AND _initial <= hi AND _final >= lo", "e AS (SELECT _id, min(_sample) AS lo, max(_sample) AS hi FROM sig WHERE X > 0.2 AND _sample > 5 GROUP BY _id)"))
def filter_clips_events(spark, d):
    return dense(spark, d).filter("X > 0.2", "_sample > 5").events.select(*_EVENTS)


@_query(_sql("SELECT _id, count(*) AS n, (SELECT count(*) FROM ev WHERE ev._id = sig._id) AS n_events FROM sig WHERE _id IN (SELECT _id FROM seg WHERE condition = 'a' AND label > 2) GROUP BY _id"))
def filter_segments(spark, d):
    x = dense(spark, d).filter("condition = 'a'", "label > 2")
    return x.signal.groupBy("_id").agg(F.count("*").alias("n")).join(x.events.groupBy("_id").agg(F.count("*").alias("n_events")), "_id")


@_query(_sql("SELECT _id, _sample, round(X, 6) + 0.0 AS X, round(Y, 6) + 0.0 AS Y FROM sig WHERE _id IN (SELECT _id FROM m WHERE m.m > q) AND true", "g AS (SELECT condition, avg(mx) AS q FROM (SELECT _id, max(X) AS mx FROM sig GROUP BY _id) JOIN seg USING (_id) GROUP BY condition)", "m AS (SELECT s._id, max(X) AS m, any_value(q) AS q FROM sig s JOIN seg USING (_id) JOIN g USING (condition) GROUP BY s._id)"))
def filter_after_grouped_mutate(spark, d):
    x = dense(spark, d).group_by("_id").mutate(mx="max(X)").ungroup()
    means = x.signal.select("_id", "mx").distinct().join(x.segments, "_id").groupBy("condition").agg(F.avg("mx").alias("q"))
    x = x.left_join(means, ["condition"]).filter("mx > q")
    return x.signal.select("_id", "_sample", _r("X", "X"), _r("Y", "Y"))


@_query(_sql("SELECT _id, _sample, X, Y FROM (SELECT *, row_number() OVER (ORDER BY _id, _sample) AS n FROM sig) WHERE n BETWEEN 100 AND 900"))
def slice_signal(spark, d):
    return dense(spark, d).slice_signal(100, 900).signal


@_query(_sql("SELECT dense_rank() OVER (ORDER BY condition) AS _id, condition, round(var_samp(X), 6) AS v, max(Y) AS m, count(*) AS n FROM sig JOIN seg USING (_id) GROUP BY condition"))
def summarize_condition(spark, d):
    x = dense(spark, d).group_by("condition").summarize(v="var_samp(X)", m="max(Y)", n="count(1)")
    return x.signal.join(x.segments, "_id").select("_id", "condition", F.round("v", 6).alias("v"), "m", "n")


@_query(_sql("SELECT seg._id, label, n_name FROM seg LEFT JOIN nation ON label = n_nationkey AND n_nationkey < 5"))
def left_join_segments(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").filter("n_nationkey < 5").select(F.col("n_nationkey").alias("label"), "n_name")
    return dense(spark, d).left_join(n, ["label"]).segments.select("_id", "label", "n_name")


@_query(_sql("SELECT _id, count(*) AS n FROM sig JOIN seg USING (_id) WHERE label IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY _id"))
def semi_join_segments(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("label"))
    return dense(spark, d).semi_join(n, ["label"]).signal.groupBy("_id").agg(F.count("*").alias("n"))


@_query(_sql("SELECT ev.* FROM ev JOIN seg USING (_id) WHERE label NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"))
def anti_join_segments(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("label"))
    return dense(spark, d).anti_join(n, ["label"]).events.select(*_EVENTS)


@_query(_sql("SELECT i.new AS _id, _sample, X, CASE WHEN src = 0 THEN Y END AS Y FROM ids i JOIN sig ON sig._id = i._id", "ids AS (SELECT src, _id, row_number() OVER (ORDER BY src, _id) AS new FROM (SELECT 0 AS src, _id FROM seg WHERE condition = 'a' UNION ALL SELECT 1, _id FROM seg WHERE condition = 'b'))"))
def bind(spark, d):
    import warnings

    x = dense(spark, d)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return Recording.bind(x.filter("condition = 'a'"), x.filter("condition = 'b'").select("X")).signal


_ANCHORS = "a AS (SELECT _id AS old, _sample AS first, row_number() OVER (ORDER BY _id, _sample) AS new FROM st WHERE _type = 'purchase')"


@_query(_sql("SELECT new AS _id, _sample - first + 1 AS _sample, V FROM a JOIN st ON old = _id AND _sample BETWEEN first - 3 AND first + 5", _ANCHORS))
def segment_around(spark, d):
    return timeline.segment(stream(spark, d), "_type = 'purchase'", lim=(-3, 5), unit="samples").signal


@_query(_sql("SELECT new AS _id, _type, _sample - first + 1 AS _initial, _sample - first + 1 AS _final, NULL::VARCHAR AS _channel FROM a JOIN st ON old = _id AND _sample BETWEEN first - 3 AND first + 5", _ANCHORS))
def segment_events(spark, d):
    return timeline.segment(stream(spark, d), "_type = 'purchase'", lim=(-0.03, 0.05)).events.select(*_EVENTS)


@_query(_sql("SELECT round(avg(V), 6) + 0.0 AS V, _sample - first + 1 AS _sample, count(*) AS n FROM a JOIN st ON old = _id AND _sample BETWEEN first - 3 AND first + 5 GROUP BY 2", _ANCHORS))
def segmented_average(spark, d):
    x = timeline.segment(stream(spark, d), "_type = 'purchase'", lim=(-3, 5), unit="samples").group_by("_sample").summarize(V=F.avg("V"), n=F.count("*"))
    return x.signal.select("_sample", _r("V", "V"), "n")


@_query(_sql("SELECT new AS _id, _sample - first + 1 AS _sample, V FROM s JOIN st ON old = _id AND _sample BETWEEN first AND stop", "m AS (SELECT *, lead(_sample) OVER w AS stop, lead(_type) OVER w AS nxt FROM st WHERE _type IN ('view', 'purchase') WINDOW w AS (PARTITION BY _id ORDER BY _sample))", "s AS (SELECT _id AS old, _sample AS first, CASE WHEN nxt = 'purchase' THEN stop END AS stop, row_number() OVER (ORDER BY _id, _sample) AS new FROM m WHERE _type = 'view')"))
def segment_to_end(spark, d):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return timeline.segment(stream(spark, d), "_type = 'view'", end="_type = 'purchase'").signal


@_query(_sql("SELECT 1::BIGINT AS _id, row_number() OVER (ORDER BY _id, _sample) AS _sample, V FROM st"))
def unsegment(spark, d):
    return timeline.unsegment(stream(spark, d)).signal.withColumn("_sample", F.col("_sample").cast("long"))


@_query(_sql("SELECT _id, _sample, round(X - (X + Y) / 2, 6) + 0.0 AS X, round(Y - (X + Y) / 2, 6) + 0.0 AS Y FROM sig"))
def rereference(spark, d):
    return _signal(chf.rereference(dense(spark, d), ref=["X", "Y"]))


@_query(_sql("SELECT _id, _sample, round((X + Y) / 2, 6) + 0.0 AS mean FROM sig"))
def chs_mean(spark, d):
    return _signal(chf.chs_mean(dense(spark, d)))


@_query(_sql("SELECT _id, _sample, greatest(X, Y) AS max, least(X, Y) AS min, round(abs(X - Y) / sqrt(2), 6) + 0.0 AS sd FROM sig"))
def chs_fun(spark, d):
    return chf.chs_fun(dense(spark, d), {"max": "max", "min": "min", "sd": "sd"}).signal.select("_id", "_sample", "max", "min", _r("sd", "sd"))


@_query(_sql("SELECT sig._id, _sample, CASE WHEN b.c IS NULL OR b.c = 'Y' THEN X END AS X, CASE WHEN b.c IS NULL OR b.c = 'X' THEN Y END AS Y FROM sig LEFT JOIN (SELECT _id, coalesce(_channel, 'all') AS c FROM ev WHERE _type = 'Bad') b ON sig._id = b._id"))
def events_to_na_segment(spark, d):
    return timeline.events_to_na(dense(spark, d), "_type = 'Bad'").signal


@_query(_sql("SELECT sig._id, _sample, CASE WHEN b.c IS NULL OR b.c = 'Y' THEN X END AS X, CASE WHEN b.c IS NULL OR b.c = 'X' THEN Y END AS Y FROM sig LEFT JOIN (SELECT *, coalesce(_channel, 'all') AS c FROM ev WHERE _type = 'Bad') b ON sig._id = b._id AND _sample BETWEEN _initial AND _final"))
def events_to_na_interval(spark, d):
    return timeline.events_to_na(dense(spark, d), "_type = 'Bad'", entire_seg=False).signal


def _merge(hits: str, low: int, high: int) -> list[str]:
    return [
        f"h AS ({hits})",
        f"sp AS (SELECT _id, c, CASE WHEN _sample + {low} < -10 THEN -9 ELSE _sample + {low} END AS a, least(_sample + {high}, 54) AS z FROM h WHERE hit)",
        "ru AS (SELECT *, CASE WHEN a - 1 > max(z) OVER (PARTITION BY _id, c ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM sp)",
        "rn AS (SELECT *, sum(fresh) OVER (PARTITION BY _id, c ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS run FROM ru)",
    ]


_LONG = "l AS (SELECT _id, _sample, 'X' AS c, X AS v FROM sig UNION ALL SELECT _id, _sample, 'Y', Y FROM sig)"
_RUNS = "SELECT _id, 'artifact' AS _type, min(a)::INT AS _initial, max(z)::INT AS _final, c AS _channel FROM rn GROUP BY _id, c, run"


@_query(_sql(_RUNS, _LONG, *_merge("SELECT _id, c, _sample, row_number() OVER w >= 5 AND max(v) OVER r - min(v) OVER r >= 0.5 AS hit FROM l WINDOW w AS (PARTITION BY _id, c ORDER BY _sample), r AS (PARTITION BY _id, c ORDER BY _sample ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", -2, 3)))
def artif_minmax(spark, d):
    return artifacts.artif_minmax(dense(spark, d), threshold=0.5, window=5, lim=(-2, 3), unit="samples").events.filter("_type = 'artifact'").select(*_EVENTS)


@_query(_sql(_RUNS, _LONG, *_merge("SELECT _id, c, _sample, count(v) OVER p = 2 AND count(v) OVER q = 2 AND abs(avg(v) OVER q - avg(v) OVER p) >= 0.3 AS hit FROM l WINDOW p AS (PARTITION BY _id, c ORDER BY _sample ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), q AS (PARTITION BY _id, c ORDER BY _sample ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)", -3, 3)))
def artif_step(spark, d):
    return artifacts.artif_step(dense(spark, d), threshold=0.3, window=3, lim=(-3, 3), unit="samples").events.filter("_type = 'artifact'").select(*_EVENTS)


@_query(_sql(_RUNS, _LONG, *_merge("SELECT _id, c, _sample, v <= -0.3 OR v >= 0.25 AS hit FROM l", -1, 1)))
def artif_amplitude(spark, d):
    return artifacts.artif_amplitude(dense(spark, d), threshold=(0.25, -0.3), lim=(-1, 1), unit="samples").events.filter("_type = 'artifact'").select(*_EVENTS)


@_query(
    _sql(
        _RUNS,
        _LONG,
        "d AS (SELECT *, v > lag(v) OVER w AS up, lead(v) OVER w < v AS down FROM l WINDOW w AS (PARTITION BY _id, c ORDER BY _sample))",
        "ft AS (SELECT *, last_value(CASE WHEN up IS NOT TRUE THEN v END IGNORE NULLS) OVER (PARTITION BY _id, c ORDER BY _sample ROWS UNBOUNDED PRECEDING) AS a, first_value(CASE WHEN down IS NOT TRUE THEN v END IGNORE NULLS) OVER (PARTITION BY _id, c ORDER BY _sample ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM d)",
        "pk AS (SELECT _id, c, list(_sample ORDER BY v DESC, _sample) AS s FROM ft WHERE up AND down AND v >= 0.25 AND v - greatest(a, b) >= 0.0001 GROUP BY _id, c)",
        "kp AS (SELECT _id, c, list_reduce(list_transform(s, lambda x: [x]), lambda k, x: CASE WHEN len(list_filter(k, lambda q: abs(q - x[1]) < 4)) > 0 THEN k ELSE list_concat(k, x) END) AS s FROM pk)",
        *_merge("SELECT _id, c, unnest(s) AS _sample, true AS hit FROM kp", -1, 1),
    )
)
def artif_peak(spark, d):
    return artifacts.artif_peak(dense(spark, d), threshold=0.25, window=4, lim=(-1, 1), unit="samples").events.filter("_type = 'artifact'").select(*_EVENTS)


@_query(_sql("SELECT condition, sum(CASE WHEN _id % 2 = 0 THEN 0 ELSE 1 END)::BIGINT AS n FROM seg GROUP BY condition"))
def complete_cases(spark, d):
    return timeline.events_to_na(dense(spark, d), "_type = 'Bad'").count_complete_cases("condition")


@_query(_sql("SELECT _recording, count(*) AS n_segments, sum((_id % 2 = 0)::INT)::BIGINT AS n_incomplete FROM seg GROUP BY _recording"))
def summary_segments(spark, d):
    return timeline.events_to_na(dense(spark, d), "_type = 'Bad'").summary()["segments"]


@_query(_sql("SELECT _id, (_sample - 1) / 0.5 AS _time, k AS _key, v AS _value, _recording, label, condition FROM (SELECT _id, _sample, 'X' AS k, X AS v FROM sig UNION ALL SELECT _id, _sample, 'Y', Y FROM sig) JOIN seg USING (_id)"))
def long_table(spark, d):
    return dense(spark, d).to_long(unit="ms")


@_query(_sql("SELECT _id, (max(_sample) - min(_sample) + 1) / 100.0 AS duration FROM st GROUP BY _id"))
def duration(spark, d):
    return stream(spark, d).duration()


@_query(_sql("SELECT _id, _sample, Y AS eye, X FROM sig"))
def select_rename(spark, d):
    return dense(spark, d).select("X", eye="Y").signal.select("_id", "_sample", "eye", "X")


@_query(_sql("SELECT _id, _sample, X AS x1, Y AS y1 FROM sig"))
def rename_with(spark, d):
    return dense(spark, d).rename_with(lambda c: c.lower() + "1").signal


@_query(_sql("SELECT _id, _sample, X, Y, round(X - avg(X) OVER w, 6) + 0.0 AS X_centred, round(Y - avg(Y) OVER w, 6) + 0.0 AS Y_centred, round(abs(X), 6) AS X_size, round(abs(Y), 6) AS Y_size FROM sig WINDOW w AS (PARTITION BY _id)"))
def across_channels(spark, d):
    x = dense(spark, d)
    own = Window.partitionBy("_id")
    x = x.mutate(**x.across_ch({"centred": lambda c: c - F.avg(c).over(own), "size": F.abs}))
    return x.signal.select("_id", "_sample", "X", "Y", *[_r(c, c) for c in ("X_centred", "Y_centred", "X_size", "Y_size")])


@_query(_sql("SELECT _id, upper(_recording) AS _recording, upper(condition) AS condition, label % 4 AS label, substr(condition || label, 1, 2) AS code, CASE WHEN label > 3 THEN 'high' WHEN label > 1 THEN 'mid' ELSE 'low' END AS level FROM seg"))
def across_segments(spark, d):
    x = dense(spark, d)
    text = x.across(F.upper, x.where(lambda kind: kind == "string"))
    x = x.mutate(**text, label="label % 4", code="substr(concat(condition, label), 1, 2)", level="CASE WHEN label > 3 THEN 'high' WHEN label > 1 THEN 'mid' ELSE 'low' END")
    return x.segments.select("_id", "_recording", "condition", "label", "code", "level")


@_query(_sql("SELECT _id, _sample, round((X + Y) / 2, 6) + 0.0 AS m, least(X, Y) AS low, round(X + Y, 6) + 0.0 AS total FROM sig"))
def rows_across_channels(spark, d):
    x = dense(spark, d)
    x = x.transmute(m=chf.c_across_ch(x, "median"), low=chf.c_across_ch(x, "min"), total=chf.c_across_ch(x, "sum"))
    return x.signal.select("_id", "_sample", _r("m", "m"), "low", _r("total", "total"))


@_query(_sql("SELECT Y FROM sig"))
def pull(spark, d):
    return dense(spark, d).pull()


_HELD = "held AS (SELECT sig._id, _sample, X, Y FROM sig LEFT JOIN (SELECT * FROM ev WHERE _type = 'Bad') b ON sig._id = b._id AND _sample BETWEEN _initial AND _final WHERE b._id IS NULL)"


@_query(_sql("SELECT * FROM held", _HELD))
def na_omit(spark, d):
    return timeline.events_to_na(dense(spark, d), "_type = 'Bad'", entire_seg=False).na_omit().signal


@_query(_sql("SELECT ev._id, _type, greatest(_initial, lo) AS _initial, least(_final, hi) AS _final, _channel FROM ev JOIN e ON ev._id = e._id AND _initial <= hi AND _final >= lo WHERE _type <> 'Bad'", _HELD, "e AS (SELECT _id, min(_sample) AS lo, max(_sample) AS hi FROM held GROUP BY _id)"))
def na_omit_events(spark, d):
    return timeline.events_to_na(dense(spark, d), "_type = 'Bad'", entire_seg=False).na_omit().events.select(*_EVENTS)


@_query(_sql("SELECT _id, _recording, label, condition FROM seg WHERE _id NOT IN (SELECT _id FROM ev WHERE _type = 'Bad')"))
def drop_incomplete(spark, d):
    return timeline.events_to_na(dense(spark, d), "_type = 'Bad'", entire_seg=False).drop_incomplete_segments().segments


@_query(_sql("SELECT _type, _description, count(*) AS n FROM (SELECT *, NULL::VARCHAR AS _description FROM ev) GROUP BY ALL"))
def summary_events(spark, d):
    return dense(spark, d).summary()["events"]


@_query(_sql("SELECT 500.0::DOUBLE AS sampling_rate, lpad((s // 3600)::VARCHAR, greatest(2, len((s // 3600)::VARCHAR))::INT, '0') || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS duration FROM (SELECT count(*) // 500 AS s FROM sig)"))
def summary_total(spark, d):
    return dense(spark, d).summary()["total"]


@_query(_sql("SELECT k AS _key, _type, count(*) AS n, sum(_final - _initial + 1)::BIGINT AS samples FROM (SELECT 'X' AS k UNION ALL SELECT 'Y') JOIN ev ON _channel IS NULL OR _channel = k GROUP BY ALL"))
def events_by_channel(spark, d):
    return topography.event_data(dense(spark, d)).groupBy("_key", "_type").agg(F.count("*").alias("n"), F.sum(F.col("_final") - F.col("_initial") + 1).alias("samples"))


@_query(_sql("SELECT _id, _sample, (_sample - 1) / 500.0 AS seconds, (_sample - 1) / 0.5 AS ms, _sample AS back FROM sig"))
def time_units(spark, d):
    x = dense(spark, d).signal.select("_id", "_sample", as_time(F.col("_sample"), 500.0).alias("seconds"), as_time(F.col("_sample"), 500.0, "ms").alias("ms"))
    return x.withColumn("back", as_sample(F.col("ms"), 500.0, "ms"))


@_query(_sql("SELECT new AS _id, _sample - first + 1 AS _sample, V FROM a JOIN st ON old = _id AND _sample BETWEEN first - old % 4 AND first + 2 + old % 3", "a AS (SELECT _id AS old, _sample AS first, row_number() OVER (ORDER BY _id, _sample) AS new FROM st WHERE _type = 'purchase')"))
def segment_own_limits(spark, d):
    return timeline.segment(stream(spark, d), "_type = 'purchase'", lim=("-(_id % 4)", "2 + _id % 3"), unit="samples").signal


@_query(
    _sql(
        "SELECT 1::BIGINT AS _id, _type, _initial + up AS _initial, _final + up AS _final, _channel FROM ev JOIN o USING (_id) UNION ALL SELECT 1, 'Start', off + 101, off + 101, NULL FROM o UNION ALL SELECT 1, 'Zero', 1 + up, 1 + up, NULL FROM o",
        "o AS (SELECT _id, 64 * (row_number() OVER (ORDER BY _id) - 1) AS off, 64 * (row_number() OVER (ORDER BY _id) - 1) + 110 AS up FROM seg)",
    )
)
def unsegment_events(spark, d):
    return timeline.unsegment(dense(spark, d), start=101, sep={"_type": "Start"}, zero={"_type": "Zero"}).events.select(*_EVENTS)


@_query(_sql("SELECT * FROM (VALUES ('X', pi() / 4, 0.0), ('Y', (pi() / 2 - atan2(0.5, sqrt(2))) * cos(3 * pi() / 4), (pi() / 2 - atan2(0.5, sqrt(2))) * sin(3 * pi() / 4))) v(_channel, _x, _y)"))
def polar_places(spark, d):
    x = dense(spark, d)
    return x._with(channels=topography.change_coord(x.channels)).channels_table().select("_channel", "_x", "_y")


# Fixed for the queries below: unmixing by columns (2, 1) and (1, 3), whose inverse has the rows (0.6, -0.2) and (-0.2, 0.4).
_MIX = ([[0.6, -0.2], [-0.2, 0.4]], [[2.0, 1.0], [1.0, 3.0]])
_CENTRED = "dx AS (SELECT _id, _sample, _recording, X, Y, avg(X) OVER w AS mx, avg(Y) OVER w AS my, X - avg(X) OVER w AS dx, Y - avg(Y) OVER w AS dy FROM sig JOIN seg USING (_id) WINDOW w AS (PARTITION BY _recording))"


def _mixed(spark, d):
    return ica.with_models(dense(spark, d), {f"rec{i}": _MIX for i in range(3)})


@_query(_sql("SELECT _id, _sample, round(X, 6) + 0.0 AS X, round(Y, 6) + 0.0 AS Y, round(10 * (2 * dx + dy), 6) + 0.0 AS ICA1, round(10 * (dx + 3 * dy), 6) + 0.0 AS ICA2 FROM dx", _CENTRED))
def ica_show(spark, d):
    return _signal(ica.show(_mixed(spark, d)))


@_query(_sql("SELECT _id, _sample, round(mx - 0.2 * dx - 0.6 * dy, 6) + 0.0 AS X, round(my + 0.4 * dx + 1.2 * dy, 6) + 0.0 AS Y FROM dx", _CENTRED))
def ica_keep(spark, d):
    return _signal(ica.keep(_mixed(spark, d), "-ICA1"))


_TOTAL = "(X + Y) / 2"


@_query(_sql(f"SELECT _recording, 'ICA1' AS _ica, round(1 - var_samp({_TOTAL} - 0.2 * (2 * dx + dy)) / var_samp({_TOTAL}), 6) + 0.0 AS var FROM dx GROUP BY _recording UNION ALL SELECT _recording, 'ICA2', round(1 - var_samp({_TOTAL} - 0.1 * (dx + 3 * dy)) / var_samp({_TOTAL}), 6) + 0.0 FROM dx GROUP BY _recording", _CENTRED))
def ica_variance_of_given(spark, d):
    return ica.var_table(_mixed(spark, d)).select("_recording", "_ica", _r("var", "var"))


@_query(_sql("SELECT _recording, 'ICA1' AS _ica, 'Y' AS _eog, round(corr(2 * dx + dy, Y), 6) + 0.0 AS cor FROM dx GROUP BY _recording UNION ALL SELECT _recording, 'ICA2', 'Y', round(corr(dx + 3 * dy, Y), 6) + 0.0 FROM dx GROUP BY _recording", _CENTRED))
def ica_correlation(spark, d):
    return ica.cor_table(_mixed(spark, d), "Y").select("_recording", "_ica", "_eog", _r("cor", "cor"))


@_query(_sql("SELECT k AS _key, round(quantile_cont(v, 0.025) * 1.5, 6) AS low, round(quantile_cont(v, 0.975) * 1.5, 6) AS high FROM (SELECT 'X' AS k, X AS v FROM sig UNION ALL SELECT 'Y', Y FROM sig) GROUP BY k"))
def plot_limits(spark, d):
    return topography.plot_limits(dense(spark, d)).select("_key", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@_query(
    _sql(
        "SELECT _id, (i - 9)::INT AS _sample, round(sum(X * h), 6) + 0.0 AS X, round(sum(Y * h), 6) + 0.0 AS Y FROM (SELECT unnest(range(64)) AS i) JOIN taps ON true JOIN e ON j = i + 55 - t GROUP BY _id, i",
        "raw AS (SELECT t, CASE WHEN t = 55 THEN 1.0 ELSE sin(pi() * 0.27 * (t - 55)) / (pi() * 0.27 * (t - 55)) END * (0.54 - 0.46 * cos(2 * pi() * t / 110)) AS h FROM range(111) x(t))",
        "taps AS (SELECT t, h / sum(h) OVER () AS h FROM raw)",
        "p AS (SELECT *, _sample + 9 AS k, first(X) OVER w AS X0, last(X) OVER w AS X9, first(Y) OVER w AS Y0, last(Y) OVER w AS Y9 FROM sig WINDOW w AS (PARTITION BY _id ORDER BY _sample ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
        "e AS (SELECT _id, j, CASE WHEN j < 0 THEN 2 * X0 - X WHEN j > 63 THEN 2 * X9 - X ELSE X END AS X, CASE WHEN j < 0 THEN 2 * Y0 - Y WHEN j > 63 THEN 2 * Y9 - Y ELSE Y END AS Y FROM (SELECT unnest(range(-55, 119)) AS j) JOIN p ON k = CASE WHEN j < 0 THEN -j WHEN j > 63 THEN 126 - j ELSE j END)",
    )
)
def fir_low_pass(spark, d):
    return _signal(dsp.low_pass(dense(spark, d), freq=60))


@_query(_iir_sql(20, 80, "butter", None, 1.0))
def iir_band_pass(spark, d):
    return _signal(dsp.band_pass(dense(spark, d), freq=(20, 80), method="iir"))


@_query(_iir_sql(None, 50.0, "cheby1", 8, 0.05, keep="j % 4 = 0", sample="ceil(-9 / 4.0)::INT + j // 4"))
def downsample(spark, d):
    return _signal(dsp.downsample(dense(spark, d), q=4))


@_query(
    _sql(
        "SELECT _id, k * 500.0 / 8 AS _freq, round(avg((re * re + im * im) * CASE WHEN k IN (0, 4) THEN 1 ELSE 2 END) / (500 * (SELECT sum(w * w) FROM w)), 8) AS X FROM f GROUP BY _id, k",
        "w AS (SELECT i, 0.54 - 0.46 * cos(2 * pi() * i / 7) AS w FROM range(8) t(i))",
        "c AS (SELECT _id, _sample + 9 AS n, X - avg(X) OVER (PARTITION BY _id) AS x FROM sig)",
        "f AS (SELECT _id, s, k, sum(x * w * cos(2 * pi() * k * i / 8)) AS re, sum(x * w * sin(2 * pi() * k * i / 8)) AS im FROM c JOIN (SELECT unnest(range(0, 57, 4)) AS s) ON true JOIN w ON n = s + i JOIN (SELECT unnest(range(5)) AS k) ON true GROUP BY _id, s, k)",
    )
)
def psd_welch(spark, d):
    return spectral.psd(dense(spark, d).select("X")).signal.select("_id", "_freq", F.round("X", 8).alias("X"))


_WELCH = [
    "w AS (SELECT i, 0.54 - 0.46 * cos(2 * pi() * i / 7) AS w FROM range(8) t(i))",
    "c AS (SELECT _id, _sample + 9 AS n, X - avg(X) OVER (PARTITION BY _id) AS x, Y - avg(Y) OVER (PARTITION BY _id) AS y FROM sig)",
    "f AS (SELECT _id, s, k, sum(x * w * cos(2 * pi() * k * i / 8)) AS re, sum(x * w * sin(2 * pi() * k * i / 8)) AS im, sum(y * w * cos(2 * pi() * k * i / 8)) AS r2, sum(y * w * sin(2 * pi() * k * i / 8)) AS i2 FROM c JOIN (SELECT unnest(range(0, 57, 4)) AS s) ON true JOIN w ON n = s + i JOIN (SELECT unnest(range(5)) AS k) ON true GROUP BY _id, s, k)",
    "p AS (SELECT _id, k, avg(re * re + im * im) * CASE WHEN k IN (0, 4) THEN 1 ELSE 2 END AS X, avg(r2 * r2 + i2 * i2) * CASE WHEN k IN (0, 4) THEN 1 ELSE 2 END AS Y FROM f GROUP BY _id, k)",
]


@_query(
    _sql(
        "SELECT _id, band AS _freq, round(sum(CASE WHEN k BETWEEN a AND a + 2 THEN (CASE WHEN k = a + 1 THEN 4 ELSE 1 END) * X ELSE 0 END) / sum((CASE WHEN k IN (0, 4) THEN 1 WHEN k = 2 THEN 2 ELSE 4 END) * X), 6) + 0.0 AS X,"
        " round(sum(CASE WHEN k BETWEEN a AND a + 2 THEN (CASE WHEN k = a + 1 THEN 4 ELSE 1 END) * Y ELSE 0 END) / sum((CASE WHEN k IN (0, 4) THEN 1 WHEN k = 2 THEN 2 ELSE 4 END) * Y), 6) + 0.0 AS Y"
        " FROM p JOIN (VALUES ('low', 0), ('high', 2)) b(band, a) ON true GROUP BY _id, band",
        *_WELCH,
    )
)
def power_bands(spark, d):
    return _signal(spectral.power_band(dense(spark, d), bands={"low": (0, 125), "high": (125, 250)}, relative=True))


_DENSITY = "q AS (SELECT _id, k * 62.5 AS _freq, X / (500 * (SELECT sum(w * w) FROM w)) AS X, Y / (500 * (SELECT sum(w * w) FROM w)) AS Y FROM p)"


@_query(_sql("SELECT _freq, condition, round(avg(X), 8) + 0.0 AS X, round(max(Y), 8) + 0.0 AS Y FROM q JOIN seg USING (_id) WHERE _freq BETWEEN 60 AND 200 AND label > 1 GROUP BY ALL", *_WELCH, _DENSITY))
def psd_filter_summarize(spark, d):
    x = spectral.psd(dense(spark, d)).filter("_freq BETWEEN 60 AND 200", "label > 1").group_by("_freq", "condition").summarize(X=F.avg("X"), Y=F.max("Y"))
    return x.signal.join(x.segments, "_id").select("_freq", "condition", F.round("X", 8).alias("X"), F.round("Y", 8).alias("Y"))


@_query(_sql("SELECT _id, _freq, k AS _key, round(v, 8) + 0.0 AS _value, _recording, label, condition FROM (SELECT _id, _freq, 'X' AS k, X AS v FROM q UNION ALL SELECT _id, _freq, 'Y', Y FROM q) JOIN seg USING (_id)", *_WELCH, _DENSITY))
def psd_long_table(spark, d):
    return spectral.psd(dense(spark, d)).to_long().withColumn("_value", F.round("_value", 8))


@_query(_sql("SELECT _id, 'all' AS _freq, round(sum((CASE WHEN _freq IN (0, 250) THEN 1 WHEN _freq = 125 THEN 2 ELSE 4 END) * X) * 62.5 / 3, 6) + 0.0 AS X, round(sum((CASE WHEN _freq IN (0, 250) THEN 1 WHEN _freq = 125 THEN 2 ELSE 4 END) * Y) * 62.5 / 3, 6) + 0.0 AS Y FROM q GROUP BY _id", *_WELCH, _DENSITY))
def power_of_spectra(spark, d):
    return _signal(spectral.power_band(spectral.psd(dense(spark, d)), bands={"all": (0, 250)}))


@_query()
def ica_variance(spark, d):
    return ica.var_table(ica.fit(dense(spark, d), ignore="_type = 'Bad'")).select("_recording", "_ica", _r("var", "var"))


@_query()
def ica_without_first(spark, d):
    return _signal(ica.keep(ica.fit(dense(spark, d), ignore=None), "-ICA1"))


@_query()
def scalp_map(spark, d):
    return topography.interpolate_recording(dense(spark, d), ["condition"], points=12)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
