"""Registered queries of the library's own operators on the driver tables, each with its SQL twin.

Every query reads its whole tables. Doubles are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, texts, times
from ..operators import assemble, folds, integrity, markup, pick, sequences, state, temporal, terms, triage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Text work on a table of one row group needs its rows dealt out first."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with seconds since the epoch as ``t``."""
    return table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


EV = "ev AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"
DIFFS = f"""{EV}, df AS (SELECT *, coalesce(abs(value - lag(value) OVER w), 0.0) AS diff, row_number() OVER w - 1 AS i
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"""


def diffs(spark, sf_dir):
    return sequences.with_diffs(events(spark, sf_dir), key=["user_id"], order=["t", "event_id"], value="value")


# --- sessions, runs, series --------------------------------------------------------------------------------------


@query(f"""WITH {EV}, s AS (
  SELECT *, sum(CASE WHEN p IS NULL OR p >= 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session
  FROM (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM ev))
SELECT user_id, session, min(t) AS t_start, max(t) AS t_end, count(*) AS n FROM s GROUP BY user_id, session""")
def gap_sessions(spark, sf_dir):
    found = sequences.gap_sessions(events(spark, sf_dir), key=["user_id"], start="t", tie=["event_id"], gap=43200)
    return sequences.summarise(found, key=["user_id"], group="session", start="t", end="t")


@query(f"""WITH {EV}, s AS (
  SELECT *, sum(CASE WHEN p IS NULL OR p >= 43200.5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session
  FROM (SELECT *, floor(t) - floor(lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS p FROM ev))
SELECT user_id, session, count(*) AS n FROM s GROUP BY user_id, session""")
def whole_second_sessions(spark, sf_dir):
    found = sequences.gap_sessions(events(spark, sf_dir), key=["user_id"], start="t", tie=["event_id"], gap=43200.5, whole=True)
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query(f"""WITH {DIFFS}, r AS (
  SELECT *, sum(CASE WHEN i = 0 OR diff > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS island FROM df)
SELECT user_id, min(i) AS i_start, max(i) AS i_end, count(*) AS n FROM r GROUP BY user_id, island HAVING count(*) >= 3""")
def stable_runs(spark, sf_dir):
    return sequences.stable_runs(diffs(spark, sf_dir), key=["user_id"], order=["t", "event_id"], diff="diff", threshold=20, min_rows=3)


@query(f"""WITH {DIFFS}, u AS (SELECT user_id, event_id, round(diff * 1000000)::HUGEINT AS d FROM df),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM u),
l AS (SELECT user_id, n, sum(d) AS s, 17 * (n - 1) % 20 AS rest, max(CASE WHEN k = 17 * (n - 1) // 20 THEN d END) AS low, max(CASE WHEN k = least(17 * (n - 1) // 20 + 1, n - 1) THEN d END) AS high FROM k GROUP BY user_id, n)
SELECT u.user_id, event_id, round(d / 1000000, 6) AS diff FROM u JOIN l USING (user_id) WHERE n >= 8 AND 20 * d >= (20 - rest) * low + rest * high AND 2 * n * d >= 3 * s""")
def hard_cuts(spark, sf_dir):
    return sequences.hard_cuts(diffs(spark, sf_dir), key=["user_id"], diff="diff").where("is_cut").select("user_id", "event_id", F.round("diff", 6).alias("diff"))


@query(f"""WITH {EV} SELECT user_id, event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS med FROM ev""")
def rolling_median(spark, sf_dir):
    return sequences.rolling_median(events(spark, sf_dir), key=["user_id"], order=["t", "event_id"], value="value").select("user_id", "event_id", F.round("rolling_median", 6).alias("med"))


@query(f"""WITH {EV}, nb AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
pad AS (SELECT a.user_id, a.event_id, b.value FROM nb a, range(-3, 4) d(o) JOIN nb b ON b.user_id = a.user_id AND b.k = least(greatest(a.k + d.o, 1), a.n))
SELECT user_id, event_id, round(median(value), 6) AS med FROM pad GROUP BY user_id, event_id""")
def rolling_median_replicated(spark, sf_dir):
    out = sequences.rolling_median(events(spark, sf_dir), key=["user_id"], order=["t", "event_id"], value="value", radius=3, replicate_edges=True)
    return out.select("user_id", "event_id", F.round("rolling_median", 6).alias("med"))


#: The first hour of the events' month, and the kinds of events that open and close, or are matched.
HOUR_ZERO, DAY_ZERO, OPENING, CLOSING = 473_352, 19_723, "click", "view"


@query(f"""WITH {EV}, b AS (SELECT event_type, floor(t / 3600) - {HOUR_ZERO} AS s, value FROM ev),
g AS (SELECT event_type, s, avg(value) AS mean, max(value) AS largest, count(*) AS n FROM b GROUP BY event_type, s),
axis AS (SELECT event_type, unnest(generate_series(0, max(s)::BIGINT)) AS s FROM b GROUP BY event_type)
SELECT a.event_type, a.s, round(coalesce(mean, 0), 6) AS mean, round(coalesce(largest, 0), 6) AS largest, coalesce(n, 0) AS n
FROM axis a LEFT JOIN g ON g.event_type = a.event_type AND g.s = a.s""")
def filled_buckets(spark, sf_dir):
    rebased = events(spark, sf_dir).withColumn("t", F.col("t") - HOUR_ZERO * 3600)
    out = sequences.buckets(rebased, key=["event_type"], time="t", value="value", width=3600.0)
    return out.select("event_type", "s", F.round("mean", 6).alias("mean"), F.round("largest", 6).alias("largest"), "n")


@query(f"""WITH {EV} SELECT user_id, count(*) AS n, round(max(g), 6) AS max_gap FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS g FROM ev) GROUP BY user_id""")
def max_gap(spark, sf_dir):
    return sequences.max_gap(events(spark, sf_dir), key=["user_id"], time="t").select("user_id", "n", F.round("max_gap", 6).alias("max_gap"))


@query("""SELECT user_id, count(*) AS n, round(CASE WHEN count(*) < 3 OR corr(value, h) IS NULL OR isnan(corr(value, h)) THEN 0 ELSE corr(value, h) END, 5) AS r
FROM (SELECT *, CAST(extract(hour FROM ts) AS DOUBLE) AS h FROM events) GROUP BY user_id""")
def pearson(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("h", F.hour("ts").cast("double"))
    return sequences.correlation(ev, key=["user_id"], x="value", y="h").select("user_id", "n", F.round("r", 5).alias("r"))


@query(f"""WITH {EV}, o AS (SELECT user_id, event_type, t, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nx FROM ev WHERE event_type IN ('{OPENING}', '{CLOSING}'))
SELECT user_id, t AS t_from, coalesce(nx, dur0) AS t_to FROM o JOIN (SELECT user_id, max(t) AS dur0 FROM ev GROUP BY user_id) d USING (user_id) WHERE event_type = '{OPENING}'""")
def paired_events(spark, sf_dir):
    ev = events(spark, sf_dir)
    ends = ev.groupBy("user_id").agg(F.max("t").alias("dur0"))
    out = sequences.paired_events(ev.join(ends, "user_id"), key=["user_id"], order=["t", "event_id"], time="t", kind="event_type", opening=OPENING, closing=CLOSING, duration="dur0")
    return out.select("user_id", "t_from", "t_to")


@query(f"""WITH {EV}, f AS (SELECT user_id, event_type, floor(t / 86400) AS day, avg(value) AS m FROM ev WHERE extract(hour FROM ts) BETWEEN 6 AND 18 GROUP BY ALL)
SELECT user_id, round(avg(CASE WHEN m > 50 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT user_id, day, avg(value) AS m FROM (SELECT user_id, floor(t / 86400) AS day, value FROM ev WHERE extract(hour FROM ts) BETWEEN 6 AND 18) GROUP BY ALL) GROUP BY user_id""")
def band_rate(spark, sf_dir):
    ev = events(spark, sf_dir).withColumns({"day": F.floor(F.col("t") / 86400), "hour": F.hour("ts")})
    return sequences.band_rate(ev, key=["user_id"], frame="day", row="hour", value="value", first=6, last=18, threshold=50).select("user_id", F.round("rate", 6).alias("rate"))


@query(f"""WITH h AS (SELECT user_id, extract(hour FROM ts)::INT AS hr, count(*)::DOUBLE AS rate FROM events GROUP BY ALL),
p AS (SELECT *, sum(CASE WHEN lg IS NULL OR hr - lg - 1 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY hr) AS isl FROM (SELECT *, lag(hr) OVER (PARTITION BY user_id ORDER BY hr) AS lg FROM h WHERE rate >= 2)),
k AS (SELECT user_id, arg_max(isl, (rate, -hr)) AS isl FROM p GROUP BY user_id)
SELECT user_id, min(hr) AS first, max(hr) AS last, max(rate) AS peak FROM p JOIN k USING (user_id, isl) GROUP BY user_id, isl""")
def band_around_peak(spark, sf_dir):
    hours = table(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").alias("hr")).agg(F.count("*").cast("double").alias("rate"))
    return sequences.band_around_peak(hours, key=["user_id"], row="hr", rate="rate", gate=2.0)


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS z FROM lineitem)
SELECT k, n, round(z - q, 4) AS media_from, round(z, 4) AS media_to FROM s""")
def running_offsets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", F.lit(0.0).alias("a"), F.col("l_quantity").alias("z"))
    return sequences.running_offsets(li, key=["k"], order=["n", "l_partkey", "l_suppkey"], start="a", end="z").select("k", "n", F.round("media_from", 4).alias("media_from"), F.round("media_to", 4).alias("media_to"))


SPANS = """sp AS (SELECT o_custkey AS c, o_orderkey AS o, epoch_us(o_orderdate) / 8.64e10 AS a, max(epoch_us(l_shipdate)) / 8.64e10 AS z
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def spans(spark, sf_dir):
    """Orders as intervals in days, from the order to the last shipment."""
    days = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 8.64e10
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.max(days("l_shipdate")).alias("z"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), days("o_orderdate").alias("a")).join(shipped, "o")


@query(f"""WITH {SPANS}, g AS (SELECT *, greatest(a - coalesce(max(z) OVER (PARTITION BY c ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS gap, 30000.0 AS d FROM sp)
SELECT c, round(sum(z - a), 4) AS sampled_sec, round(greatest(max(gap), max(d) - max(z), 0), 4) AS max_uncovered FROM g GROUP BY c""")
def coverage(spark, sf_dir):
    out = sequences.coverage(spans(spark, sf_dir).withColumn("d", F.lit(30000.0)), key=["c"], start="a", end="z", duration="d")
    return out.select("c", F.round("sampled_sec", 4).alias("sampled_sec"), F.round("max_uncovered", 4).alias("max_uncovered"))


@query(f"""WITH {SPANS}, v AS (SELECT c, max(z) / 10000.0 AS cov FROM sp GROUP BY c)
SELECT c, round(cov, 6) AS coverage, CASE WHEN cov < 0.8 THEN 'partial' WHEN cov > 1.2 THEN 'beyond end' ELSE 'accepted' END AS verdict FROM v""")
def caption_verdict(spark, sf_dir):
    out = sequences.caption_verdict(spans(spark, sf_dir).withColumn("d", F.lit(10000.0)), key=["c"], end="z", duration="d")
    return out.withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {EV} SELECT event_id, lag(event_type) OVER w AS prev_event_type, lead(event_type) OVER w AS next_event_type FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""")
def row_neighbours(spark, sf_dir):
    return sequences.neighbours(events(spark, sf_dir), key=["user_id"], order=["t", "event_id"], columns=["event_type"]).select("event_id", "prev_event_type", "next_event_type")


@query("""SELECT p_partkey, i, round_even(10 + (i - 1) / 3.0, 3) AS t FROM part, LATERAL (SELECT unnest(generate_series(1, p_size)) AS i)""")
def frame_index(spark, sf_dir):
    counts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("count"))
    return sequences.frame_index(counts, key=["p_partkey"], fps=3.0, offset=10.0)


# --- joins in time -----------------------------------------------------------------------------------------------


def two_kinds(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.where(F.col("event_type") == OPENING).select("user_id", "t", "event_id"), ev.where(F.col("event_type") == CLOSING).select("user_id", F.col("t").alias("rt"), F.col("event_id").alias("r_id"))


NEAREST = f"""WITH {EV}, l AS (SELECT * FROM ev WHERE event_type = '{OPENING}'), r AS (SELECT * FROM ev WHERE event_type = '{CLOSING}'),
m AS (SELECT l.event_id, r.event_id AS r_id, abs(r.t - l.t) AS d, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.t - l.t), r.t, r.event_id) AS k FROM l JOIN r USING (user_id))
"""


@query(NEAREST + "SELECT event_id, r_id, round(d, 4) AS distance FROM m WHERE k = 1")
def asof_nearest(spark, sf_dir):
    l, r = two_kinds(spark, sf_dir)
    out = temporal.nearest(l, r, key=["user_id"], left_time="t", left_id="event_id", right_time="rt", right_id="r_id")
    return out.where("r_id is not null").select("event_id", "r_id", F.round("distance", 4).alias("distance"))


@query(NEAREST + "SELECT event_id, r_id FROM m WHERE k = 1 AND d <= 21600")
def nearest_within(spark, sf_dir):
    l, r = two_kinds(spark, sf_dir)
    out = temporal.nearest(l, r, key=["user_id"], left_time="t", left_id="event_id", right_time="rt", right_id="r_id", within=21600)
    return out.where("r_id is not null").select("event_id", "r_id")


SHIFT = 40.0  # days by which a second plan of the same orders is later


def replanned(spark, sf_dir):
    sp = spans(spark, sf_dir)
    return sp, sp.select("c", F.col("o").alias("n"), (F.col("a") + SHIFT).alias("a"), (F.col("z") + SHIFT).alias("z"))


REPLANNED = f"{SPANS}, np AS (SELECT c, o AS n, a + {SHIFT} AS a, z + {SHIFT} AS z FROM sp)"


@query(f"""WITH {REPLANNED}, p AS (SELECT x.c, x.o, y.n, least(x.z, y.z) - greatest(x.a, y.a) AS ov, row_number() OVER (PARTITION BY x.o ORDER BY least(x.z, y.z) - greatest(x.a, y.a) DESC, y.n) AS k
  FROM sp x JOIN np y ON x.c = y.c WHERE least(x.z, y.z) > greatest(x.a, y.a))
SELECT c, o, n, round(ov, 4) AS overlap FROM p WHERE k = 1""")
def overlap_best(spark, sf_dir):
    old, new = replanned(spark, sf_dir)
    return temporal.best_overlap(old, new, key=["c"], old_id="o", new_id="n", width=60.0, old_span=("a", "z"), new_span=("a", "z"), fall_back=False).select("c", "o", "n", F.round("overlap", 4).alias("overlap"))


@query(f"""WITH {REPLANNED}, p AS (SELECT x.c, x.o, y.n, least(x.z, y.z) - greatest(x.a, y.a) AS ov, abs(x.a - y.a) AS ds, y.a AS ya FROM sp x JOIN np y ON x.c = y.c),
k AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY CASE WHEN ov > 0 THEN 0 ELSE 1 END, CASE WHEN ov > 0 THEN -ov ELSE ds END, CASE WHEN ov > 0 THEN n ELSE 0 END, ya, n) AS r FROM p)
SELECT c, o, n, round(greatest(ov, 0), 4) AS overlap FROM k WHERE r = 1""")
def overlap_or_nearest(spark, sf_dir):
    old, new = replanned(spark, sf_dir)
    return temporal.best_overlap(old, new, key=["c"], old_id="o", new_id="n", width=60.0, old_span=("a", "z"), new_span=("a", "z")).select("c", "o", "n", F.round("overlap", 4).alias("overlap"))


@query(f"""WITH {SPANS}, q AS (SELECT o_custkey AS c, o_orderkey AS o, epoch_us(o_orderdate) / 8.64e10 AS t FROM orders)
SELECT c, o FROM q WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.c = q.c AND q.t BETWEEN sp.a + 5 - 1 AND sp.z)""")
def outside_spans(spark, sf_dir):
    """Orders placed while no order of the customer, five days old at least, was on its way."""
    sp = spans(spark, sf_dir).withColumn("a", F.col("a") + 5)
    points = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 8.64e10).alias("t"))
    return temporal.outside_all(points, sp, key=["c"], time="t", start="a", end="z", tolerance=1.0).select("c", "o")


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS w, 100.0 * l_linenumber AS o, sum(l_quantity) OVER win - l_quantity AS mf, sum(l_quantity) OVER win AS mt
  FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) WINDOW win AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)),
p AS (SELECT o_orderkey AS k, (o_custkey % 150)::DOUBLE AS t FROM orders)
SELECT p.k, t, arg_max(s.w, s.mf) AS w, round(arg_max(s.o + t - s.mf, s.mf), 4) AS orig FROM p JOIN s ON s.k = p.k AND s.mf <= t GROUP BY p.k, t""")
def piecewise_map(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("window")).agg(F.sum("l_quantity").alias("z"))
    parts = sequences.running_offsets(li.withColumn("a", F.lit(0.0)), key=["k"], order=["window"], start="a", end="z").withColumn("orig_from", 100.0 * F.col("window"))
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 150).cast("double").alias("t"))
    return temporal.piecewise(points, parts, key=["k"], time="t").where("window is not null").select("k", "t", F.col("window").alias("w"), F.round("orig", 4).alias("orig"))


@query("""WITH d AS (SELECT p_partkey AS k, p_retailprice AS d FROM part), w AS (
 SELECT k, d, 0 AS win, CASE WHEN d <= 30 THEN 0.0 ELSE greatest(0.1 * d - 15, 0.0) END AS a FROM d
 UNION ALL SELECT k, d, 1, greatest(0.5 * d - 15, greatest(0.1 * d - 15, 0) + 30) FROM d WHERE d > 90 UNION ALL SELECT k, d, 2, least(greatest(0.9 * d - 15, greatest(0.5 * d - 15, greatest(0.1 * d - 15, 0) + 30) + 30), d - 30) FROM d WHERE d > 90)
SELECT k, win AS "window", round(a, 4) AS orig_from, round(least(a + 30, d), 4) AS orig_to FROM w""")
def window_plan(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("duration"))
    return temporal.window_plan(d, key=["k"]).select("k", "window", F.round("orig_from", 4).alias("orig_from"), F.round("orig_to", 4).alias("orig_to"))


# --- choosing ----------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_orderkey""")
def best_per_group(spark, sf_dir):
    return pick.best_per_group(table(spark, sf_dir, "lineitem"), key=["l_orderkey"], score=F.col("l_extendedprice"), ties=[-F.col("l_linenumber")], columns=["l_linenumber", "l_extendedprice"])


@query("""WITH b AS (SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS best, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) FILTER (l_returnflag = 'R') AS ok FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(ok, best) AS chosen, ok IS NOT NULL AND ok <> best AS overridden FROM b""")
def priority_override(spark, sf_dir):
    out = pick.with_override(table(spark, sf_dir, "lineitem"), key=["l_orderkey"], score=F.col("l_extendedprice"), tie=-F.col("l_linenumber"), allowed=F.col("l_returnflag") == "R", ident="l_linenumber")
    return out.select("l_orderkey", "chosen", "overridden")


@query("""WITH n AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT DISTINCT p_brand, p_partkey FROM n, range(7) r(j) WHERE n <= 7 OR i = round_even(j * (n - 1) / 6.0, 0)""")
def spaced_sample(spark, sf_dir):
    return pick.spaced_sample(table(spark, sf_dir, "part"), key=["p_brand"], order=["p_partkey"], want=7).select("p_brand", "p_partkey")


@query("""WITH n AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT DISTINCT p_brand, p_partkey FROM n, range(5) r(j) WHERE n <= 5 OR i = floor(j * n / 5.0)""")
def even_downsample(spark, sf_dir):
    return pick.spaced_sample(table(spark, sf_dir, "part"), key=["p_brand"], order=["p_partkey"], want=5, floor=True).select("p_brand", "p_partkey")


@query("""SELECT c_nationkey, arg_min(c_custkey, (CASE WHEN regexp_matches(c_mktsegment, '^BUILD') THEN 0 WHEN regexp_matches(c_mktsegment, 'MACH') THEN 1 ELSE 2 END, c_custkey)) AS c_custkey FROM customer GROUP BY c_nationkey""")
def first_by_priority(spark, sf_dir):
    return pick.first_by_priority(table(spark, sf_dir, "customer"), ["^BUILD", "MACH"], key=["c_nationkey"], name="c_mktsegment", order="c_custkey", columns=["c_custkey"])


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS p, l_quantity / 25.0 AS m FROM lineitem),
r AS (SELECT *, m BETWEEN 0.8 AND 1.2 AS ok, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN m BETWEEN 0.8 AND 1.2 THEN 0 ELSE 1 END, CASE WHEN m BETWEEN 0.8 AND 1.2 THEN p ELSE -m END, p, m) AS n FROM s)
SELECT k, p, round(m, 6) AS m, ok AS accepted FROM r WHERE n = 1""")
def fallback_choice(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("p"), (F.col("l_quantity") / 25.0).alias("m"))
    return pick.accepted_or_best(s, key=["k"], priority="p", measure="m", least=0.8, most=1.2, columns=["p", "m"]).withColumn("m", F.round("m", 6))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey""")
def latest_record(spark, sf_dir):
    return pick.latest(table(spark, sf_dir, "orders"), key=["o_custkey"], order=["o_orderdate", "o_orderkey"], columns=["o_orderkey", "o_orderstatus"])


@query("""SELECT p_brand, min(p_partkey) AS p_partkey, lower(p_type) AS kind FROM part GROUP BY p_brand, lower(p_type)""")
def distinct_in_order(spark, sf_dir):
    out = pick.distinct_in_order(table(spark, sf_dir, "part"), key=["p_brand"], value=F.lower("p_type"), order=["p_partkey"])
    return out.select("p_brand", "p_partkey", F.lower("p_type").alias("kind"))


@query("""SELECT l_orderkey, arg_min(l_linenumber, (l_extendedprice, l_linenumber)) FILTER (l_discount >= 0.05 AND l_tax <= 0.04) AS chosen, count(*) AS n_tried FROM lineitem GROUP BY l_orderkey""")
def least_passing(spark, sf_dir):
    return pick.least_passing(table(spark, sf_dir, "lineitem"), key=["l_orderkey"], guards=(F.col("l_discount") >= 0.05) & (F.col("l_tax") <= 0.04), cost="l_extendedprice", ident="l_linenumber").drop("tried")


@query("""SELECT s_suppkey, s_nationkey, round(median(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS group_median FROM supplier""")
def group_median(spark, sf_dir):
    out = pick.against_group_median(table(spark, sf_dir, "supplier"), key=["s_nationkey"], value="s_acctbal")
    return out.select("s_suppkey", "s_nationkey", F.round("group_median", 4).alias("group_median"))


@query("""WITH n AS (SELECT p_brand, p_partkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1 AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1 AS b FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
f AS (SELECT *, i = 0 OR i = n - 1 OR a OR b AS forced FROM n), p AS (SELECT * FROM f WHERE n <= 6 OR forced OR i IN (SELECT 0) OR EXISTS (SELECT 1 FROM range(6) r(j) WHERE i = round_even(j * (n - 1) / 5.0, 0)))
SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY forced DESC, (i * 7919) % n, i) AS k FROM p) WHERE k <= 6""")
def candidate_pool(spark, sf_dir):
    return pick.candidate_pool(table(spark, sf_dir, "part"), key=["p_brand"], order="p_partkey", ink="p_size", sharp="p_retailprice").select("p_brand", "p_partkey")
