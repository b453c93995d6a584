"""Registered queries of reference votes, moving windows, drifting anchors, two readings and folds over hot keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, integrity, ranges, readings, references, windows
from .driver_queries import query, spread, table

# --- folds over keys of any size -----------------------------------------------------------------------------------------

SIZES = "SELECT source, doc_id, coalesce(length(text), 0) AS size FROM documents"


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM ({SIZES})),
r AS (SELECT source, doc_id, size, k, 1 AS chunk, size AS filled FROM o WHERE k = 1
 UNION ALL SELECT o.source, o.doc_id, o.size, o.k, CASE WHEN filled + o.size > 20000 AND filled >= 10000 THEN chunk + 1 ELSE chunk END,
 CASE WHEN filled + o.size > 20000 AND filled >= 10000 THEN o.size ELSE filled + o.size END FROM r JOIN o ON o.source = r.source AND o.k = r.k + 1)
SELECT source, doc_id, chunk FROM r""")
def hot_key_chunks(spark, sf_dir):
    """Documents packed in order by source, one of which has a third of all rows: it lies in many ranges."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    return folds.greedy_chunks(d, key=["source"], order=["doc_id"], size="size", cap=20_000, rows_per_range=900)


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents")
def numbered_rows(spark, sf_dir):
    return ranges.numbered(table(spark, sf_dir, "documents").select("source", "doc_id"), key=["source"], order=["doc_id"], rows_per_range=900)


# --- votes ------------------------------------------------------------------------------------------------------------

VOTES = {"same": 0.14, "apart": 0.17, "usual": 2, "least": 20, "most": 512, "gap": 10}


@query("""WITH o AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
s AS (SELECT *, CASE WHEN n // {usual} > {most} THEN ceil(n / {most})::BIGINT WHEN n // {usual} < {least} AND n >= {least} THEN greatest(1, n // {least}) ELSE {usual} END AS step FROM o),
refs AS (SELECT label, i, v FROM s WHERE i % step = 0),
rms AS (SELECT s.label, s.vec_id, sqrt(list_sum(list_transform(list_zip(s.v, r.v), lambda z: (z[1] - z[2]) ** 2)) / 64) AS far, sqrt(list_sum(list_transform(list_zip(s.v[1:8], r.v[1:8]), lambda z: (z[1] - z[2]) ** 2)) / 8) AS near
 FROM s JOIN refs r ON s.label IS NOT DISTINCT FROM r.label AND abs(s.i - r.i) >= least({gap}, greatest(1, n // 4))),
v AS (SELECT label, vec_id, count(*) AS votes FROM rms WHERE far >= {apart} AND near <= {same} GROUP BY ALL)
SELECT s.label, s.vec_id, s.i, coalesce(v.votes, 0) AS votes FROM s LEFT JOIN v ON s.vec_id = v.vec_id AND s.label IS NOT DISTINCT FROM v.label""".format(**VOTES))
def reference_votes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return references.reference_votes(e, key=["label"], order=["vec_id"], vector="embedding", width=64, part=(0, 8), rows_per_range=5000, **VOTES)


# --- moving windows ---------------------------------------------------------------------------------------------------

#: Users as cells of a grid of 6 by 8, hours of the week as pairs of pictures, kinds of events as recordings.
GRID_ROWS, GRID_COLS = 6, 8
CHANGES = """SELECT event_type AS vid, CAST(user_id % 6 AS INT) AS row_, CAST(user_id % 48 / 6 AS INT) AS col_, CAST(dayofmonth(ts) AS INT) AS p,
 avg(CASE WHEN user_id % 48 IN (7, 13, 14, 20) THEN 0.05 + event_id % 7 / 100.0 ELSE value / 1000.0 END) AS change FROM {events} GROUP BY ALL"""
BOUNDS = {"moved": 0.04, "active": 0.6, "low": 0.01, "high": 0.099, "sync": 0.7}


@query("WITH RECURSIVE c AS (" + CHANGES.replace("{events}", "events").replace("user_id % 48 / 6", "user_id % 48 // 6") + """), w AS (SELECT vid, p, avg(change) AS whole FROM c GROUP BY ALL),
m AS (SELECT vid, row_, col_, avg((change > {moved})::INT) AS active, median(change) AS amp, count(*) AS n, var_pop(change) AS vc, var_pop(whole) AS vw, covar_pop(change, whole) AS cv FROM c JOIN w USING (vid, p) GROUP BY ALL),
ok AS (SELECT vid, row_, col_ FROM m WHERE active >= {active} AND amp BETWEEN {low} AND {high} AND abs(CASE WHEN n < 3 OR least(vc, vw) * n <= 1e-12 THEN 0 ELSE cv / sqrt(vc * vw) END) <= {sync}),
reach AS (SELECT vid, row_ AS r, col_ AS c, row_ AS r2, col_ AS c2 FROM ok UNION SELECT reach.vid, r, c, ok.row_, ok.col_ FROM reach JOIN ok ON ok.vid = reach.vid AND abs(ok.row_ - r2) + abs(ok.col_ - c2) = 1),
lab AS (SELECT vid, r AS row_, c AS col_, min(r2 * 100 + c2) AS comp FROM reach GROUP BY ALL),
blk AS (SELECT vid, comp, count(*) AS n_cells, min(row_) AS r0, max(row_) AS r1, min(col_) AS c0, max(col_) AS c1 FROM lab GROUP BY vid, comp HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY vid ORDER BY count(*) DESC, comp) = 1),
ser AS (SELECT vid, p, avg(change) AS mean FROM c JOIN lab USING (vid, row_, col_) JOIN blk USING (vid, comp) GROUP BY ALL),
prs AS (SELECT vid, count(*) AS pairs, quantile_cont(whole, 0.75) AS much FROM w GROUP BY vid),
ag AS (SELECT vid, avg((mean > {moved})::INT) AS active, median(mean) AS amp, quantile_cont(mean, 0.9) AS hi, count(*) AS n, var_pop(mean) AS vc, var_pop(whole) AS vw, covar_pop(mean, whole) AS cv,
 avg(mean) FILTER (whole >= much) AS own, avg(whole) FILTER (whole >= much) AS tot FROM ser JOIN w USING (vid, p) JOIN prs USING (vid) GROUP BY vid),
j AS (SELECT *, CASE WHEN n < 3 OR least(vc, vw) * n <= 1e-12 THEN 0 ELSE cv / sqrt(vc * vw) END AS st, [round(c0 / 8.0::DOUBLE, 4), round(r0 / 6.0::DOUBLE, 4), round((c1 + 1) / 8.0::DOUBLE, 4), round((r1 + 1) / 6.0::DOUBLE, 4)] AS box FROM prs LEFT JOIN blk USING (vid) LEFT JOIN ag USING (vid)),
k AS (SELECT *, (box[3] - box[1]) * (box[4] - box[2]) AS a FROM j),
v AS (SELECT *, CASE WHEN pairs < 8 THEN 'pairs' WHEN n_cells IS NULL THEN 'cells' WHEN a > 0.25 THEN 'area' WHEN NOT (active >= {active} AND amp BETWEEN {low} AND {high} AND abs(st) <= {sync}) THEN 'review' ELSE 'window' END AS verdict FROM k)
SELECT vid, pairs, verdict, n_cells, CASE WHEN n_cells IS NOT NULL THEN box END AS box, round(a, 4) AS area, round(active, 4) AS active, round(amp, 5) AS amplitude, round(hi, 5) AS amplitude_high, CASE WHEN n_cells IS NOT NULL THEN round(st, 4) END AS in_step,
 CASE WHEN tot > 1e-9 THEN round(own / tot * a, 4) ELSE 0 END AS share,
 CASE WHEN verdict = 'window' THEN round(least(0.95, 0.5 + 0.25 * least(1, greatest(0, (active - {active}) / (1 - {active}))) + 0.25 * least(1, greatest(0, ({sync} - abs(st)) / {sync}))), 2) END AS confidence FROM v""".format(**BOUNDS))
def moving_windows(spark, sf_dir):
    cells = spark.sql(CHANGES, events=table(spark, sf_dir, "events")).withColumnsRenamed({"row_": "row", "col_": "col"})
    wholes = cells.groupBy("vid", "p").agg(F.avg("change").alias("whole"))
    return windows.moving_windows(cells, wholes, key=["vid"], pair="p", rows=GRID_ROWS, cols=GRID_COLS, **BOUNDS)


# --- drifting anchors -------------------------------------------------------------------------------------------------

PARAS = "SELECT conv_id AS vid, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INT) AS id, coalesce(text, '') AS text FROM {conversations}"
#: Sections: most begin with their own paragraph, some with words of one before.
SECTIONS = f"""SELECT vid, id AS para, CASE WHEN id % 3 = 0 THEN 'so, ' || lag(text, 1) OVER (PARTITION BY vid ORDER BY id) WHEN id % 5 = 4 THEN substr(lag(text, 2) OVER (PARTITION BY vid ORDER BY id), 10, 300)
 WHEN vid % 4 = 1 THEN 'quite another beginning ' || lag(text, 1) OVER (PARTITION BY vid ORDER BY id) ELSE text END AS text FROM ({PARAS}) p"""


@query("WITH p AS (" + PARAS.replace("{conversations}", "conversations") + "), s AS (" + SECTIONS.replace("{conversations}", "conversations") + r"""),
h AS (SELECT vid, para, left(regexp_replace(text, '[\s\x{A0}[:punct:]_«»]+', '', 'g'), 40) AS here FROM s),
t AS (SELECT vid, id, left(regexp_replace(text, '[\s\x{A0}[:punct:]_«»]+', '', 'g'), 400) AS there FROM p),
m AS (SELECT h.vid, para, id, here, there, a, l FROM h JOIN t ON t.vid = h.vid AND id BETWEEN para - 3 AND para - 1, range(1, 41) x(a), range(12, 41) y(l)
 WHERE length(here) >= 12 AND a + l - 1 <= length(here) AND contains(there, substr(here, a::INT, l::INT))),
b AS (SELECT vid, para, id, max(l) AS l, min_by(a, a - 1000 * l) AS a, min_by(here, a - 1000 * l) AS here, any_value(there) AS there FROM m GROUP BY ALL)
SELECT vid, 'warning' AS level, 'stream' AS owner, NULL AS chapter, 'V-42' AS code, para::VARCHAR AS detail FROM b WHERE a - 1 <= 8 AND instr(there, substr(here, a::INT, l::INT)) - 1 <= 40 GROUP BY vid, para""")
def drift_rule(spark, sf_dir):
    made = lambda sql: spark.sql(sql, conversations=table(spark, sf_dir, "conversations"))
    return integrity.drift_rule(made(SECTIONS), made(PARAS))


@query()
def two_readings(spark, sf_dir):
    """Each turn read twice, the second time with other spellings and its lines' ends lost at times."""
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("first")))
    second = F.regexp_replace(F.regexp_replace("first", "[éèê]", "e"), r"\.\n", F.when(F.col("turn") % 2 == 0, ".\n").otherwise("; "))
    return readings.consensus(c.withColumn("second", second), readings=["first", "second"]).select("conv_id", "turn", "role", "consensus")
