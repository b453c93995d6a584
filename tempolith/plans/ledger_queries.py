"""Registered queries of the repair ledger and of caption formats as table functions, on conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import assemble, repairs
from ..sources import captions, versions
from .driver_queries import query, table

#: A conversation is a page, its turns are the page's frames; the longest one is shown.
FRAMES = """SELECT conv_id % 16 AS vid, conv_id AS id, conv_id * 1000 + turn AS frame, CAST(length(coalesce(text, '')) AS DOUBLE) AS score,
 length(coalesce(text, '')) % 97 / 1000.0 AS out_mean, length(coalesce(text, '')) % 89 / 1000.0 AS in_rms, length(coalesce(text, '')) AS n FROM {conversations}"""
HIT_FIRST, HIT_LATER = "n % 3 <> 0", "n % 3 <> 0 AND id % 5 <> 1 OR id % 4 = 0 AND n % 2 = 0"
TRIES = 3


def _judged(name: str, hit: str) -> str:
    """Evidence and verdicts of one round in SQL."""
    return f"""{name}f AS (SELECT *, {hit} AS hit, first_value(frame) OVER (PARTITION BY id ORDER BY score DESC, frame) AS shown FROM fr),
{name}c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hit, score DESC, frame) AS place FROM {name}f WHERE frame <> shown),
{name}v AS (SELECT s.vid, s.id, string_agg(c.frame || ':' || c.hit, ',' ORDER BY c.frame) AS evidence, count(c.frame) AS n_candidates, count(*) FILTER (NOT c.hit) AS n_clean,
 count(*) FILTER (NOT c.hit AND place <= {TRIES}) AS n_tried, arg_min(c.frame, (c.out_mean, c.frame)) FILTER (NOT c.hit AND place <= {TRIES} AND c.out_mean <= 0.05 AND c.in_rms >= 0.03) AS source
 FROM {name}f s LEFT JOIN {name}c c USING (id) WHERE s.frame = s.shown AND s.hit GROUP BY s.vid, s.id)"""


@query("WITH fr AS (" + FRAMES.replace("{conversations}", "conversations") + "), " + _judged("a", HIT_FIRST) + ", " + _judged("b", HIT_LATER) + """
SELECT 1 AS round, vid, id, CASE WHEN n_clean = 0 THEN 'all_occluded' WHEN source IS NULL THEN 'skipped' ELSE 'applied' END AS verdict, source, n_candidates, n_clean, n_tried FROM av
UNION ALL SELECT 2, b.vid, b.id, CASE WHEN b.n_clean = 0 THEN 'all_occluded' WHEN b.source IS NULL THEN 'skipped' ELSE 'applied' END, b.source, b.n_candidates, b.n_clean, b.n_tried
 FROM bv b LEFT JOIN av a USING (id) WHERE a.id IS NULL OR a.evidence IS DISTINCT FROM b.evidence
UNION ALL SELECT 2, vid, id, 'clear', NULL, NULL, NULL, NULL FROM av WHERE id NOT IN (SELECT id FROM bv)""")
def repair_ledger(spark, sf_dir):
    """Two rounds of repairs; in the second only pages whose covered frames changed are decided again."""
    frames = spark.sql(FRAMES, conversations=table(spark, sf_dir, "conversations")).withColumn("in_rms", F.col("in_rms").cast("double")).withColumn("out_mean", F.col("out_mean").cast("double"))
    pages = frames.groupBy("vid", "id").agg(F.min_by("frame", F.struct(-F.col("score"), F.col("frame"))).alias("frame"))
    ledger = versions.VersionedTable(spark, versions.fresh_folder(spark, "repairs"))
    for hit in (HIT_FIRST, HIT_LATER):
        repairs.repair_round(ledger, pages, frames, frames.where(hit), out_most=0.05, in_least=0.03, tries=TRIES)
    return ledger.appended().drop("evidence")


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INT AS seq, (turn * 5.0)::DOUBLE AS t_from, (turn * 5.0 + 2.5)::DOUBLE AS t_to, 'x' || trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS text FROM conversations""")
def srt_table_function(spark, sf_dir):
    """Caption files read by ``SELECT * FROM srt(TABLE(...))``."""
    stamp = lambda s, ms: F.concat(times.hms(s), F.lit("," + ms))
    words = F.trim(F.regexp_replace("text", r"\s+", " "))
    cue = F.concat(F.lit("1\n"), stamp(F.col("turn") * 5, "0"), F.lit(" --> "), stamp(F.col("turn") * 5 + 2, "5"), F.lit("\nx"), words, F.lit("\n"))
    files = assemble.joined_lines(table(spark, sf_dir, "conversations"), key=["conv_id"], order=["turn", "role", "text"], line=cue, out="body")
    captions.register(spark)
    files.createOrReplaceTempView("caption_files")
    return spark.sql("SELECT * FROM srt(TABLE(caption_files), 'body')")
