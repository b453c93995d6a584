"""Repairs of pages whose picture is covered, and a ledger that decides again only where evidence changed: SNK-19, AGG-15.

Tables: pages(vid, id, frame), candidates(vid, id, frame, score, out_mean, in_rms) of the frames of a page, hits(vid, frame) of covered
frames. The ledger is append-only: a round adds the decisions of those pages whose evidence differs from that of their last
decision. The last decision of a page is in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import VersionedTable
from .pick import least_passing

KEY = ["vid", "id"]
#: Documented defaults: how little may differ outside the box, how much has to inside, and how many frames are tried.
BOUNDS = {"out_most": 0.02, "in_least": 0.02, "tries": 8}


def evidence(pages: DataFrame, candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """One row for each page whose frame is covered, with its other frames and a digest of all that a decision rests on."""
    covered = hits.select("vid", "frame").distinct().withColumn("hit", F.lit(True))
    asked = pages.join(covered, ["vid", "frame"]).select(*KEY, F.col("frame").alias("page_frame"))
    others = candidates.join(covered, ["vid", "frame"], "left").join(asked, KEY).where("frame <> page_frame")
    one = F.struct((-F.coalesce("score", F.lit(0.0))).alias("rank"), "frame", F.coalesce("hit", F.lit(False)).alias("hit"), "out_mean", "in_rms")
    held = asked.join(others.groupBy(*KEY).agg(F.array_sort(F.collect_list(one)).alias("frames")), KEY, "left")
    told = F.concat_ws("|", "page_frame", F.to_json(F.struct("frames")))
    return held.withColumn("evidence", F.sha2(told, 256))


def decided(found: DataFrame, **bounds: float) -> DataFrame:
    """A verdict for each row of ``evidence``: ``applied`` with the source frame (of those tried the one that differs least outside, if it passes
    both bounds), ``all_occluded`` (no frame is clean), or ``skipped``. The clean frames of the highest scores are tried."""
    b = BOUNDS | bounds
    each = found.select(*KEY, F.posexplode_outer(F.filter("frames", lambda f: ~f["hit"])).alias("place", "f")).where(F.col("place") < b["tries"]).select(*KEY, "f.*")
    guards = (F.col("out_mean") <= b["out_most"]) & (F.col("in_rms") >= b["in_least"])
    chosen = least_passing(each, key=KEY, guards=guards, cost="out_mean", ident="frame")
    clean = F.array_size(F.filter("frames", lambda f: ~f["hit"]))
    met = found.join(chosen.drop("tried"), KEY, "left").withColumns({"n_candidates": F.coalesce(F.array_size("frames"), F.lit(0)).cast("long"), "n_clean": F.coalesce(clean, F.lit(0)).cast("long")})
    verdict = F.when(F.col("n_clean") == 0, "all_occluded").when(F.col("chosen").isNull(), "skipped").otherwise("applied")
    return met.select(*KEY, "evidence", verdict.alias("verdict"), F.col("chosen").alias("source"), "n_candidates", "n_clean", F.coalesce("n_tried", F.lit(0).cast("long")).alias("n_tried"))


def in_force(ledger: DataFrame) -> DataFrame:
    """The last decision of each page."""
    last = Window.partitionBy(*KEY).orderBy(F.desc("round"))
    return ledger.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def repair_round(ledger: VersionedTable, pages: DataFrame, candidates: DataFrame, hits: DataFrame, **bounds: float) -> int:
    """Decide the pages whose evidence is new or changed and add the decisions; a page that isn't covered any more is ``clear``.
    Returns the round's number. Pages with the evidence of before are not decided, and add no row."""
    found = evidence(pages, candidates, hits)
    number = (ledger.current() or 0) + 1
    if number == 1:
        added = decided(found, **bounds)
    else:
        last = in_force(ledger.appended()).select(*KEY, F.col("evidence").alias("_was"), F.col("verdict").alias("_verdict"))
        changed = found.join(last, KEY, "left").where(~F.col("evidence").eqNullSafe(F.col("_was"))).drop("_was", "_verdict")
        gone = last.where("_verdict <> 'clear'").join(found.select(*KEY), KEY, "left_anti")
        added = decided(changed, **bounds).unionByName(gone.select(*KEY, F.lit("clear").alias("verdict")), allowMissingColumns=True)
    return ledger.write(added.withColumn("round", F.lit(number)), f"round {number}")


def summary(ledger: DataFrame) -> DataFrame:
    """Decisions by round and verdict."""
    return ledger.groupBy("round", "verdict").agg(F.count("*").alias("pages"))
