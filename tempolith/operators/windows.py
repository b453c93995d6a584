"""Windows that move by themselves within a picture: WIN-18.

A window is a connected block of grid cells that moves most of the time, a little each time, and not in step with the whole picture.
Cells are tested one by one, the passing ones connected, and the found block is tested again as one: cells that pass each for itself may
fail together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import grid_components

#: Documented defaults of the tests.
TESTS = {"moved": 0.004, "active": 0.5, "low": 0.0015, "high": 0.12, "sync": 0.6}


def in_step(a: str, b: str) -> Column:
    """Correlation of two series; 0 for fewer than three pairs and where one of them rests."""
    rests = F.least(F.var_pop(a), F.var_pop(b)) * F.count("*") <= 1e-12
    return F.when((F.count("*") < 3) | rests, F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b))))


def measures(change: str, whole: str, moved: float) -> list[Column]:
    return [F.avg((F.col(change) > moved).cast("double")).alias("active"), F.median(change).alias("amplitude"), in_step(change, whole).alias("in_step")]


def passes(tests: dict[str, float]) -> Column:
    return (F.col("active") >= tests["active"]) & F.col("amplitude").between(tests["low"], tests["high"]) & (F.abs("in_step") <= tests["sync"])


def moving_windows(
    cells: DataFrame, wholes: DataFrame, *, key: Sequence[str], pair: str, rows: int, cols: int, row: str = "row", col: str = "col", change: str = "change", whole: str = "whole", least_cells: int = 2, least_pairs: int = 8, most_area: float = 0.25, **tests: float
) -> DataFrame:
    """For each key the largest connected block of cells that pass, measured anew, with a verdict.

    ``cells`` has the change of every cell for every pair of neighbouring pictures (cells of blocked regions left out), ``wholes`` that of the
    whole picture. ``verdict`` is ``window``, or why there is none: ``pairs`` (fewer than ``least_pairs``), ``cells`` (no block of ``least_cells``),
    ``area`` (more than ``most_area`` of the picture), ``review`` (the block as one fails a test). ``box`` is left, top, right, bottom as shares;
    ``share`` is the block's part of the change in the quarter of pairs that changed most; ``confidence`` grows from 0.5 to 0.95 with the
    distance from the bounds of activity and step. Of blocks of one size the one with the topmost, then leftmost, cell counts.
    """
    bounds = TESTS | tests
    keyed = lambda a, b, *more: a.join(b, [*key, *more])
    pairs = wholes.groupBy(*key).agg(F.count("*").alias("pairs"), F.percentile(whole, F.lit(0.75)).alias("much"))
    met = keyed(cells, wholes, pair)
    passing = met.groupBy(*key, row, col).agg(*measures(change, whole, bounds["moved"])).where(passes(bounds))
    labelled = grid_components(passing, key=key, row=row, col=col)
    blocks = labelled.groupBy(*key, "component").agg(
        F.count("*").alias("n_cells"), F.min(row).alias("r0"), F.max(row).alias("r1"), F.min(col).alias("c0"), F.max(col).alias("c1"), F.min(F.struct(row, col)).alias("first")
    )
    largest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n_cells"), "first")) == 1
    chosen = blocks.where(F.col("n_cells") >= least_cells).withColumn("_largest", largest).where("_largest").drop("_largest", "first")
    members = keyed(labelled, chosen.select(*key, "component"), "component").select(*key, row, col)
    series = keyed(keyed(cells, members, row, col).groupBy(*key, pair).agg(F.avg(change).alias("mean")), wholes, pair)
    much = F.col(whole) >= F.col("much")
    again = keyed(series, pairs).groupBy(*key).agg(
        *measures("mean", whole, bounds["moved"]), F.percentile("mean", F.lit(0.9)).alias("high"), F.avg(F.when(much, F.col("mean"))).alias("own"), F.avg(F.when(much, F.col(whole))).alias("all")
    )
    box = F.array(*[F.round(c, 4) for c in (F.col("c0") / cols, F.col("r0") / rows, (F.col("c1") + 1) / cols, (F.col("r1") + 1) / rows)])
    out = pairs.join(keyed(chosen, again).withColumn("box", box), list(key), "left")
    area = (F.col("box")[2] - F.col("box")[0]) * (F.col("box")[3] - F.col("box")[1])
    verdict = F.when(F.col("pairs") < least_pairs, "pairs").when(F.col("n_cells").isNull(), "cells").when(area > most_area, "area").when(~passes(bounds), "review").otherwise("window")
    room = lambda x, most: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / max(1e-6, most)))
    sure = 0.5 + 0.25 * room(F.col("active") - bounds["active"], 1 - bounds["active"]) + 0.25 * room(bounds["sync"] - F.abs("in_step"), bounds["sync"])
    share = F.when(F.col("all") > 1e-9, F.col("own") / F.col("all") * area).otherwise(F.lit(0.0))
    confidence = F.least(F.lit(0.95), sure)
    return out.select(
        *key, "pairs", verdict.alias("verdict"), "n_cells", "box", F.round(area, 4).alias("area"), F.round("active", 4).alias("active"), F.round("amplitude", 5).alias("amplitude"),
        F.round("high", 5).alias("amplitude_high"), F.round("in_step", 4).alias("in_step"), F.round(share, 4).alias("share"), F.when(verdict == "window", F.round(confidence, 2)).alias("confidence"),
    )
