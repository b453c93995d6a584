"""Joins in time: maximal overlap, nearest, anchors, containment, piecewise mapping.

J-03, J-04, J-06 to J-09, J-18, WIN-20, WIN-22 to WIN-24, AGG-04. Joins have the key as equality; interval
joins add a time bucket, so that a hot key is spread over its buckets; nearest joins are a merge of both
sides in one sorted pass and never pair rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_pairs(left: DataFrame, right: DataFrame, *, key: Sequence[str], width: float, left_span=("l_from", "l_to"), right_span=("r_from", "r_to")) -> DataFrame:
    """All pairs of a key whose intervals overlap by more than nothing."""
    return _met(left, right, key=key, width=width, left_span=left_span, right_span=right_span, how="inner").drop("_once", "_paired")


#: Sizes of buckets, in widths.
LEVELS = (1, 4, 16, 64)


def _placed(df: DataFrame, a: str, z: str, width: float) -> DataFrame:
    """A copy of each row for each place (``_p``): its beginning in every size, and where it lies."""
    place = lambda k, begins, b: F.struct(k.cast("int").alias("k"), F.lit(begins).alias("begins"), b.alias("b"))
    end = F.greatest(a, z)
    level = reduce(lambda c, k: F.when(end - F.col(a) <= width * LEVELS[k], k).otherwise(c), reversed(range(len(LEVELS) - 1)), F.lit(len(LEVELS) - 1))
    size = F.element_at(F.array(*[F.lit(float(width * n)) for n in LEVELS]), level + 1)
    begins = F.array(*[place(F.lit(k), True, F.floor(F.col(a) / (width * n))) for k, n in enumerate(LEVELS)])
    lies = F.transform(F.sequence(F.floor(F.col("_a") / F.col("_size")), F.floor(F.col("_z") / F.col("_size"))), lambda b: place(F.col("_level"), False, b))
    sized = df.withColumns({"_a": F.col(a), "_z": end, "_level": level, "_size": size})
    return sized.withColumn("_p", F.explode(F.concat(begins, F.coalesce(lies, F.slice(begins, 1, 0))))).drop("_a", "_z", "_level", "_size")


def _met(left: DataFrame, right: DataFrame, *, key: Sequence[str], width: float, left_span, right_span, how: str) -> DataFrame:
    """Pairs that overlap, each made once: where the later one begins. A beginning asks in its bucket of every size; an interval lies in
    buckets of the least size that it doesn't exceed, so in two of them, or in more of the largest. Of a row on the left without
    a partner (``how`` left) one copy has ``_once``."""
    (lf, lt), (rf, rt) = left_span, right_span

    r = _placed(right, rf, rt, width).withColumns({"_k": F.col("_p.k"), "_asked": ~F.col("_p.begins"), "_b": F.col("_p.b")}).drop("_p").withColumnsRenamed({c: f"_r_{c}" for c in key})
    l = _placed(left, lf, lt, width).withColumns({"_lk": F.col("_p.k"), "_begins": F.col("_p.begins"), "_lb": F.col("_p.b")}).drop("_p")
    same = reduce(lambda c, k: c & (F.col(k) == F.col(f"_r_{k}")), key, (F.col("_lk") == F.col("_k")) & (F.col("_begins") == F.col("_asked")) & (F.col("_lb") == F.col("_b")))
    later = F.when(F.col("_begins"), F.col(lf) >= F.col(rf)).otherwise(F.col(rf) > F.col(lf))
    pairs = l.join(r, same & later & (F.greatest(lf, rf) < F.least(lt, rt)), how)
    told = pairs.withColumns({"_paired": F.col("_k").isNotNull(), "_once": F.col("_begins") & (F.col("_lk") == 0)})
    return told.drop("_lk", "_begins", "_lb", "_k", "_asked", "_b", *[f"_r_{c}" for c in key])


def nearest(left: DataFrame, right: DataFrame, *, key: Sequence[str], left_time: str, left_id: str, right_time: str, right_id: str, within: float | None = None) -> DataFrame:
    """For each left row the right row nearest in time; ties go to the earlier one, then the smaller id.
    ``within`` is an inclusive limit beyond which there is no match (nulls)."""
    l = left.select(*key, F.col(left_time).cast("double").alias("_t"), F.lit(1).alias("_side"), F.col(left_id).alias("_id"), F.lit(None).cast(right.schema[right_id].dataType).alias("_r"))
    r = right.groupBy(*key, F.col(right_time).cast("double").alias("_t")).agg(F.min(right_id).alias("_r"))
    r = r.select(*key, "_t", F.lit(0).alias("_side"), F.lit(None).cast(left.schema[left_id].dataType).alias("_id"), "_r")
    # both frames end at the current row, so each is one running value; a right row at the same time counts as before
    w = Window.partitionBy(*key).orderBy("_t", "_side", "_id")
    back = Window.partitionBy(*key).orderBy(F.desc("_t"), F.desc("_side"), F.desc("_id"))
    here = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_r").alias("r")))
    merged = l.unionByName(r).withColumns({
        "_before": F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_after": F.last(here, True).over(back.rowsBetween(Window.unboundedPreceding, 0)),
    }).where("_side = 1")
    d0, d1 = F.col("_t") - F.col("_before.t"), F.col("_after.t") - F.col("_t")
    best = F.when(d0.isNull(), F.col("_after")).when(d1.isNull() | (d0 <= d1), F.col("_before")).otherwise(F.col("_after"))
    out = merged.select(*key, F.col("_id").alias(left_id), F.col("_t").alias(left_time), best.alias("_m"))
    close = F.lit(True) if within is None else F.abs(F.col("_m.t") - F.col(left_time)) <= within
    return out.select(*key, left_id, F.when(close, F.col("_m.r")).alias(right_id), F.when(close, F.col("_m.t")).alias("matched_time"), F.when(close, F.abs(F.col("_m.t") - F.col(left_time))).alias("distance"))


def best_overlap(old: DataFrame, new: DataFrame, *, key: Sequence[str], old_id: str, new_id: str, width: float, old_span=("t_start", "t_end"), new_span=("t_start", "t_end"), fall_back: bool = True) -> DataFrame:
    """For each old interval the new one that overlaps it most; ties go to the earliest in ``new_id`` order.
    Without any overlap the new interval of the nearest start is taken, if ``fall_back``."""
    l = old.select(*key, F.col(old_id).alias("_old"), F.col(old_span[0]).cast("double").alias("l_from"), F.col(old_span[1]).cast("double").alias("l_to"))
    r = new.select(*key, F.col(new_id).alias("_new"), F.col(new_span[0]).cast("double").alias("r_from"), F.col(new_span[1]).cast("double").alias("r_to"))
    # one join tells the best overlap and, as an outer one, who has none
    pairs = _met(l, r, key=key, width=width, left_span=("l_from", "l_to"), right_span=("r_from", "r_to"), how="left" if fall_back else "inner")
    pairs = pairs.where(F.col("_paired") | F.col("_once")).withColumn("overlap", F.when(F.col("_paired"), F.least("l_to", "r_to") - F.greatest("l_from", "r_from")))
    order = Window.partitionBy(*key, "_old").orderBy(F.col("overlap").desc_nulls_last(), "_new")
    if not fall_back:
        best = pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1")
        return best.select(*key, F.col("_old").alias(old_id), F.col("_new").alias(new_id), "overlap")
    alone = F.col("overlap").isNull() & (F.col("_rank") == 1)
    judged = pairs.withColumns({"_n": F.row_number().over(order), "_rank": F.rank().over(order)}).where(alone | (F.col("overlap").isNotNull() & (F.col("_n") == 1)))
    told = judged.select(*key, "l_from", F.struct("_old", "_new", "overlap").alias("_found"))
    near = nearest(told, r.select(*key, "r_from", F.col("_new").alias("_near")), key=key, left_time="l_from", left_id="_found", right_time="r_from", right_id="_near")
    out = near.select(*key, F.col("_found._old").alias(old_id), F.when(F.col("_found.overlap").isNotNull(), F.col("_found._new")).otherwise(F.col("_near")).alias(new_id), F.coalesce("_found.overlap", F.lit(0.0)).alias("overlap"))
    return out.where(F.col(new_id).isNotNull())


def outside_all(points: DataFrame, spans: DataFrame, *, key: Sequence[str], time: str, start: str, end: str, tolerance: float = 0.0) -> DataFrame:
    """The points of a key that no span ``[start - tolerance, end]`` contains. One sorted pass: a point is
    inside if the largest end among spans begun so far reaches it."""
    opened = spans.select(*key, (F.col(start) - tolerance).cast("double").alias("_t"), F.lit(0).alias("_side"), F.col(end).cast("double").alias("_end"), F.lit(None).alias("_row"))
    rows = points.select(*key, F.col(time).cast("double").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_end"), F.struct(*points.columns).alias("_row"))
    w = Window.partitionBy(*key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.unionByName(opened.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    return merged.withColumn("_reach", F.max("_end").over(w)).where("_side = 1 and (_reach is null or _reach < _t)").select("_row.*")


def in_windows(points: DataFrame, windows: DataFrame, *, key: Sequence[str], time: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the windows ``[start, end)`` that hold them, by buckets."""
    spread = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(start, end) / width))))
    return points.withColumn("_b", F.floor(F.col(time) / width)).join(spread, [*key, "_b"]).where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_b")


def first_anchor(sections: DataFrame, cues: DataFrame, *, key: Sequence[str], section_id: str, section_time: str, cue_id: str, cue_time: str, cue_text: str, before: float = 3.0, after: float = 18.0, least: int = 6) -> DataFrame:
    """For each section a cue from ``before`` ahead of it to ``after`` behind it: the first of at least
    ``least`` characters, else the first at all, else the first later cue of the key."""
    span = before + after
    near = sections.select(*key, section_id, F.col(section_time).alias("_s"), (F.col(section_time) - before).alias("_a"), (F.col(section_time) + after + 1e-9).alias("_z"))
    held = in_windows(cues, near, key=key, time=cue_time, start="_a", end="_z", width=span)
    rank = F.when(F.length(F.trim(cue_text)) >= least, 0).otherwise(1)
    chosen = held.groupBy(*key, section_id).agg(F.min_by(F.struct(cue_id, cue_time), F.struct(rank, F.col(cue_time), F.col(cue_id))).alias("_c"))
    found = sections.join(chosen, [*key, section_id], "left")
    later = nearest_later(found.where("_c is null").select(*key, section_id, section_time), cues, key=key, left_time=section_time, left_id=section_id, right_time=cue_time, right_id=cue_id)
    return found.join(later, [*key, section_id], "left").select(*key, section_id, F.coalesce("_c." + cue_id, "_later").alias(cue_id))


def nearest_later(left: DataFrame, right: DataFrame, *, key: Sequence[str], left_time: str, left_id: str, right_time: str, right_id: str) -> DataFrame:
    l = left.select(*key, F.col(left_time).cast("double").alias("_t"), F.lit(0).alias("_side"), F.col(left_id), F.lit(None).cast(right.schema[right_id].dataType).alias("_r"))
    r = right.select(*key, F.col(right_time).cast("double").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), F.col(right_id).alias("_r"))
    back = Window.partitionBy(*key).orderBy(F.desc("_t"), F.desc("_side"), F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return l.unionByName(r).withColumn("_later", F.last("_r", True).over(back)).where("_side = 0").select(*key, left_id, "_later")


def piecewise(points: DataFrame, sections: DataFrame, *, key: Sequence[str], time: str) -> DataFrame:
    """Map times on the clock of joined sections to the original's: add ``orig`` and ``window``. A section holds
    its first moment; times beyond the last section stay in it, times below zero in the first. ``sections`` has
    window, orig_from, media_from and media_to."""
    starts = sections.select(*key, F.col("media_from").cast("double").alias("_t"), F.lit(0).alias("_side"), F.struct("window", "orig_from", "media_from").alias("_s"))
    rows = points.select(*key, F.greatest(F.col(time).cast("double"), F.lit(0.0)).alias("_t"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_row"))
    merged = rows.withColumn("_s", F.lit(None).cast(starts.schema["_s"].dataType)).unionByName(starts.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    w = Window.partitionBy(*key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    held = merged.withColumn("_at", F.last("_s", True).over(w)).where("_side = 1")
    return held.select("_row.*", F.col("_at.window").alias("window"), (F.col("_at.orig_from") + F.col("_t") - F.col("_at.media_from")).alias("orig"))


def window_plan(durations: DataFrame, *, key: Sequence[str], duration: str = "duration", length: float = 30.0, anchors: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Sampling windows of ``length`` at the anchors' shares of the duration. A window that would overlap the
    one before is shifted right; what exceeds the end is moved back, and dropped if it no longer fits. A
    duration of at most one window is one window."""
    d = F.col(duration).cast("double")
    step = lambda acc, a: F.when(
        F.least(F.greatest(a * d - length / 2, F.lit(0.0), acc["end"]), d - length) >= acc["end"],
        F.struct(
            (F.least(F.greatest(a * d - length / 2, F.lit(0.0), acc["end"]), d - length) + length).alias("end"),
            F.concat(acc["out"], F.array(F.least(F.greatest(a * d - length / 2, F.lit(0.0), acc["end"]), d - length))).alias("out"),
        ),
    ).otherwise(acc)
    empty = F.struct(F.lit(0.0).alias("end"), F.array().cast("array<double>").alias("out"))
    starts = F.aggregate(F.array(*map(F.lit, map(float, anchors))), empty, step, lambda acc: acc["out"])
    planned = F.when(d <= length, F.array(F.lit(0.0))).otherwise(starts)
    rows = durations.where(d > 0).select(*key, d.alias("_d"), F.posexplode(planned).alias("window", "orig_from"))
    return rows.select(*key, "window", "orig_from", F.least(F.col("orig_from") + length, F.col("_d")).alias("orig_to"))


def per_window(points: DataFrame, windows: DataFrame, *, key: Sequence[str], time: str, value: Column | None = None) -> DataFrame:
    """Per window the number of points, their rate per minute and mean value; windows without points too."""
    held = in_windows(points, windows, key=key, time=time, start="orig_from", end="orig_to", width=60.0)
    found = held.groupBy(*key, "window").agg(F.count("*").alias("n"), F.avg(value if value is not None else F.lit(0.0)).alias("mean"))
    length = (F.col("orig_to") - F.col("orig_from")) / 60
    joined = windows.join(found, [*key, "window"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "mean": F.coalesce("mean", F.lit(0.0))})
    return joined.withColumn("per_min", F.when(length > 0, F.col("n") / length).otherwise(0.0))
