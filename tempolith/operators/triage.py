"""Additive evidence with reasons, per entity and per window: AGG-04 to AGG-06, WIN-25, ORC-16 to ORC-21, ORC-29."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The settings' names and defaults.
TRIAGE_DEFAULTS = {"cuts_per_min_high": 3.0, "cuts_per_min_low": 0.5, "freeze_ratio_page": 0.60, "motion_mean_high": 0.05}
SLIDES_WORDS = ["课件", "幻灯片", "PPT", "讲义", "白板"]
STREAM_WORDS = ["访谈", "播客", "口播", "直播", "聊天", "实录", "课堂", "滚动"]


def word_hits(df: DataFrame, *, texts: Sequence[str], lists: Sequence[str] = (), slides: Sequence[str] = SLIDES_WORDS, stream: Sequence[str] = STREAM_WORDS) -> DataFrame:
    """Add ``n_slides`` and ``n_stream``: how often a word of either kind is in a text field, or in an element of a list; a word counts once in each."""
    parts = F.concat(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in texts]), *[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists])
    hits = lambda words: F.aggregate(parts, F.lit(0), lambda n, x: n + sum((x.contains(w).cast("int") for w in words), F.lit(0)))
    return df.withColumns({"n_slides": hits(slides), "n_stream": hits(stream)})


def evidence(settings: dict[str, float] | None = None) -> list[tuple[Column, str, int, str]]:
    """One point for each side whose words occur (``n_slides``, ``n_stream``), and one for each measure beyond its threshold
    (``cuts_per_min``, ``freeze_ratio``, ``motion_mean``; nulls give none): many cuts and long stills are pages being turned, few cuts and steady motion a stream."""
    p = TRIAGE_DEFAULTS | (settings or {})
    return [
        (F.col("n_slides") > 0, "slides", 1, "words of pages"),
        (F.col("n_stream") > 0, "stream", 1, "words of streams"),
        (F.col("cuts_per_min") >= p["cuts_per_min_high"], "slides", 1, "many cuts"),
        (F.col("cuts_per_min") <= p["cuts_per_min_low"], "stream", 1, "hardly a cut"),
        (F.col("freeze_ratio") >= p["freeze_ratio_page"], "slides", 1, "mostly still"),
        (F.col("motion_mean") >= p["motion_mean_high"], "stream", 1, "always moving"),
    ]


def vote(df: DataFrame, evidence: Sequence[tuple[Column, str, int, str]], *, margin: int = 2, measured: Column | None = None) -> DataFrame:
    """Add slides, stream, suggest, confidence and reasons. ``evidence`` lists (condition, side, points, reason).
    Slides win by ``margin`` only; confidence grows with the difference, and stays at a half at most where
    nothing was ``measured``."""
    points = lambda side: sum((F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for c, s, p, _ in evidence if s == side), F.lit(0))
    scored = df.withColumns({"slides": points("slides"), "stream": points("stream")})
    lead = F.col("slides") - F.col("stream")
    confidence = F.round(F.least(F.lit(0.9), 0.4 + 0.15 * F.abs(lead)), 2)
    capped = confidence if measured is None else F.when(measured, confidence).otherwise(F.least(confidence, F.lit(0.5)))
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, _, _, r in evidence]))
    return scored.withColumns({"suggest": F.when(lead >= margin, "slides").otherwise("stream"), "confidence": capped, "reasons": reasons})


def window_verdicts(df: DataFrame, *, key: Sequence[str], cuts: Column, motion: Column, settings: dict[str, float] | None = None, margin: int = 2, slides: Column | None = None) -> DataFrame:
    """A verdict per window from its cuts a minute and mean motion (nulls count as 0), only for keys whose windows disagree. Cuts are counted by
    their own time. ``slides`` are more points for pages; without any a window's only one is short of the margin, so that all windows are streams."""
    p = TRIAGE_DEFAULTS | (settings or {})
    rate, moved = F.coalesce(cuts, F.lit(0.0)), F.coalesce(motion, F.lit(0.0))
    lead = (rate >= p["cuts_per_min_high"]).cast("int") + (F.lit(0) if slides is None else slides) - (rate <= p["cuts_per_min_low"]).cast("int") - (moved >= p["motion_mean_high"]).cast("int")
    judged = df.withColumn("suggest", F.when(lead >= margin, "slides").otherwise("stream"))
    mixed = judged.groupBy(*key).agg(F.count_distinct("suggest").alias("_k")).where("_k > 1").select(*key)
    return judged.join(mixed, list(key), "left_semi")


def preferred_measure(sampled: DataFrame, full: DataFrame, *, key: Sequence[str], columns: Sequence[str], entities: DataFrame) -> DataFrame:
    """The sampled measurement, else the full one, else none with a reason."""
    s = sampled.select(*key, F.struct(*columns).alias("_s"))
    f = full.select(*key, F.struct(*columns).alias("_f"))
    both = entities.select(*key).join(s, list(key), "left").join(f, list(key), "left").withColumn("_m", F.coalesce("_s", "_f"))
    source = F.when(F.col("_s").isNotNull(), "sample").when(F.col("_f").isNotNull(), "full").otherwise("insufficient")
    return both.select(*key, "_m.*", source.alias("source"), F.when(F.col("_m").isNull(), "no measurement").alias("reason"))


def hint_line(slides: Column, stream: Column) -> Column:
    """A tie means stream."""
    return F.when(slides > stream, F.concat(F.lit("slides likely ("), slides.cast("string"), F.lit(":"), stream.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("stream likely ("), slides.cast("string"), F.lit(":"), stream.cast("string"), F.lit(")")))


def effective_mode(explicit: Column, suggested: Column) -> Column:
    """The mode asked for wins; ``conflict`` tells if the hint says otherwise."""
    return F.struct(F.coalesce(explicit, suggested).alias("mode"), (explicit.isNotNull() & suggested.isNotNull() & (explicit != suggested)).alias("conflict"))


def applicable(ok: Column, reason: Column) -> Column:
    """``ok`` or ``insufficient`` with the reason kept: an unmatched verdict is a row, not an absence."""
    return F.struct(F.when(ok, "ok").otherwise("insufficient").alias("applicability"), F.when(~F.coalesce(ok, F.lit(False)), reason).alias("reason"))
