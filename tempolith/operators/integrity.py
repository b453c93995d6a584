"""Rules as queries: every rule yields rows of issues (level, owner, chapter, code, detail); a validation is
their union. J-07, J-09 to J-14, SET-06 to SET-08, PRJ-12, PRJ-14, PRJ-16, NST-02, STA-10, STA-11, V-01 to V-50.

Rules take table and column names, so they run on any tables with keys, intervals and references. None
collects; orderings are within keys; references are checked by anti joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import unknown_targets, visible_length

ISSUE = ["level", "owner", "chapter", "code", "detail"]


def issues(df: DataFrame, *, level: str, code: str, key: Sequence[str] = ("vid",), owner: Column | None = None, chapter: Column | None = None, detail: Column | None = None) -> DataFrame:
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    owned = owner if owner is not None else F.concat(F.lit("chapter:"), chapter.cast("string")) if chapter is not None else F.lit("manifest")
    return df.select(*key, F.lit(level).alias("level"), text(owned).alias("owner"), text(chapter).alias("chapter"), F.lit(code).alias("code"), text(detail).alias("detail"))


def found_issue(when: Column, *, level: str, code: str | Column, detail: Column | None = None, path: Column | None = None) -> Column:
    """An issue as a struct where ``when`` holds, else null; ``path`` is a file that it waits for."""
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    name = F.lit(code) if isinstance(code, str) else code
    return F.when(when, F.struct(F.lit(level).alias("level"), name.alias("code"), text(detail).alias("detail"), text(path).alias("path")))


def each_issue(df: DataFrame, found: Sequence[Column], *, key: Sequence[str] = ("vid",), chapter: Column) -> DataFrame:
    """The issues of every row in one pass, with the path that each waits for (``_path``); ``found`` are structs of ``found_issue`` or arrays of them."""
    told = [c if many else F.array(c) for c, many in ((c, df.select(c).schema[0].dataType.typeName() == "array") for c in found)]
    every = F.array_compact(F.flatten(F.array_compact(F.array(*told))))
    name = chapter.cast("string")
    rows = df.select(*key, name.alias("chapter"), F.explode(every).alias("_i"))
    return rows.select(*key, "_i.level", F.concat(F.lit("chapter:"), "chapter").alias("owner"), "chapter", "_i.code", "_i.detail", F.col("_i.path").alias("_path"))


def union(rules: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rules)


# --- shapes of rules -------------------------------------------------------------------------------------------


def duplicates(df: DataFrame, *, key: Sequence[str], of: Sequence[str]) -> DataFrame:
    return df.groupBy(*key, *of).agg(F.count("*").alias("n")).where("n > 1")


def missing(df: DataFrame, known: DataFrame, *, on: Sequence[str]) -> DataFrame:
    """Rows whose reference is not known; null references are not references."""
    filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    return df.where(filled).join(known.select(*on), list(on), "left_anti")


def blank_fields(df: DataFrame, fields: Sequence[str], *, key: Sequence[str]) -> DataFrame:
    """One row per field that is null or, as text or array, empty."""
    return df.select(*key, F.explode(F.array_compact(F.array(*[F.when(_blank(df, c), F.lit(c)) for c in fields]))).alias("field"))


def _blank(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return F.col(c).isNull() | (F.trim(c) == "" if kind == "string" else F.size(c) == 0 if kind.startswith("array") else F.lit(False))


def overlapping(df: DataFrame, *, key: Sequence[str], order: Sequence[str], start: str, end: str, tolerance: float = 0.0) -> DataFrame:
    """Rows that begin before the largest end of all earlier rows, less the tolerance."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("reached", F.max(end).over(w)).where(F.col(start) < F.col("reached") - tolerance)


def inverted(df: DataFrame, *, start: str, end: str) -> DataFrame:
    return df.where(F.col(end) <= F.col(start))


def not_contiguous(df: DataFrame, *, key: Sequence[str], order: Sequence[str], first: str, last: str) -> DataFrame:
    """Rows whose first number doesn't follow the previous row's last, and first rows that don't begin at 1."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("expected", F.coalesce(F.lag(last).over(w), F.lit(0)) + 1).where(F.col(first) != F.col("expected"))


def not_monotonic(df: DataFrame, *, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("before", F.lag(value).over(w)).where(F.col(value) <= F.col("before"))


def uncovered_ordinals(anchors: DataFrame, items: DataFrame, *, key: Sequence[str], ordinal: str) -> DataFrame:
    """Ordinals that no anchor covers: an anchor covers from itself up to the next one, so only those before the
    first anchor of their key are left."""
    first = anchors.groupBy(*key).agg(F.min(ordinal).alias("_first"))
    return items.join(first, list(key), "left").where(F.col("_first").isNull() | (F.col(ordinal) < F.col("_first"))).drop("_first")


def unused_numbers(counts: DataFrame, used: DataFrame, *, key: Sequence[str], count: str, number: str) -> DataFrame:
    """1 to the key's count except what is used."""
    every = counts.select(*key, F.explode(F.when(F.col(count) > 0, F.sequence(F.lit(1), F.col(count).cast("int")))).alias(number))
    every = every.withColumn(number, F.col(number).cast(used.schema[number].dataType))
    return every.join(used.select(*key, number), [*key, number], "left_anti")


def full_compare(left: DataFrame, right: DataFrame, *, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of either side without a partner or with other values: ``state`` is missing, extra or differs."""
    l = left.select(*on, F.struct(*columns).alias("_l"), F.lit(1).alias("_a"))
    r = right.select(*on, F.struct(*columns).alias("_r"), F.lit(1).alias("_z"))
    both = l.join(r, list(on), "full")
    state = F.when(F.col("_z").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("_l").eqNullSafe(F.col("_r")), "differs")
    return both.select(*on, state.alias("state")).where("state is not null")


def scoped(found: DataFrame, chapters: Sequence[str]) -> DataFrame:
    """Issues of the given chapters only; unknown ones never match."""
    return found.where(F.col("chapter").isin([c for c in chapters if c != "?"]))


def for_owner(found: DataFrame, owner: str) -> DataFrame:
    return found.where(F.col("level").isin("error", "review") & (F.col("owner") == owner))


def reader_flags() -> Column:
    """Corrections made from context, plus uncertainties."""
    return F.size(F.filter("corrections", lambda c: F.lower(c["basis"]) == "context")) + F.size("uncertainties")


# --- the manifest of chapters -----------------------------------------------------------------------------------

REQUIRED = ("title", "range", "slides", "body", "keypoints", "questions", "coverage_notes")
TIME = r"^\d{2}:[0-5]\d:[0-5]\d$"


def manifest_rules(manifests: DataFrame, chapters: DataFrame, slides: DataFrame, cues: DataFrame, files: DataFrame, *, schema: str = "chapters/1", tolerance: float = 1.0, keypoints_min: int = 2, tail: float = 5.0) -> DataFrame:
    """V-01 to V-22 and V-30 to V-32.

    manifests(vid, schema, video_ok, slide_count, duration), chapters(as in the data model), slides(vid, id),
    cues(vid, seq, t_from), files(vid, path, text).
    """
    from ..functions.times import seconds_of
    from .temporal import outside_all

    key = ["vid"]
    start, end = seconds_of(F.get("range", F.lit(0))), seconds_of(F.get("range", F.lit(1)))
    timed = chapters.withColumns({"well": (F.size("range") == 2) & F.forall("range", lambda x: x.rlike(TIME)), "a": start, "z": end})
    good = timed.where("well")
    counts = slides.groupBy("vid").agg(F.count("*").alias("n_slides"), F.max("id").alias("max_slide"))
    known = counts.select("vid", "n_slides")
    used = chapters.select("vid", "id", F.explode("slides").alias("slide"))
    numbered = used.join(manifests.select("vid", "slide_count"), "vid")
    last = good.groupBy("vid").agg(F.max("z").alias("z")).join(manifests.select("vid", "duration"), "vid")
    lost = outside_all(cues.withColumn("t", F.floor("t_from")), good, key=key, time="t", start="a", end="z", tolerance=tolerance)
    e, ch = "error", F.col("id")
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    wrong = F.filter("corrections", lambda c: empty(c["wrong"]) | empty(c["right"]) | empty(c["evidence"]))
    astray = F.filter("stage_merges", lambda m: (F.size(F.array_except(m["slides"], "slides")) > 0) | ~F.array_contains(m["slides"], m["kept"]))
    # what a chapter tells by itself, and against the chapters that begin before it (other rows add no end)
    earlier = Window.partitionBy(*key).orderBy("a", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = timed.withColumn("reached", F.max(F.when(F.col("well"), F.col("z"))).over(earlier))
    own = each_issue(placed, [
        *[found_issue(_blank(chapters, c), level=e, code="V-07", detail=F.lit(c)) for c in REQUIRED],
        found_issue(~F.col("well"), level=e, code="V-08"),
        found_issue(F.col("well") & (F.col("z") <= F.col("a")), level=e, code="V-09"),
        found_issue(F.col("well") & (F.col("a") < F.col("reached") - tolerance), level=e, code="V-10"),
        found_issue((F.size("keypoints") < keypoints_min) | (F.size("questions") < 1), level=e, code="V-18"),
        F.transform(wrong, lambda c: found_issue(F.lit(True), level=e, code="V-30")),
        F.transform(astray, lambda m: found_issue(F.lit(True), level=e, code="V-31")),
        found_issue(F.coalesce(F.size("keypoints"), F.lit(0)) < 1, level="warning", code="V-32"),
    ], chapter=ch)
    # what a body tells; of the files that it names those stay that aren't there, and an issue without a path always does
    bodies = chapters.select("vid", "id", F.concat(F.lit("chapters/"), "body").alias("path")).join(files, ["vid", "path"], "left")
    text = F.col("text")
    named = F.regexp_extract_all("text", F.lit(r"\]\((?:\.\./)*((?:slides|sheets|figures)/[^)\s]+)\)"), F.lit(1))
    missed = lambda p: F.when(p.startswith("slides/"), "V-13").otherwise("V-16")
    told = each_issue(bodies, [
        found_issue(text.isNull() | (F.trim("text") == "") | text.rlike(r"^---\n") | text.rlike(r"(?m)^<!--\s*meta"), level=e, code="V-11"),
        found_issue(text.isNotNull() & ~text.rlike(r"\]\([^)]*slides/\d+"), level=e, code="V-12"),
        F.transform(unknown_targets(text), lambda t: found_issue(F.lit(True), level=e, code="V-15", detail=t)),
        F.transform(named, lambda p: found_issue(F.lit(True), level=e, code=missed(p), detail=p, path=p)),
    ], chapter=ch)
    there = files.select("vid", F.col("path").alias("_path"))
    rules = [
        issues(chapters.select("vid").distinct().join(manifests.select("vid"), "vid", "left_anti"), level=e, code="V-01"),
        issues(manifests.where(F.coalesce(F.col("schema") != schema, F.lit(True))), level=e, code="V-02", detail=F.col("schema")),
        issues(manifests.where(~F.coalesce("video_ok", F.lit(False))), level=e, code="V-03"),
        issues(manifests.join(chapters.select("vid").distinct(), "vid", "left_anti"), level=e, code="V-04"),
        issues(manifests.join(known, "vid", "left").where(F.col("slide_count") != F.coalesce("n_slides", F.lit(0))), level=e, code="V-05", detail=F.col("slide_count")),
        issues(duplicates(chapters, key=key, of=["id"]), level=e, code="V-06", chapter=ch, detail=F.col("n")),
        own.drop("_path"),
        told.join(there, ["vid", "_path"], "left_anti").select("vid", *ISSUE),
        issues(numbered.where(~F.col("slide").between(1, F.col("slide_count"))), level=e, code="V-19", chapter=ch, detail=F.col("slide")),
        issues(last.where(F.col("z") < F.col("duration") - tail), level=e, code="V-20", detail=F.col("z")),
        issues(lost, level=e, code="V-21", detail=F.col("seq")),
        issues(unused_numbers(counts.select("vid", "max_slide"), used, key=key, count="max_slide", number="slide"), level="warning", code="V-22", detail=F.col("slide")),
    ]
    return union(rules)


def resolution_rules(refs: DataFrame, annotations: DataFrame, chapters: DataFrame, roles: DataFrame, overlays: DataFrame, videos: DataFrame, *, page_roles: Sequence[str] = ("full_page", "zoom_detail")) -> DataFrame:
    """V-14 unresolved references, V-17 missing annotations, V-24 missing region analysis, V-25 role priority.

    refs(vid, id, target, status) as ``resolved_references`` gives them, annotations(vid, id, annotations),
    roles(vid, segment, chosen, role of each candidate as an array ``candidates``), overlays(vid), videos(vid).
    """
    needed = chapters.select("vid", "id", reader_flags().alias("needed")).join(annotations, ["vid", "id"], "left")
    allowed = F.array(*map(F.lit, page_roles))
    other = ~F.array_contains(allowed, F.col("chosen"))
    has = F.arrays_overlap("candidates", allowed)
    return union([
        issues(refs.where("status = 'missing'").select("vid", "id", "target").distinct(), level="error", code="V-14", chapter=F.col("id"), detail=F.col("target")),
        issues(needed.where(F.coalesce("annotations", F.lit(0)) < F.col("needed")), level="error", code="V-17", chapter=F.col("id")),
        issues(videos.join(overlays.select("vid"), "vid", "left_anti"), level="warning", code="V-24", owner=F.lit("pipeline")),
        issues(roles.where(other & has), level="error", code="V-25", owner=F.lit("pipeline"), detail=F.col("segment")),
        issues(roles.where(F.col("chosen").isNull() | (other & ~F.coalesce(has, F.lit(False)))), level="warning", code="V-25", owner=F.lit("pipeline"), detail=F.col("segment")),
    ])


def slideset_rules(top: DataFrame, chapters: DataFrame, pages: DataFrame, current: DataFrame, current_pages: DataFrame) -> DataFrame:
    """V-23: recorded against current digests of the set, of chapters and of pages.

    top(vid, digest), chapters(vid, id, digest), pages(vid, page, digest), current(vid, digest),
    current_pages(vid, page, digest)."""
    now = current.select("vid", F.col("digest").alias("now"))
    moved = lambda df: df.join(now, "vid").where(F.col("digest").isNotNull() & (F.col("digest") != F.col("now")))
    drift = full_compare(pages, current_pages, on=["vid", "page"], columns=["digest"])
    return union([
        issues(moved(top), level="error", code="V-23-set"),
        issues(moved(chapters), level="error", code="V-23-chapter", chapter=F.col("id")),
        issues(chapters.where("digest is null"), level="warning", code="V-23-unstamped", chapter=F.col("id")),
        issues(drift.where("state <> 'extra'"), level="error", code="V-23-page", detail=F.concat_ws(":", "page", "state")),
    ])


def section_rules(sections: DataFrame, spans: DataFrame, slides: DataFrame, files: DataFrame, *, tolerance: float = 1.0) -> DataFrame:
    """V-26 to V-29. sections(vid, chapter, ord, title, time_line, raw_time, raw_slides, images) as
    ``markup.sections`` gives them, spans(vid, chapter, t_start, t_end, slides), slides(vid, id), files(vid, path)."""
    ch = F.col("chapter")
    placed = sections.join(spans, ["vid", "chapter"]).withColumns({"a": F.col("raw_time.a"), "z": F.col("raw_time.b")})
    timed = placed.where("raw_time is not null")
    shown = placed.select("vid", "chapter", "slides", F.explode("raw_slides").alias("id"))
    pictured = placed.select("vid", "chapter", "slides", F.explode("images").alias("i")).select("vid", "chapter", "slides", F.col("i.page").alias("id"))
    path = F.concat(F.lit("slides/"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(".jpg"))
    return union([
        issues(sections.where("time_line is null"), level="error", code="V-26-missing", chapter=ch, detail=F.col("title")),
        issues(sections.where(F.col("time_line").rlike(r"\{\{|\bTODO\b")), level="error", code="V-26-unexpanded", chapter=ch, detail=F.col("title")),
        issues(sections.where("time_line is not null and raw_time is null"), level="error", code="V-26-format", chapter=ch, detail=F.col("title")),
        issues(timed.where("z <= a"), level="error", code="V-27-inverted", chapter=ch, detail=F.col("title")),
        issues(timed.where((F.col("a") < F.col("t_start") - tolerance) | (F.col("z") > F.col("t_end") + tolerance)), level="error", code="V-27-outside", chapter=ch, detail=F.col("title")),
        issues(overlapping(timed, key=["vid", "chapter"], order=["ord"], start="a", end="z"), level="error", code="V-27-overlap", chapter=ch, detail=F.col("title")),
        issues(missing(shown, slides, on=["vid", "id"]), level="error", code="V-28-unknown", chapter=ch, detail=F.col("id")),
        issues(shown.where(~F.array_contains("slides", F.col("id"))), level="error", code="V-28-foreign", chapter=ch, detail=F.col("id")),
        issues(missing(pictured.withColumn("path", path), files, on=["vid", "path"]), level="error", code="V-28-picture", chapter=ch, detail=F.col("id")),
        issues(pictured.where(~F.array_contains("slides", F.col("id"))), level="error", code="V-28-picture-foreign", chapter=ch, detail=F.col("id")),
        issues(placed.where((F.size("images") > 1) & F.col("time_line").isNull()), level="error", code="V-29", chapter=ch, detail=F.col("title")),
    ])


def stream_rules(
    videos: DataFrame, paragraphs: DataFrame, anchors: DataFrame, captions: DataFrame, bodies: DataFrame, refs: DataFrame, registry: DataFrame, *, least_ratio: float = 0.7, quota: int = 4
) -> DataFrame:
    """V-33 to V-41 and V-43. videos(vid, duration), paragraphs(vid, id, t_start, t_end, seg_from, seg_to, chars),
    anchors(vid, ord, t), captions(vid, coverage, partial), bodies(vid, text), refs(vid, path), registry(vid, path)."""
    key = ["vid"]
    starts = paragraphs.select("vid", F.col("t_start").alias("t"), F.col("id").alias("para"))
    placed = anchors.join(starts.groupBy("vid", "t").agg(F.min("para").alias("para")), ["vid", "t"], "left")
    said = paragraphs.groupBy("vid").agg(F.sum("chars").alias("said"), F.max("t_end").alias("t_end"), F.count("*").alias("paras"))
    written = bodies.select("vid", visible_length(F.col("text")).alias("written")).join(said, "vid")
    tally = said.join(anchors.groupBy("vid").agg(F.count("*").alias("n")), "vid", "left")
    w = lambda df, code, **k: issues(df, level="warning", code=code, owner=F.lit("stream"), **k)
    e = lambda df, code, **k: issues(df, level="error", code=code, owner=F.lit("stream"), **k)
    return union([
        e(not_contiguous(paragraphs, key=key, order=["id"], first="seg_from", last="seg_to"), "V-33", detail=F.col("id")),
        e(overlapping(paragraphs, key=key, order=["id"], start="t_start", end="t_end").unionByName(inverted(paragraphs, start="t_start", end="t_end").withColumn("reached", F.lit(None).cast("int")), allowMissingColumns=True), "V-34", detail=F.col("id")),
        e(placed.where("para is null"), "V-35", detail=F.col("t")),
        e(not_monotonic(anchors, key=key, order=["ord"], value="t"), "V-36", detail=F.col("ord")),
        e(uncovered_ordinals(placed.where("para is not null"), starts, key=key, ordinal="para"), "V-37-uncovered", detail=F.col("para")),
        e(duplicates(placed.where("para is not null"), key=key, of=["para"]), "V-37-duplicate", detail=F.col("para")),
        w(written.where(F.col("written") < least_ratio * F.col("said")), "V-38"),
        w(said.join(videos, "vid").where(F.col("t_end") > 1.05 * F.col("duration")), "V-39"),
        w(captions.where(F.coalesce("partial", F.lit(False)) | (F.col("coverage") < 0.8)), "V-40"),
        w(tally.where(F.coalesce("n", F.lit(0)) < F.col("paras") / 2), "V-41"),
        e(missing(refs.distinct(), registry, on=["vid", "path"]), "V-43", detail=F.col("path")),
        w(refs.groupBy("vid").agg(F.count_distinct("path").alias("n")).where(F.col("n") > quota), "V-43-quota", detail=F.col("n")),
    ])


def drift_rule(anchored: DataFrame, paragraphs: DataFrame, **bounds: int) -> DataFrame:
    """V-42: a section under an anchor begins like one of the few paragraphs before its own. anchored(vid, para, text),
    paragraphs(vid, id, text); ``bounds`` as ``readings.drifting_anchors`` has them."""
    from .readings import drifting_anchors

    return issues(drifting_anchors(anchored, paragraphs, **bounds), level="warning", code="V-42", owner=F.lit("stream"), detail=F.col("para"))


def note_rules(nodes: DataFrame, notes: DataFrame, heads: DataFrame, *, labels: Sequence[str], required: str, head: str, tail: str, least: int = 6, most: int = 30, ratio: float = 0.2, chars: int = 400) -> DataFrame:
    """V-44 to V-47. nodes as ``markup.note_nodes`` gives them, notes(vid, text, lecture_chars), heads(vid, title)."""
    from ..functions.times import seconds_of

    note = F.lit("note")
    has = lambda t: notes.join(heads.where(F.col("title") == t).select("vid").distinct(), "vid", "left_anti")
    tally = notes.join(nodes.groupBy("vid").agg(F.count("*").alias("n")), "vid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    timed = nodes.withColumn("t", seconds_of(F.col("time")))
    extra = nodes.select("vid", "ord", F.explode(F.array_except(F.map_keys("fields"), F.array(*map(F.lit, labels)))).alias("label"))
    size = visible_length(F.col("text"))
    e, w = "error", "warning"
    return union([
        issues(has(head), level=e, code="V-44-head", owner=note),
        issues(has(tail), level=w, code="V-44-tail", owner=note),
        issues(tally.where(F.col("n") < least), level=e, code="V-45-few", owner=note, detail=F.col("n")),
        issues(tally.where(F.col("n") > most), level=w, code="V-45-many", owner=note, detail=F.col("n")),
        issues(not_monotonic(timed, key=["vid"], order=["ord"], value="t"), level=e, code="V-46-order", owner=note, detail=F.col("ord")),
        issues(nodes.where(~F.map_contains_key("fields", required)), level=e, code="V-46-required", owner=note, detail=F.col("ord")),
        issues(extra, level=e, code="V-46-unknown", owner=note, detail=F.col("label")),
        issues(notes.where((F.col("lecture_chars") > 0) & (size > ratio * F.col("lecture_chars"))), level=w, code="V-47-long", owner=note),
        issues(notes.where(size < chars), level=w, code="V-47-short", owner=note),
    ])


def sample_rules(samples: DataFrame, windows: DataFrame, frames: DataFrame, *, duration_tolerance: float = 0.5, first_tolerance: float = 1.0) -> DataFrame:
    """V-49: drift of the duration, empty windows, a first frame that is late. samples(vid, planned, measured),
    windows(vid, window, orig_from), frames(vid, window, t on the original's clock)."""
    firsts = windows.join(frames.groupBy("vid", "window").agg(F.min("t").alias("first"), F.count("*").alias("n")), ["vid", "window"], "left")
    pipeline = F.lit("pipeline")
    return union([
        issues(samples.where(F.abs(F.col("planned") - F.col("measured")) > duration_tolerance), level="abort", code="V-49-duration", owner=pipeline),
        issues(firsts.where("n is null"), level="abort", code="V-49-empty", owner=pipeline, detail=F.col("window")),
        issues(firsts.where(F.abs(F.col("first") - F.col("orig_from")) > first_tolerance), level="abort", code="V-49-first", owner=pipeline, detail=F.col("window")),
    ])


def tile_rules(tiles: DataFrame, frames: DataFrame, sheets: DataFrame, *, cols: int = 3, rows: int = 4, slack: float = 1e-3) -> DataFrame:
    """V-50: a tile map against its frames and sheets. tiles(vid, index, sheet, tile_row, tile_col, t, frame,
    sha256, window), frames(vid, frame, t, sha256, window), sheets(vid, sheet)."""
    key, pipeline = ["vid"], F.lit("pipeline")
    found = tiles.join(frames.select("vid", "frame", F.col("t").alias("ft"), F.col("sha256").alias("fsha"), F.col("window").alias("fw")), ["vid", "frame"], "left")
    place = (F.col("sheet") - 1) * cols * rows + (F.col("tile_row") - 1) * cols + F.col("tile_col")
    n = F.col("index")
    rule = lambda df, code, detail=n: issues(df, level="abort", code=f"V-50-{code}", owner=pipeline, detail=detail)
    return union([
        rule(duplicates(tiles, key=key, of=["index"]), "twice"),
        rule(not_contiguous(tiles, key=key, order=["index"], first="index", last="index"), "gap"),
        rule(tiles.where(place != n), "place"),
        rule(tiles.where(~F.col("tile_row").between(1, rows)), "row"),
        rule(tiles.where(~F.col("tile_col").between(1, cols)), "col"),
        rule(missing(tiles, sheets, on=["vid", "sheet"]), "sheet"),
        rule(sheets.join(tiles.select("vid", "sheet"), ["vid", "sheet"], "left_anti"), "empty", F.col("sheet")),
        rule(found.where("ft is null"), "frame"),
        rule(found.where(F.abs(F.col("t") - F.col("ft")) > slack), "time"),
        rule(found.where("sha256 <> fsha"), "hash"),
        rule(found.where(~F.col("window").eqNullSafe(F.col("fw")) & F.col("ft").isNotNull()), "window"),
        rule(not_monotonic(tiles, key=key, order=["index"], value="t"), "order"),
    ])


def finding_rules(findings: DataFrame, owners: dict[str, str]) -> DataFrame:
    """V-48: review findings that are rejected."""
    from .state import ingested_findings

    return issues(ingested_findings(findings, owners)[1], level="reject", code="V-48", owner=F.col("owner"), detail=F.col("reason"))
