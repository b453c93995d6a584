"""Command-like compositions over all entities at once: CMD-01, CMD-03, CMD-05, CMD-07 to CMD-09, CMD-11, CMD-12, CMD-20, CMD-21,
CMD-23 to CMD-25, CMD-27, ORC-01, ORC-08, SNK-13, SNK-18, WIN-26.

Each function takes tables and returns tables. Fetching, logging in, prompts and pixels are not queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..operators import assemble, folds, integrity, markup, pick, sequences, state, temporal, triage, vision

KEY = ["vid"]


def stream(transcript: DataFrame, *, cap: int = 6000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Captions to (transcript texts, paragraphs, chunks)."""
    text = assemble.transcript(transcript, key=KEY, order=["seq"], time="t_from", text="text")
    paras = folds.paragraphs(transcript, key=KEY, order="seq", start="t_from", end="t_to", text="text")
    placed = folds.greedy_chunks(paras, key=KEY, order=["id"], size="chars", cap=cap)
    chunks = paras.join(placed.select("vid", "id", "chunk"), ["vid", "id"]).groupBy("vid", F.col("chunk").alias("no")).agg(
        F.min("id").alias("para_from"), F.max("id").alias("para_to"), F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.sum("chars").alias("chars")
    )
    return text, paras, chunks


def slides(frames: DataFrame, cues: DataFrame, *, fps: float = 2.0, page_roles: tuple[str, ...] = ("full_page", "zoom_detail"), snap: float = 3.0) -> DataFrame:
    """Frames (vid, i from 0, t, file, diff, ink, sharp, dhash, text, role) to pages: segments of the axis, the best
    face of each with the role priority, same-page merges, starts snapped to cue starts."""
    axis = folds.segment_axis(frames, key=KEY, fps=fps)
    spans = axis.select("vid", "id", F.col("i_start").alias("a"), F.col("i_end").alias("z"))
    held = temporal.in_windows(frames, spans, key=KEY, time="i", start="a", end="z", width=256.0)
    n = F.length(F.coalesce("text", F.lit("")))
    place = (F.col("i") - F.col("a")) / F.greatest(F.col("z") - F.col("a"), F.lit(1))
    scored = held.withColumn("score", pick.candidate_score(n, F.col("ink"), F.col("sharp"), place)).where("t is not null")
    allowed = F.col("role").isin(*page_roles)
    face = F.struct("t", "file", "score", "dhash", "text", "role")
    order = F.struct("score", (-F.col("i")).alias("i"))
    best = scored.groupBy("vid", "id").agg(
        F.min("t").alias("t_start"), F.max("t").alias("t_last"), F.count("*").cast("int").alias("n_frames"),
        F.coalesce(F.max_by(F.when(allowed, face), F.when(allowed, order)), F.max_by(face, order)).alias("c"),
    )
    ends = F.lead("t_start").over(Window.partitionBy("vid").orderBy("id"))
    raw = best.select("vid", "id", "t_start", F.coalesce(ends, F.col("t_last") + 1.0 / fps).alias("t_end"), "n_frames", F.col("c.score").alias("score"), F.col("c.dhash").alias("dhash"), F.coalesce("c.text", F.lit("")).alias("text"))
    pages = folds.merge_pages(raw, key=KEY)
    near = temporal.nearest(pages.select("vid", "id", "t_start"), cues.select("vid", "seq", F.col("t_from").alias("_c")), key=KEY, left_time="t_start", left_id="id", right_time="_c", right_id="seq", within=snap)
    joined = pages.join(near.select("vid", "id", "matched_time"), ["vid", "id"], "left")
    w = Window.partitionBy("vid").orderBy("id")
    snapped = F.when((F.col("id") > 1) & (F.col("matched_time") > F.lag("t_start").over(w)), F.col("matched_time")).otherwise(F.col("t_start"))
    moved = joined.withColumn("raw_t_start", F.col("t_start")).withColumn("t_start", snapped).drop("matched_time")
    faces = best.select("vid", F.col("id").alias("source_id"), F.col("c.file").alias("frame"), F.col("c.t").alias("chosen_t"), F.col("c.role").alias("role"))
    out = moved.withColumn("t_end", F.least("t_end", F.coalesce(F.lead("t_start").over(w), F.col("t_end"))))
    return out.join(faces, ["vid", "source_id"], "left")


def slideset(pages: DataFrame, files: DataFrame) -> DataFrame:
    """The identity of each entity's set of pages: stable columns only, three decimals."""
    rows = pages.join(files.select("vid", F.col("path").alias("frame"), "sha256"), ["vid", "frame"], "left")
    fixed = lambda c: F.format_string("%.3f", F.bround(c, 3).cast("double"))
    return assemble.canonical_digest(rows, key=KEY, order=["id"], fields=[F.col("id"), fixed(F.col("t_start")), fixed(F.col("t_end")), F.col("frame"), fixed(F.col("chosen_t")), F.col("sha256")], version="slideset/1")


def measure(lines: DataFrame, durations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A measurement log to (buckets, events, ratios)."""
    rows = markup.measurement_rows(lines, key=KEY, names=["lavfi.scd.mafd", "lavfi.scd.score"])
    buckets = sequences.buckets(rows.withColumns({"mafd": F.coalesce("mafd", F.lit(0.0)), "score": F.coalesce("score", F.lit(0.0))}), key=KEY, time="t", value="mafd", score="score", duration=durations)
    found = None
    for name in ("freeze", "silence"):
        marks = markup.log_events(lines, key=KEY, name=name).join(durations, "vid")
        pairs = sequences.paired_events(marks, key=KEY, order=["line_no"], time="t", kind="kind", opening="start", closing="end", duration="duration").withColumn("kind", F.lit(name))
        found = pairs if found is None else found.unionByName(pairs)
    cuts = rows.where("score >= 8").select("vid", F.col("t").alias("t_from"), F.col("t").alias("t_to"), F.lit(0.0).alias("dur"), F.lit("cut").alias("kind"))
    events = found.unionByName(cuts)
    share = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("dur"))), F.lit(0.0)) / F.max("duration")
    ratios = durations.join(events, "vid", "left").groupBy("vid").agg(F.count(F.when(F.col("kind") == "cut", 1)).alias("n_cuts"), share("freeze").alias("freeze_ratio"), share("silence").alias("silence_ratio"))
    motion = buckets.groupBy("vid").agg(F.avg("mean").alias("motion_mean"))
    return buckets, events, ratios.join(motion, "vid", "left")


def triaged(meta: DataFrame, ratios: DataFrame, *, texts=("title",), lists=(), settings: dict[str, float] | None = None, **words) -> DataFrame:
    """A mode per entity from words of its fields and measured cuts, stills and motion; without a measurement confidence is capped."""
    hits = triage.word_hits(meta, texts=texts, lists=lists, **words)
    both = hits.join(ratios, "vid", "left").withColumn("cuts_per_min", F.when(F.col("duration") > 0, F.col("n_cuts") / (F.col("duration") / 60)))
    return triage.vote(both, triage.evidence(settings), measured=F.col("n_cuts").isNotNull())


def sampled(durations: DataFrame, *, length: float = 30.0) -> DataFrame:
    """Window plan with both clocks."""
    plan = temporal.window_plan(durations, key=KEY, length=length)
    return sequences.running_offsets(plan, key=KEY, order=["window"], start="orig_from", end="orig_to")


def key_stills(frames: DataFrame, windows: DataFrame, *, most: int = 4, least: float = 0.02) -> DataFrame:
    """Per window the frame of the largest change (its first frame if nothing changed enough), without near
    copies, with the reason of what was skipped."""
    held = temporal.in_windows(frames, windows, key=KEY, time="t", start="orig_from", end="orig_to", width=60.0)
    best = held.groupBy("vid", "window").agg(F.max_by(F.struct("t", "file", "dhash", "diff"), F.struct("diff", -F.col("t"))).alias("b"), F.min_by(F.struct("t", "file", "dhash", "diff"), "t").alias("f"))
    chosen = best.withColumn("c", F.when(F.col("b.diff") >= least, F.col("b")).otherwise(F.col("f"))).select("vid", "window", "c.*")
    verdicts = folds.greedy_distinct_hashes(chosen, key=KEY, order=["window"], hashed="dhash", most=most)
    return chosen.join(verdicts, ["vid", "window"])


def frames_at(frames: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (vid, ask, t) the nearest frame with its neighbours."""
    around = sequences.neighbours(frames, key=KEY, order=["t", "i"], columns=["i"]).select("vid", "i", "file", "prev_i", "next_i")
    near = temporal.nearest(asked, frames.select("vid", "i", F.col("t").alias("ft")), key=KEY, left_time="t", left_id="ask", right_time="ft", right_id="i")
    return near.join(around, ["vid", "i"], "left")


def checked(rules: list[DataFrame], only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(issues, routing by owner) of all rules; a scoped run is a filter of the same issues."""
    found = integrity.union(rules)
    found = integrity.scoped(found, only) if only else found
    return found, assemble.routing(found.withColumn("message", F.concat_ws(" ", "code", "chapter", "detail")), key=KEY)


def fix_queue(found: DataFrame, rounds: DataFrame, dispatched: DataFrame, *, most: int = 2) -> DataFrame:
    """What to hand out next: owners with open issues, round and escalation."""
    shaped = found.withColumns({"message": F.concat_ws(" ", "code", "detail"), "severity": F.lit("major")})
    return state.work_queue(shaped, rounds, dispatched, most=most)


def lecture(chapters: DataFrame, found: DataFrame) -> DataFrame:
    """The merged document of every entity without errors."""
    return assemble.merged_document(chapters, found.where("level = 'error'"), key=KEY)


def note_index(nodes: DataFrame) -> DataFrame:
    """The index block derived from a note's nodes."""
    return assemble.joined_lines(nodes, key=KEY, order=["ord"], line=F.concat(F.lit("- ["), F.col("time"), F.lit("] "), F.col("title")))


def exported(nodes: DataFrame) -> DataFrame:
    """Anchor rows of a note as an HTML fragment with its clipboard form."""
    rows = nodes.withColumn("t", times.seconds_of(F.col("time"))).drop("ord").withColumn("about", F.lit(""))
    made = assemble.export_rows(rows, key=KEY, order=["t", "title"], title="title", desc="about")
    return assemble.html_fragment(made, key=KEY, time="t").withColumn("clipboard", assemble.clipboard_html(F.col("text"), F.lit("")))


def cross_reference(meta: DataFrame, chapters: DataFrame, hooks: DataFrame) -> DataFrame:
    """A worksheet row per entity of a family: chapters, keypoints, hooks in time order."""
    counts = assemble.brief(chapters, key=KEY)
    listed = assemble.joined_lines(hooks, key=KEY, order=["time", "hook"], line=F.concat(F.lit("["), F.col("time"), F.lit("] "), F.col("hook")), out="hooks")
    return meta.select("vid", "bvid", "page", "title").join(counts, "vid", "left").join(listed, "vid", "left")


def remapped_pages(old: DataFrame, new: DataFrame, refs: DataFrame, stamps: DataFrame) -> DataFrame:
    """References (vid, file, mtime, ref) of files not yet stamped, moved to the new pages that overlap the old."""
    mapping = temporal.best_overlap(old, new.withColumnRenamed("id", "new_id"), key=KEY, old_id="id", new_id="new_id", width=60.0)
    todo = state.once_only(refs, stamps, stamp=["vid", "file", "mtime"])
    return state.remapped(todo, mapping, key=KEY, ref="ref", old="id", new="new_id")


def regions(frames: DataFrame) -> DataFrame:
    """Corner regions of every entity from its grey profiles, with the area they cover."""
    scans = vision.profile_scans(frames, key=KEY, order="i", small="small")
    return vision.transient_regions(scans, frames, key=KEY, order="i", file="file")
