"""Markdown and caption texts as line tables: sections, nodes, fences, references, tables, logs.

J-19, STR-06, STR-07, STR-10 to STR-17, STR-20 to STR-22, SRC-01, SRC-05, SRC-07, SRC-08, SRC-16, SRC-17, SRC-20, SRC-21,
AGG-20, AGG-22, J-12, J-20, SET-05, V-15. Documents are exploded into numbered lines; stretches are
running sums over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import REFERENCE_NAMES, reference_name, references, slide_numbers, time_range_of
from ..functions.times import from_parts, seconds_of
from .sequences import number_islands


def lines_of(df: DataFrame, *, key: Sequence[str], text: str) -> DataFrame:
    """(key, line_no from 0, line) of each text."""
    return df.select(*key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))


def with_fences(lines: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Add ``fenced``: whether a line stands inside a code fence, its marks included."""
    mark = F.col("line").rlike(r"^\s*(```|~~~)")
    w = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum(mark.cast("int")).over(w)
    return lines.withColumn("fenced", (opened % 2 == 1) | mark)


def demoted(lines: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """One ``#`` more for headings outside fences, six at most."""
    heading = ~F.col("fenced") & F.col("line").rlike(r"^#{1,5}\s")
    return with_fences(lines, key=key).withColumn("line", F.when(heading, F.concat(F.lit("#"), "line")).otherwise(F.col("line"))).drop("fenced")


def headings(lines: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """(level, title) of the headings outside fences."""
    found = with_fences(lines, key=key).where(~F.col("fenced") & F.col("line").rlike(r"^#{1,6}\s+\S"))
    return found.select(*key, "line_no", F.length(F.regexp_extract("line", "^#+", 0)).alias("level"), F.trim(F.regexp_replace("line", r"^#+\s+", "")).alias("title"))


def anchored_sections(lines: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Sections begun by ``## [HH:MM:SS] title``: number, seconds, title, first line, body."""
    form = r"^##\s+\[(\d{1,2}(?::\d{2}){1,2})\]\s*(.*)$"
    marked = lines.withColumn("_head", F.col("line").rlike(form))
    numbered = number_islands(marked, key=key, order=["line_no"], starts=F.col("_head"), out="_s")
    grouped = numbered.groupBy(*key, "_s").agg(F.min_by("line", "line_no").alias("head"), F.min("line_no").alias("head_no"), F.bool_or("_head").alias("real"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    body = F.array_join(F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda r: r["line"]), "\n")
    return grouped.where("real").select(*key, "head_no", seconds_of(F.regexp_extract("head", form, 1)).alias("t"), F.trim(F.regexp_extract("head", form, 2)).alias("title"), F.trim(body).alias("body"))


def sections(lines: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Sections begun by ``##``: title, bounds, the time and slides of an italic line if that is the first line
    with text, and the slide pictures with their lines."""
    marked = lines.withColumn("_head", F.col("line").rlike(r"^##\s+\S"))
    numbered = number_islands(marked, key=key, order=["line_no"], starts=F.col("_head"), out="_s")
    inner = ~F.col("_head") & (F.length(F.trim("line")) > 0)
    picture = F.regexp_extract("line", r"!\[[^\]]*\]\((?:[^()\s]*/)?slides/(\d{1,4})\.(?:jpg|png)\)", 1)
    grouped = numbered.groupBy(*key, "_s").agg(
        F.bool_or("_head").alias("real"),
        F.max(F.when(F.col("_head"), F.trim(F.regexp_replace("line", r"^##\s+", "")))).alias("title"),
        F.min("line_no").alias("head_idx"),
        (F.max("line_no") + 1).alias("end_idx"),
        F.min_by(F.when(inner, F.col("line")), F.when(inner, F.col("line_no"))).alias("first_line"),
        F.array_sort(F.collect_list(F.when(F.length(picture) > 0, F.struct(F.col("line_no").alias("line"), picture.cast("int").alias("page"))))).alias("images"),
    )
    italic = F.col("first_line").rlike(r"^\s*\*[^*].*\*\s*$")
    made = grouped.where("real").withColumn("time_line", F.when(italic, F.col("first_line")))
    return made.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("head_idx")).alias("ord"), "title", "head_idx", "end_idx", "time_line", time_range_of(F.col("time_line")).alias("raw_time"), F.coalesce(slide_numbers(F.col("time_line")), F.array().cast("array<int>")).alias("raw_slides"), "images")


def note_nodes(lines: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Nodes begun by ``## [MM:SS] title`` with labelled bullets; any other ``##`` closes a node."""
    form = r"^##\s+\[(\d{1,2}(?::\d{2}){1,2})\]\s*(.*)$"
    marked = lines.withColumn("_head", F.col("line").rlike(r"^##\s"))
    numbered = number_islands(marked, key=key, order=["line_no"], starts=F.col("_head"), out="_s")
    bullet = r"^\s*[-*]\s*(?:\*\*)?([^:：*]{1,20})(?:\*\*)?\s*[:：]\s*(?:\*\*)?\s*(.+)$"
    label, value = F.trim(F.regexp_extract("line", bullet, 1)), F.trim(F.regexp_extract("line", bullet, 2))
    entry = F.when(F.length(label) > 0, F.struct("line_no", label.alias("label"), value.alias("value")))
    grouped = numbered.groupBy(*key, "_s").agg(F.min_by("line", "line_no").alias("head"), F.min("line_no").alias("head_no"), F.array_sort(F.collect_list(entry)).alias("entries"))
    nodes = grouped.where(F.col("head").rlike(form))
    labels = F.array_distinct(F.transform("entries", lambda e: e["label"]))
    fields = F.map_from_entries(F.transform(labels, lambda l: F.struct(l, F.transform(F.filter("entries", lambda e: e["label"] == l), lambda e: e["value"]))))
    return nodes.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("head_no")).alias("ord"), F.regexp_extract("head", form, 1).alias("time"), F.trim(F.regexp_extract("head", form, 2)).alias("title"), fields.alias("fields"))


def hooks(nodes: DataFrame, *, key: Sequence[str], label: str) -> DataFrame:
    """One row per value of one label."""
    return nodes.select(*key, "time", F.col("title").alias("node"), F.explode(F.col("fields")[label]).alias("hook"))


def picture_references(df: DataFrame, *, key: Sequence[str], text: str) -> DataFrame:
    """One row per reference, in order, with canonical names and whether the kind allows the name."""
    found = df.select(*key, F.posexplode(references(F.col(text))).alias("ord", "r")).select(*key, "ord", "r.*")
    allowed = F.lit(False)
    for kind, form in REFERENCE_NAMES.items():
        allowed = allowed | ((F.col("kind") == kind) & F.col("name").rlike(form))
    return found.withColumns({"canonical": reference_name(F.col("kind"), F.col("name")), "allowed": allowed})


def resolved_references(refs: DataFrame, files: DataFrame, *, key: Sequence[str], target: str = "target", path: str = "path") -> DataFrame:
    """Rewrite a target only if it names no file while its last two parts do; ``status`` tells which."""
    bare = F.regexp_extract(F.col(target), r"([^/]+/[^/]+)$", 1)
    known = files.select(*key, F.col(path).alias("_p")).distinct()
    out = refs.withColumn("_bare", bare).join(known.withColumnRenamed("_p", target).withColumn("_direct", F.lit(True)), [*key, target], "left")
    out = out.join(known.withColumnRenamed("_p", "_bare").withColumn("_short", F.lit(True)), [*key, "_bare"], "left")
    status = F.when(F.col("_direct"), "ok").when(F.col("_short"), "rewritten").otherwise("missing")
    return out.withColumns({"status": status, target: F.when(F.col("_direct").isNull() & F.col("_short"), F.col("_bare")).otherwise(F.col(target))}).drop("_bare", "_direct", "_short")


def annotation_count(lines: DataFrame, *, key: Sequence[str], marker: str) -> DataFrame:
    """List items in the contiguous quote blocks that hold ``marker``; such a block without items counts one."""
    quoted = lines.withColumn("_q", F.col("line").rlike(r"^\s*>"))
    w = Window.partitionBy(*key).orderBy("line_no")
    turned = quoted.withColumn("_turn", F.col("_q") != F.lag("_q").over(w))
    blocks = number_islands(turned, key=key, order=["line_no"], starts=F.col("_turn"), out="_b")
    counted = blocks.where("_q").groupBy(*key, "_b").agg(F.bool_or(F.col("line").contains(marker)).alias("has"), F.sum(F.col("line").rlike(r"^\s*>\s*(?:[-*+]|\d+[.)])\s+\S").cast("int")).alias("items"))
    totals = counted.where("has").groupBy(*key).agg(F.sum(F.greatest("items", F.lit(1))).alias("annotations"))
    return lines.select(*key).distinct().join(totals, list(key), "left").withColumn("annotations", F.coalesce("annotations", F.lit(0)))


def srt_cues(df: DataFrame, *, key: Sequence[str], text: str) -> DataFrame:
    """Cues of SRT-like texts: blocks split at blank lines, times with comma or point, empty cues dropped."""
    form = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})\s*-->\s*(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})"
    blocks = df.select(*key, F.posexplode(F.split(F.regexp_replace(F.col(text), "\r", ""), r"\n[ \t]*\n")).alias("_n", "_b")).where(F.col("_b").rlike(form))
    part = lambda k: F.regexp_extract("_b", form, k)
    rows = F.split(F.regexp_replace("_b", rf"^[\s\S]*?{form}[^\n]*\n?", ""), "\n")
    words = F.array_join(F.filter(F.transform(rows, lambda x: F.trim(x)), lambda x: x != ""), " ")
    cues = blocks.select(*key, "_n", from_parts(part(1), part(2), part(3), part(4)).alias("t_from"), from_parts(part(5), part(6), part(7), part(8)).alias("t_to"), words.alias("text")).where("text <> ''")
    return cues.withColumn("seq", F.row_number().over(Window.partitionBy(*key).orderBy("_n"))).drop("_n")


JSON_CUE = "from double, start double, `to` double, `end` double, content string, text string"


def json_cues(df: DataFrame, *, key: Sequence[str], text: str) -> DataFrame:
    """Cues of JSON captions under any of the accepted names; blank ones dropped."""
    root = F.from_json(F.col(text), f"body array<struct<{JSON_CUE.replace(' double', ': double').replace(' string', ': string')}>>, segments array<struct<{JSON_CUE.replace(' double', ': double').replace(' string', ': string')}>>")
    rows = df.withColumn("_r", root).select(*key, F.posexplode(F.coalesce("_r.body", "_r.segments")).alias("_n", "c"))
    cues = rows.select(*key, "_n", F.coalesce("c.from", "c.start").alias("t_from"), F.coalesce("c.to", "c.end").alias("t_to"), F.trim(F.coalesce("c.content", "c.text")).alias("text")).where("text <> ''")
    return cues.withColumn("seq", F.row_number().over(Window.partitionBy(*key).orderBy("_n"))).drop("_n")


def target_of(url: Column) -> Column:
    """(id, page) of a video URL or bare id; the page is 1 by default. Fails if there is no id."""
    ident = F.regexp_extract(url, r"(BV[0-9A-Za-z]{10})", 1)
    page = F.coalesce(F.regexp_extract(url, r"[?&]p=(\d+)", 1).try_cast("int"), F.lit(1))
    return F.struct(F.when(F.length(ident) > 0, ident).otherwise(F.raise_error(F.concat(F.lit("no id in "), url))).alias("bvid"), page.alias("page"))


def measurement_rows(lines: DataFrame, *, key: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows of a log with ``frame: … pts_time:T`` headers followed by ``name=value`` lines."""
    head = r"^frame:\s*\d+.*pts_time:\s*([0-9.]+)"
    numbered = number_islands(lines.withColumn("_head", F.col("line").rlike(head)), key=key, order=["line_no"], starts=F.col("_head"), out="_f")
    value = lambda n: F.max(F.when(F.regexp_extract("line", r"^([^=\s]+)=", 1) == n, F.regexp_extract("line", r"=(.*)$", 1).try_cast("double")))
    grouped = numbered.groupBy(*key, "_f").agg(F.max(F.regexp_extract("line", head, 1).try_cast("double")).alias("t"), *(value(n).alias(n.rsplit(".", 1)[-1]) for n in names))
    return grouped.where("t is not null").drop("_f")


def log_events(lines: DataFrame, *, key: Sequence[str], name: str) -> DataFrame:
    """``<name>_start`` and ``<name>_end`` lines as (line_no, kind, t) for ``paired_events``."""
    form = rf"{name}_(start|end)\s*[:=]\s*(-?[0-9.]+)"
    return lines.where(F.col("line").rlike(form)).select(*key, "line_no", F.regexp_extract("line", form, 1).alias("kind"), F.regexp_extract("line", form, 2).try_cast("double").alias("t"))


def media_properties(df: DataFrame, *, key: Sequence[str], text: str) -> DataFrame:
    """Duration, size and rate from a probe's printed text; null where it says nothing."""
    d = lambda k: F.regexp_extract(text, r"Duration:\s*(\d+):(\d{2}):(\d{2}(?:\.\d+)?)", k).try_cast("double")
    size = lambda k: F.regexp_extract(text, r"\s(\d{2,5})x(\d{2,5})[\s,]", k).try_cast("int")
    return df.select(*key, (d(1) * 3600 + d(2) * 60 + d(3)).alias("duration"), size(1).alias("width"), size(2).alias("height"), F.regexp_extract(text, r"([0-9.]+)\s*fps", 1).try_cast("double").alias("fps"))


def settings(lines: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Name and value of tab-separated lines of seven fields or more, of ``name=value``, or a bare value."""
    cells = F.split("line", "\t")
    pair = F.when(F.size(cells) >= 7, F.struct(F.get(cells, F.lit(5)).alias("name"), F.get(cells, F.lit(6)).alias("value")))
    pair = F.coalesce(pair, F.when(F.col("line").contains("="), F.struct(F.trim(F.substring_index("line", "=", 1)), F.trim(F.regexp_replace("line", "^[^=]*=", "")))), F.struct(F.lit(None).cast("string"), F.trim("line")))
    return lines.where((F.trim("line") != "") & ~F.col("line").rlike(r"^\s*#(?!HttpOnly)")).select(*key, "line_no", pair.alias("_p")).select(*key, "line_no", "_p.*")


def front_matter(df: DataFrame, *, key: Sequence[str], text: str) -> DataFrame:
    """(name, values, ord) of the leading ``---`` block: scalars, inline lists and block lists; and the rest."""
    block = F.regexp_extract(text, r"^---\n([\s\S]*?)\n---(?:\n|$)", 1)
    lines = df.select(*key, F.posexplode(F.split(block, "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    named = number_islands(lines.withColumn("_head", F.col("line").rlike(r"^\w[\w\-]*\s*:")), key=key, order=["line_no"], starts=F.col("_head"), out="_n")
    grouped = named.groupBy(*key, "_n").agg(F.min_by("line", "line_no").alias("head"), F.min("line_no").alias("ord"), F.array_sort(F.collect_list(F.when(F.col("line").rlike(r"^\s*-\s"), F.struct("line_no", F.trim(F.regexp_replace("line", r"^\s*-\s+", "")).alias("v"))))).alias("items"))
    value = F.trim(F.regexp_replace("head", r"^[^:]*:", ""))
    inline = F.filter(F.transform(F.split(F.regexp_replace(value, r"^\[|\]$", ""), ","), lambda x: F.trim(F.regexp_replace(x, r"""^\s*["']|["']\s*$""", ""))), lambda x: x != "")
    values = F.when(F.size("items") > 0, F.transform("items", lambda i: i["v"])).when(value.rlike(r"^\[.*\]$"), inline).when(value != "", F.array(F.regexp_replace(value, r"""^["']|["']$""", ""))).otherwise(F.array().cast("array<string>"))
    return grouped.select(*key, "ord", F.trim(F.substring_index("head", ":", 1)).alias("name"), values.alias("values"))


def rewritten_references(df: DataFrame, mapping: DataFrame, *, key: Sequence[str], text: str) -> DataFrame:
    """Replace whole picture targets by a mapping (key, old, new). A target is replaced once, so that swaps work:
    first each old target by a mark of its number, then the marks by the new targets."""
    pairs = mapping.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("old", "new"))).alias("_p"))
    marked = F.aggregate(F.sequence(F.lit(1), F.size("_p")), F.col(text), lambda t, i: F.replace(t, F.concat(F.lit("]("), F.element_at("_p", i)["old"], F.lit(")")), F.concat(F.lit("](\u0001"), i.cast("string"), F.lit("\u0002)"))))
    named = F.aggregate(F.sequence(F.lit(1), F.size("_p")), marked, lambda t, i: F.replace(t, F.concat(F.lit("](\u0001"), i.cast("string"), F.lit("\u0002)")), F.concat(F.lit("]("), F.element_at("_p", i)["new"], F.lit(")"))))
    return df.join(pairs, list(key), "left").withColumn(text, F.when(F.size("_p") > 0, named).otherwise(F.col(text))).drop("_p")


def reference_path(folder: Column, target: Column) -> Column:
    """A target relative to the folder of the text that holds it; each leading ``../`` leaves one folder."""
    ups = F.size(F.regexp_extract_all(F.regexp_extract(target, r"^(?:\.\./)*", 0), F.lit(r"\.\./"), F.lit(0)))
    parts = F.split(folder, "/")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - ups, F.lit(0)))
    return F.concat_ws("/", F.filter(kept, lambda x: x != ""), F.regexp_replace(target, r"^(?:\.\./)*", ""))


def lecture_items(lines: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Timed items of a merged lecture: of each chapter (level 1 or 2) its timed sub-sections if it has any, else
    the chapter itself. The time stands in the heading or in the first line with text under it."""
    head = F.col("line").rlike(r"^#{1,4}\s+\S")
    numbered = number_islands(with_fences(lines, key=key).withColumn("_head", head & ~F.col("fenced")), key=key, order=["line_no"], starts=F.col("_head"), out="_s")
    inner = ~F.col("_head") & (F.length(F.trim("line")) > 0)
    rows = numbered.groupBy(*key, "_s").agg(F.bool_or("_head").alias("real"), F.max(F.when(F.col("_head"), F.col("line"))).alias("head"), F.min("line_no").alias("at"), F.min_by(F.when(inner, F.col("line")), F.when(inner, F.col("line_no"))).alias("under"))
    clock = r"(\d{1,2}(?::\d{2}){1,2})"
    time = F.coalesce(*[F.when(F.length(F.regexp_extract(c, p, 1)) > 0, seconds_of(F.regexp_extract(c, p, 1))) for c, p in ((F.col("head"), r"\[" + clock + r"\]"), (F.col("under"), r"^\s*\*" + clock))])
    title = F.trim(F.regexp_replace(F.regexp_replace("head", r"^#+\s+", ""), r"\[[\d:]+\]", ""))
    timed = rows.where("real").select(*key, "at", F.length(F.regexp_extract("head", "^#+", 0)).alias("level"), time.alias("t"), title.alias("title"))
    w = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    chaptered = timed.withColumn("chapter", F.sum((F.col("level") <= 2).cast("int")).over(w))
    detailed = F.max((F.col("t").isNotNull() & (F.col("level") > 2)).cast("int")).over(Window.partitionBy(*key, "chapter"))
    return chaptered.withColumn("_d", detailed).where(F.col("t").isNotNull() & ((F.col("_d") == 0) | (F.col("level") > 2))).select(*key, "chapter", "t", "title")


def registered(*registries: DataFrame, key: Sequence[str], name: str = "name") -> DataFrame:
    """The union of registries, each name once; a registry that couldn't be read is simply not given."""
    out = registries[0].select(*key, name)
    for other in registries[1:]:
        out = out.unionByName(other.select(*key, name))
    return out.distinct()


def migrated(front: DataFrame, *, key: Sequence[str], names: dict[str, str]) -> DataFrame:
    """Front matter rows of the old form as one row of the new columns; ``names`` maps old to new. Columns are
    arrays of texts; what the old form lacks is empty."""
    empty = F.array().cast("array<string>")
    return front.groupBy(*key).agg(*[F.coalesce(F.max_by(F.when(F.col("name") == old, F.col("values")), F.when(F.col("name") == old, F.col("ord"))), empty).alias(new) for old, new in names.items()])
