"""Ordered assembly: transcripts, tables, outlines, digests, exports. Order is always by a sort inside the
aggregate, never by arrival.

SNK-01 to SNK-18, SNK-20, AGG-19, AGG-23, AGG-28, STR-22, STR-31, WIN-26, ORC-11, ORC-26, ORC-27, PRJ-03.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import clip, html_escaped
from ..functions.times import hms, mmss


def joined_lines(df: DataFrame, *, key: Sequence[str], order: Sequence[str], line: Column, separator: str = "\n", out: str = "text") -> DataFrame:
    """One text per key of its rows' lines in order; null lines are left out."""
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    return df.groupBy(*key).agg(F.array_join(F.transform(rows, lambda r: r["_line"]), separator).alias(out))


def transcript(cues: DataFrame, *, key: Sequence[str], order: Sequence[str], time: str, text: str) -> DataFrame:
    return joined_lines(cues, key=key, order=order, line=F.concat(F.lit("["), hms(F.col(time)), F.lit("] "), F.col(text)))


def canonical_digest(df: DataFrame, *, key: Sequence[str], order: Sequence[str], fields: Sequence[Column], version: str) -> DataFrame:
    """SHA-256 over a version tag and the key's rows in order, each field as text: the same for any order of
    arrival, and with ``count`` as a record of what was counted."""
    row = F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    rows = F.array_sort(F.collect_list(F.struct(*order, row.alias("_row"))))
    return df.groupBy(*key).agg(F.sha2(F.concat(F.lit(version + "\n"), F.array_join(F.transform(rows, lambda r: r["_row"]), "\n")), 256).alias("digest"), F.count("*").alias("count"))


def outline(chapters: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Numbered contents with time ranges."""
    line = F.format_string("%d. %s (%s–%s)", F.col("_n"), F.col("title"), mmss(F.col("t_start")), mmss(F.col("t_end")))
    numbered = chapters.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("id")))
    return joined_lines(numbered, key=key, order=["id"], line=line)


def markdown_table(df: DataFrame, *, key: Sequence[str], order: Sequence[str], columns: Sequence[tuple[str, Column]]) -> DataFrame:
    head = "| " + " | ".join(n for n, _ in columns) + " |\n|" + " --- |" * len(columns) + "\n"
    cell = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    body = joined_lines(df, key=key, order=order, line=F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for _, c in columns]), F.lit(" |")))
    return body.withColumn("text", F.concat(F.lit(head), "text"))


def timeline(chapters: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Text of a timeline diagram; colons in titles are full-width there."""
    line = F.concat(F.lit("    "), F.replace(hms(F.col("t_start")), F.lit(":"), F.lit("：")), F.lit(" : "), F.replace(F.col("title"), F.lit(":"), F.lit("：")))
    body = joined_lines(chapters, key=key, order=["id"], line=line)
    return body.withColumn("text", F.concat(F.lit("timeline\n"), "text"))


def review_report(chapters: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """(kind, text) rows of all corrections, flags, uncertainties and coverage notes, in chapter order."""
    fix = chapters.select(*key, "id", F.lit("correction").alias("kind"), F.posexplode("corrections").alias("ord", "c")).select(*key, "id", "kind", "ord", F.concat_ws(" ", F.concat("c.wrong", F.lit(" → "), "c.right"), F.concat(F.lit("("), "c.evidence", F.lit(")"))).alias("text"))
    out = fix
    for kind, column in (("flag", "review_flags"), ("uncertainty", "uncertainties")):
        out = out.unionByName(chapters.select(*key, "id", F.lit(kind).alias("kind"), F.posexplode(column).alias("ord", "text")))
    notes = chapters.where(F.length(F.trim("coverage_notes")) > 0).select(*key, "id", F.lit("coverage").alias("kind"), F.lit(0).alias("ord"), F.col("coverage_notes").alias("text"))
    return out.unionByName(notes)


def demoted_text(text: Column) -> Column:
    """The text without white space around it and one ``#`` more before each heading that is in no fence (six at most)."""
    # a piece begins at each fence's line, so that every second one is inside
    pieces = F.split(F.concat(F.lit("\n"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), r"(?m)(?=^```)")
    moved = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, r"(?m)^(#{1,5}\s)", "#$1")).otherwise(x))
    return F.substring(F.array_join(moved, ""), 2, 2**31 - 1)


def merged_document(chapters: DataFrame, errors: DataFrame, *, key: Sequence[str], body: str = "body") -> DataFrame:
    """One document per key without errors: chapters in order under their titles, headings one level down. Keys
    with errors are left out."""
    clean = chapters.join(errors.select(*key).distinct(), list(key), "left_anti")
    return joined_lines(clean, key=key, order=["id"], line=F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), demoted_text(F.col(body)), F.lit("\n")))


def inlined(df: DataFrame, images: DataFrame, *, key: Sequence[str], refs: DataFrame, text: str = "text") -> DataFrame:
    """Replace picture targets by data URIs. ``refs`` has key and target; ``images`` path and content."""
    data = refs.join(images.select(F.col("path").alias("target"), F.concat(F.lit("data:image/jpeg;base64,"), F.base64("content")).alias("_d")), "target")
    swaps = data.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("target", "_d"))).alias("_s"))
    swapped = F.aggregate(F.coalesce("_s", F.array().cast("array<struct<target:string,_d:string>>")), F.col(text), lambda t, s: F.replace(t, F.concat(F.lit("("), s["target"], F.lit(")")), F.concat(F.lit("("), s["_d"], F.lit(")"))))
    return df.join(swaps, list(key), "left").withColumn(text, swapped).drop("_s")


def assembled_chunks(plan: DataFrame, outputs: DataFrame, *, key: Sequence[str], least: int = 50) -> tuple[DataFrame, DataFrame]:
    """(texts of the keys whose chunks are all there, chunks that are missing or shorter than ``least``)."""
    both = plan.select(*key, "no").join(outputs.select(*key, "no", F.col("text").alias("_t")), [*key, "no"], "left")
    bad = both.where(F.coalesce(F.length(F.trim("_t")), F.lit(0)) < least).select(*key, "no", F.when(F.col("_t").isNull(), "missing").otherwise("short").alias("why"))
    whole = both.join(bad.select(*key).distinct(), list(key), "left_anti")
    return joined_lines(whole, key=key, order=["no"], line=F.trim("_t"), separator="\n\n"), bad


def routing(issues: DataFrame, *, key: Sequence[str] = ()) -> DataFrame:
    """Owner to messages, and the numbers per level."""
    return issues.groupBy(*key, "owner").agg(
        F.array_join(F.array_sort(F.collect_list("message")), "; ").alias("messages"),
        *(F.count(F.when(F.col("level") == l, 1)).alias(f"n_{l}") for l in ("error", "warning", "review")),
    )


def routing_map(issues: DataFrame, *, key: Sequence[str]) -> DataFrame:
    owners = issues.groupBy(*key, "owner").agg(F.array_sort(F.collect_list("message")).alias("m"))
    return owners.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("owner", "m")))).alias("routing"))


def brief(chapters: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Roll-up per key: chapters, keypoints and questions with their counts and characters."""
    return chapters.groupBy(*key).agg(F.count("*").alias("n_chapters"), F.sum(F.size("keypoints")).alias("n_keypoints"), F.sum(F.size("questions")).alias("n_questions"), F.sum(F.length("body")).alias("chars"))


def export_rows(items: DataFrame, *, key: Sequence[str], order: Sequence[str], title: str, desc: str, title_max: int = 30, desc_max: int = 14) -> DataFrame:
    """Label and description per item, clipped."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return items.withColumn("label", clip(F.col(title), title_max)).withColumn("desc", clip(F.col(desc), desc_max)).withColumn("ord", place)


def html_fragment(rows: DataFrame, *, key: Sequence[str], time: str) -> DataFrame:
    line = F.format_string('<p data-seconds="%d"><b>%s</b> %s %s</p>', F.col(time).cast("long"), mmss(F.col(time), pad_hour=False), html_escaped(F.col("label")), html_escaped(F.coalesce("desc", F.lit(""))))
    return joined_lines(rows, key=key, order=["ord"], line=line)


def clipboard_html(fragment: Column, source: Column) -> Column:
    """A fragment with a header of its byte offsets in UTF-8, each of ten digits."""
    head = "Version:0.9\r\nStartHTML:{0}\r\nEndHTML:{1}\r\nStartFragment:{2}\r\nEndFragment:{3}\r\nSourceURL:"
    opening, closing = "<html><body><!--StartFragment-->", "<!--EndFragment--></body></html>"
    fixed = len(head.format(*["0" * 10] * 4)) + 2
    start = F.octet_length(source) + fixed
    first = start + len(opening)
    last = first + F.octet_length(fragment)
    ten = lambda n: F.lpad(n.cast("string"), 10, "0")
    pieces = [F.lit(x) for x in ("Version:0.9\r\nStartHTML:", "\r\nEndHTML:", "\r\nStartFragment:", "\r\nEndFragment:", "\r\nSourceURL:")]
    return F.concat(pieces[0], ten(start), pieces[1], ten(last + len(closing)), pieces[2], ten(first), pieces[3], ten(last), pieces[4], source, F.lit("\r\n" + opening), fragment, F.lit(closing))


def tile_map(frames: DataFrame, *, key: Sequence[str], order: Sequence[str], cols: int = 3, rows: int = 4, blank: Column | None = None) -> DataFrame:
    """Row-major places of frames on sheets of ``cols`` by ``rows``; blank frames are skipped and not numbered."""
    kept = frames.where(~blank) if blank is not None else frames
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return kept.withColumn("_n", n).withColumns({"index": F.col("_n") + 1, "sheet": F.floor(F.col("_n") / (cols * rows)) + 1, "tile_row": F.floor(F.col("_n") % (cols * rows) / cols) + 1, "tile_col": F.col("_n") % cols + 1}).drop("_n")


def filled_template(template: Column, values: Column) -> Column:
    """``{{NAME}}`` replaced by the map's values; names it lacks become empty."""
    filled = F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))
    return F.regexp_replace(filled, r"\{\{\w+\}\}", "")


def file_digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def tree_size(spark, path: str) -> DataFrame:
    """Total bytes and files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))
