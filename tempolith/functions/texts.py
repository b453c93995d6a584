"""Text normalisation, character n-grams and Markdown scraps as column expressions.

STR-01 to STR-05, STR-08, STR-09, STR-13, STR-18, STR-19, STR-23 to STR-27, AGG-10, AGG-11, AGG-19, SET-05, PRJ-11, PRJ-13.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import seconds_of

#: What a link to a picture may point to, as (kind, name).
REFERENCE = r"!\[([^\]\n]*)\]\(((?:[^()\s]*/)?(slides|sheets|figures)/([^()\s/]+))\)"
REFERENCE_NAMES = {"slides": r"^\d{1,4}\.(jpg|png)$", "sheets": r"^sheet_\d+\.(jpg|png)$", "figures": r"^fig_\d+\.(jpg|png)$"}


def compact(text: Column) -> Column:
    """ASCII letters and digits and CJK ideographs only."""
    return F.regexp_replace(text, "[^0-9A-Za-z一-鿿]", "")


def without_marks(text: Column) -> Column:
    """No white space, punctuation or underscores, for any script."""
    return F.regexp_replace(text, r"(?U)[\s\W_]+", "")


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\s+", ""))


def alternatives(patterns: list[str]) -> str | None:
    """One case-insensitive pattern of several; none if there are none."""
    used = [p for p in patterns if p]
    return "(?i)" + "|".join(f"(?:{p})" for p in used) if used else None


def grams(text: Column, n: int = 4, boilerplate: list[str] = ()) -> Column:
    """The distinct character n-grams of the compact lower-case text. One regex scan, no index loop."""
    drop = alternatives(list(boilerplate))
    bare = F.regexp_replace(text, drop, "") if drop else text
    return F.array_distinct(F.regexp_extract_all(F.lower(compact(bare)), F.lit(f"(?=(.{{{n}}}))"), F.lit(1)))


def gram_containment(a: Column, b: Column) -> Column:
    """Shared grams over the smaller set; 0 if one is empty. Takes the arrays of ``grams``."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last of them an ellipsis if something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))).otherwise(text)


def cap(text: Column, limit: int) -> Column:
    """As ``clip`` with the ellipsis beyond the limit; a limit of 0 means none."""
    return text if limit <= 0 else F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def html_escaped(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def canonical_url(url: Column, keep: str = "p") -> Column:
    """Scheme, host and path; of the query only ``keep`` if it is a number above 1."""
    base = F.regexp_extract(url, r"^[^?#]*", 0)
    page = F.regexp_extract(url, rf"[?&]{keep}=(\d+)", 1).try_cast("int")
    return F.when(page > 1, F.concat(base, F.lit(f"?{keep}="), page.cast("string"))).otherwise(base)


def clean_title(text: Column, fallback: Column, noise: list[str] = (), limit: int = 24) -> Column:
    drop = alternatives(list(noise))
    bare = F.regexp_replace(text, drop, " ") if drop else text
    tidy = F.left(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), F.lit(limit))
    return F.when(F.length(F.coalesce(tidy, F.lit(""))) > 0, F.trim(tidy)).otherwise(fallback)


def within_one_edit(a: Column, b: Column) -> Column:
    """Case-insensitive edit distance of at most one; equal texts count. -1 means more than the limit."""
    return F.levenshtein(F.lower(a), F.lower(b), 1) >= 0


def time_range_of(line: Column) -> Column:
    """``a–b`` in a line, each ``MM:SS`` or ``H:MM:SS``, as a struct of seconds; null if absent."""
    form = r"(\d{1,2}(?::\d{2}){1,2})\s*[-–—~]\s*(\d{1,2}(?::\d{2}){1,2})"
    a, b = F.regexp_extract(line, form, 1), F.regexp_extract(line, form, 2)
    return F.when(F.length(a) > 0, F.struct(seconds_of(a).alias("a"), seconds_of(b).alias("b")))


def slide_numbers(line: Column) -> Column:
    """The numbers after ``slide`` or ``slides`` in a line, in order."""
    listed = F.regexp_extract(line, r"(?i)slides?\s*[:：]?\s*((?:\d{1,4}\s*[,，、]?\s*)+)", 1)
    return F.transform(F.regexp_extract_all(listed, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))


def reference_name(kind: Column, name: Column) -> Column:
    """Slide names as four digits; any other name as it is."""
    stem, suffix = F.regexp_extract(name, r"^(\d+)(\.\w+)?$", 1), F.regexp_extract(name, r"(\.\w+)$", 1)
    numbered = (kind == "slides") & (F.length(stem) > 0)
    return F.when(numbered, F.concat(F.lpad(stem, 4, "0"), F.when(F.length(suffix) > 0, suffix).otherwise(F.lit(".jpg")))).otherwise(name)


def references(text: Column) -> Column:
    """All picture references as structs (alt, target, kind, name), in order."""
    take = lambda k: F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(k))
    return F.arrays_zip(take(1).alias("alt"), take(2).alias("target"), take(3).alias("kind"), take(4).alias("name"))


def unknown_targets(text: Column) -> Column:
    """Distinct picture targets in order that no kind of reference allows."""
    targets = F.regexp_extract_all(text, F.lit(r"!\[[^\]\n]*\]\(([^)\s]+)\)"), F.lit(1))
    known = r"^(?:[^()\s]*/)?(?:" + "|".join(f"{k}/{v[1:-1]}" for k, v in REFERENCE_NAMES.items()) + ")$"
    return F.array_distinct(F.filter(targets, lambda x: ~x.rlike(known)))


def table_pairs(line: Column) -> Column:
    """The first two cells of a Markdown table row; null for rules, headers of dashes and other lines."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    row = line.rlike(r"^\s*\|") & (F.size(cells) >= 2) & ~line.rlike(r"^\s*\|[\s:|\-]+$")
    return F.when(row, F.struct(cells[0].alias("left"), cells[1].alias("right")))


def _two_digits(x: Column) -> Column:
    return F.when(x.rlike(r"^\d$"), F.concat(F.lit("0"), x)).otherwise(x)


def chapter_list(csv: Column) -> Column:
    """Chapters of a list with commas of either width, single digits as two; null if there are none."""
    parts = F.filter(F.transform(F.split(F.replace(csv, F.lit("，"), F.lit(",")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.transform(parts, _two_digits))


def dispatched_ids(ids: Column, owner: Column, scope: Column) -> Column:
    """Those of ``ids`` that ``chapter:03,04`` in owner or scope names, in their order; all if neither names any."""
    lists = F.regexp_extract_all(F.concat_ws(" | ", owner, scope), F.lit(r"chapter:([0-9][0-9,\s]*)"), F.lit(1))
    picked = F.transform(F.filter(F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y)))), lambda y: y != ""), _two_digits)
    return F.when(F.size(picked) > 0, F.filter(ids, lambda x: F.array_contains(picked, x))).otherwise(ids)
