"""Texts against texts of the same entity: longest common runs, drifting anchors, the consensus of two readings.

WIN-14, V-42, STR-32.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import without_marks


def longest_common_runs(pairs: DataFrame, *, left: str, right: str, least: int) -> DataFrame:
    """``pairs`` whose texts share a run of ``least`` characters or more, with the longest such run: ``size``, and where it begins in either text
    (``at_left``, ``at_right``, from 0; of equally long runs the first in the left text, then in the right).

    Each ``least``-gram of the left text meets the places of the same gram in the right one; places on one diagonal without a gap are one run.
    Other columns pass through.
    """
    grams = lambda c: F.regexp_extract_all(F.col(c), F.lit(f"(?s)(?=(.{{{least}}}))."), F.lit(1))
    held = pairs.select(F.monotonically_increasing_id().alias("_pair"), F.struct(*map(F.col, pairs.columns)).alias("_row"), grams(left).alias("_left"), grams(right).alias("_right"))
    asked = held.where(F.arrays_overlap("_left", "_right")).select("_pair", "_row", "_right", F.posexplode("_left").alias("_a", "_gram"))
    places = F.filter(F.transform("_right", lambda g, b: F.when(g == F.col("_gram"), b)), lambda b: b.isNotNull())
    met = asked.select("_pair", "_row", "_a", F.explode(places).alias("_b")).withColumn("_diagonal", F.col("_b") - F.col("_a"))
    diagonal = Window.partitionBy("_pair", "_diagonal").orderBy("_a")
    runs = met.withColumn("_run", F.col("_a") - F.row_number().over(diagonal)).groupBy("_pair", "_diagonal", "_run").agg(F.first("_row").alias("_row"), F.min("_a").alias("_from"), F.count("*").alias("_n"))
    longest = F.max(F.struct("_n", (-F.col("_from")).alias("first"), (-F.col("_from") - F.col("_diagonal")).alias("second")))
    best = runs.groupBy("_pair").agg(F.first("_row").alias("_row"), longest.alias("_best"))
    return best.select("_row.*", (F.col("_best._n") + least - 1).cast("int").alias("size"), (-F.col("_best.first")).alias("at_left"), (-F.col("_best.second")).alias("at_right"))


def drifting_anchors(anchored: DataFrame, paragraphs: DataFrame, *, least: int = 12, head: int = 40, reach: int = 400, start: int = 8, back: int = 3) -> DataFrame:
    """Sections whose first words stand in an earlier paragraph: anchored(vid, para, text), paragraphs(vid, id, text).

    The first ``head`` characters of a section (without marks and spaces) are held against the first ``reach`` of each of the ``back`` paragraphs
    before its own. It drifts if their longest common run has ``least`` characters, begins within the first ``start`` of the section's and
    within the first ``head`` of the paragraph's. Of several such paragraphs the earliest is ``source``.
    """
    told = anchored.select("vid", "para", F.left(without_marks(F.coalesce("text", F.lit(""))), F.lit(head)).alias("here")).where(F.length("here") >= least)
    asked = told.withColumn("id", F.explode(F.sequence(F.col("para") - back, F.col("para") - 1))).where("id >= 1")
    there = paragraphs.select("vid", "id", F.left(without_marks(F.coalesce("text", F.lit(""))), F.lit(reach)).alias("there"))
    runs = longest_common_runs(asked.join(there, ["vid", "id"]), left="here", right="there", least=least)
    return runs.where((F.col("at_left") <= start) & (F.col("at_right") <= head)).groupBy("vid", "para").agg(F.min("id").alias("source"))


# --- two readings ----------------------------------------------------------------------------------------------------


def lines_of(*readings: Column) -> Column:
    """The lines of the readings in order, cut at line ends and full stops of either width, trimmed, two characters at least."""
    cut = F.split(F.concat_ws("\n", *readings), "[\n；;。]")
    return F.filter(F.transform(cut, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: F.length(x) >= 2)


def _letters(line: Column) -> Column:
    """The characters of a line, each with the number of its occurrence."""
    often = lambda c: F.length(line) - F.length(F.replace(line, c, F.lit("")))
    return F.flatten(F.transform(F.array_distinct(F.split(line, "")), lambda c: F.transform(F.sequence(F.lit(1), often(c)), lambda k: F.concat(c, k.cast("string")))))


def could_be_alike(a: Column, b: Column, least: float) -> Column:
    """Whether two lines (structs of ``size`` and ``letters``) can be alike: twice the characters that they share, wherever they stand, are
    ``least`` of all their characters; first by their lengths alone."""
    total = (a["size"] + b["size"]) * least - 1e-9
    return F.when(2 * F.least(a["size"], b["size"]) < total, F.lit(False)).otherwise(2 * F.array_size(F.array_intersect(a["letters"], b["letters"])) >= total)


def _alike(least: float):
    def of_row(lines, others) -> list[bool]:
        held: dict[str, difflib.SequenceMatcher] = {}  # a matcher prepares its second text once
        out = []
        for x, y in zip(lines, others, strict=True):
            if y not in held:
                held[y] = difflib.SequenceMatcher(None, "", y)
            held[y].set_seq1(x)
            out.append(held[y].ratio() >= least)
        return out

    @F.pandas_udf("array<boolean>")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([of_row(p, q) for p, q in zip(a, b, strict=True)])

    return alike


def consensus(df: DataFrame, *, readings: list[str], out: str = "consensus", least: float = 0.8, separator: str = "；") -> DataFrame:
    """``df`` with the lines of its readings joined, without lines that are alike a kept one before (a ratio of matching blocks of ``least``).

    Equal lines are one from the start: a later one is alike whatever the first is alike, and the first itself. Only pairs that lengths and
    characters allow to be alike are compared block by block; the greedy choice among what is alike is an aggregate over the row's lines. Null readings have no lines; a row without lines has an empty text.
    """
    rows = df.select(F.struct(*map(F.col, df.columns)).alias("row"), F.array_distinct(lines_of(*map(F.col, readings))).alias("lines"))
    told = rows.withColumn("told", F.transform("lines", lambda x: F.struct(F.length(x).alias("size"), _letters(x).alias("letters"))))

    def earlier(x: Column, i: Column) -> Column:
        """The lines before the i-th that it may be alike."""
        may = F.filter(F.transform(F.slice(F.col("told"), 1, i), lambda y, j: F.struct(j.alias("j"), could_be_alike(x, y, least).alias("may"))), lambda p: p["may"])
        return F.transform(may, lambda p: F.struct(i.alias("i"), p["j"].alias("j")))

    paired = told.select("row", "lines", F.flatten(F.transform("told", earlier)).alias("pairs"))
    line = lambda n: F.transform("pairs", lambda p: F.col("lines")[p[n]])
    judged = paired.withColumn("same", F.when(F.size("pairs") > 0, _alike(least)(line("i"), line("j"))))
    twins = F.transform(F.filter(F.arrays_zip("pairs", "same"), lambda z: z["same"]), lambda z: z["pairs"])
    none = F.array().cast("array<int>")

    def step(kept: Column, i: Column) -> Column:
        again = F.exists(F.col("twins"), lambda t: (t["i"] == i) & F.array_contains(kept, t["j"]))
        return F.when(again, kept).otherwise(F.concat(kept, F.array(i)))

    chosen = judged.select("row", "lines", F.coalesce(twins, F.array().cast("array<struct<i:int,j:int>>")).alias("twins"))
    kept = F.aggregate(F.sequence(F.lit(0), F.size("lines") - 1), none, step)
    text = F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), separator)
    return chosen.select("row.*", F.when(F.size("lines") > 0, text).otherwise(F.lit("")).alias(out))
