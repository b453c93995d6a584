"""Choosing rows: best per group, overrides, spaced samples, ordered priorities, order-keeping distinct.

TOP-01 to TOP-09, SRC-06, SRC-10, SRC-11, J-02, J-17, SET-01, SET-04, AGG-15, AGG-16, ORC-17, ORC-22, ORC-28.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_group(df: DataFrame, *, key: Sequence[str], score: Column, ties: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """The row of the highest score of each group, reduced before the exchange; ``ties`` prefer the largest."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(score, *ties)).alias("_b")).select(*key, "_b.*")


def candidate_score(chars: Column, ink: Column, sharp: Column, position: Column) -> Column:
    """Text counts one per character, ink 30, sharpness 5 (full from 0.02 on), a late position a trifle."""
    return 1.0 * chars + 30.0 * ink + 5.0 * F.least(sharp / 0.02, F.lit(1.0)) + 0.001 * position


def with_override(df: DataFrame, *, key: Sequence[str], score: Column, tie: Column, allowed: Column, ident: str) -> DataFrame:
    """The best row of each group, unless another allowed row exists: then the best allowed one."""
    order = F.struct(score, tie)
    return df.groupBy(*key).agg(
        F.max_by(ident, order).alias("best"), F.max_by(F.when(allowed, F.col(ident)), F.when(allowed, order)).alias("best_allowed")
    ).select(*key, F.coalesce("best_allowed", "best").alias("chosen"), (F.col("best_allowed").isNotNull() & (F.col("best_allowed") != F.col("best"))).alias("overridden"), "best")


def spaced_sample(df: DataFrame, *, key: Sequence[str], order: Sequence[str], want: int, floor: bool = False) -> DataFrame:
    """``want`` rows of each group, evenly spaced with both ends and without repeats; all if there are no more.
    Halves round to even. ``floor`` takes the places ``int(i * n / want)`` instead."""
    numbered = df.withColumns({"_i": F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1, "_n": F.count("*").over(Window.partitionBy(*key))})
    if floor:
        places = F.transform(F.sequence(F.lit(0), F.lit(want - 1)), lambda i: F.floor(i * F.col("_n") / want))
    elif want > 1:
        places = F.transform(F.sequence(F.lit(0), F.lit(want - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (want - 1)).cast("long"))
    else:
        places = F.array(F.lit(0).cast("long"))
    return numbered.where((F.col("_n") <= want) | F.array_contains(places, F.col("_i").cast("long"))).drop("_i", "_n")


def candidate_pool(df: DataFrame, *, key: Sequence[str], order: str, ink: str, sharp: str, want: int = 6) -> DataFrame:
    """Rows worth looking at closely: first, last, most ink and sharpest are always in, evenly spaced ones fill
    up to ``want``; if more are wanted than fit, an even choice of them is kept."""
    whole = Window.partitionBy(*key)
    ranked = lambda c: F.row_number().over(whole.orderBy(F.desc(c), F.asc(order))) == 1
    numbered = df.withColumns({"_i": F.row_number().over(whole.orderBy(order)) - 1, "_n": F.count("*").over(whole), "_ink": ranked(ink), "_sharp": ranked(sharp)})
    forced = (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | F.col("_ink") | F.col("_sharp")
    places = F.transform(F.sequence(F.lit(0), F.lit(want - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / max(want - 1, 1)).cast("long"))
    pool = numbered.where((F.col("_n") <= want) | forced | F.array_contains(places, F.col("_i").cast("long"))).withColumn("_forced", forced.cast("int"))
    kept = pool.withColumn("_k", F.row_number().over(whole.orderBy(F.desc("_forced"), F.pmod(F.col("_i") * 7919, F.col("_n")), F.col("_i"))))
    return kept.where(F.col("_k") <= want).drop("_i", "_n", "_ink", "_sharp", "_forced", "_k")


def first_by_priority(df: DataFrame, patterns: Sequence[str], *, key: Sequence[str], name: str, order: str, columns: Sequence[str]) -> DataFrame:
    """The first row (in ``order``) that the earliest matching pattern matches; without any match the first."""
    rank = F.lit(len(patterns))
    for k, p in reversed(list(enumerate(patterns))):
        rank = F.when(F.col(name).rlike(p), k).otherwise(rank)
    return df.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(rank, F.col(order))).alias("_b")).select(*key, "_b.*")


def accepted_or_best(df: DataFrame, *, key: Sequence[str], priority: str, measure: str, least: float, most: float, columns: Sequence[str]) -> DataFrame:
    """Backends in order: the first whose measure is within bounds, else the one of the largest measure
    (which may exceed the upper bound); ties go to the earlier."""
    ok = F.col(measure).between(least, most)
    rank = F.struct(F.when(ok, 0).otherwise(1), F.when(ok, F.col(priority).cast("double")).otherwise(-F.coalesce(measure, F.lit(-1.0))), F.col(priority), F.col(measure))
    return df.groupBy(*key).agg(F.min_by(F.struct(*columns, ok.alias("accepted")), rank).alias("_b")).select(*key, "_b.*")


def latest(df: DataFrame, *, key: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last row of each key's ledger."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_b")).select(*key, "_b.*")


def distinct_in_order(df: DataFrame, *, key: Sequence[str], value: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each value."""
    w = Window.partitionBy(*key, value).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def least_passing(df: DataFrame, *, key: Sequence[str], guards: Column, cost: str, ident: str) -> DataFrame:
    """Of the candidates that pass all guards the one of the least cost, and every candidate tried with its
    verdict, in order of cost."""
    return df.groupBy(*key).agg(
        F.min_by(F.when(guards, F.col(ident)), F.when(guards, F.struct(cost, ident))).alias("chosen"),
        F.array_sort(F.collect_list(F.struct(F.col(cost), F.col(ident), guards.alias("passed")))).alias("tried"),
        F.count("*").alias("n_tried"),
    )


def against_group_median(df: DataFrame, *, key: Sequence[str], value: str, out: str = "group_median") -> DataFrame:
    """Add the group's exact median of ``value``; one number per group is joined back."""
    medians = df.groupBy(*key).agg(F.percentile(value, 0.5).alias(out))
    return df.join(medians, list(key), "left")


def first_available(base: DataFrame, *others: tuple[DataFrame, str], key: Sequence[str], column: str) -> DataFrame:
    """``base``'s column, else that of the first other table that has it; ``source`` names which."""
    out, value, source = base.withColumnRenamed(column, "_v0"), F.col("_v0"), F.when(F.col("_v0").isNotNull(), "base")
    for k, (df, name) in enumerate(others, 1):
        out = out.join(df.select(*key, F.col(column).alias(f"_v{k}")), list(key), "full")
        source = F.coalesce(source, F.when(F.col(f"_v{k}").isNotNull(), name)) if k > 1 else F.when(F.col("_v0").isNotNull(), "base").otherwise(F.when(F.col("_v1").isNotNull(), name))
        value = F.coalesce(value, f"_v{k}")
    return out.withColumns({column: value, "source": source}).drop(*[f"_v{k}" for k in range(len(others) + 1)])


def candidate_document(c: Column) -> Column:
    """What is written of a candidate: its numbers rounded, its role with the evidence, and what hides it."""
    same = [c[n].alias(n) for n in ("role", "role_evidence", "occlusion")]
    return F.struct(c["t"].alias("t"), c["file"].alias("file"), F.bround(c["score"], 4).alias("score"), c["ocr_chars"].alias("ocr_chars"), F.bround(c["ink"], 4).alias("ink"), *same, F.coalesce(c["transient_overlay"], F.lit(False)).alias("transient_overlay"))


def chosen_document(c: Column) -> Column:
    """What is written of the chosen one: its text, sharpness and hash too."""
    text = F.coalesce(c["ocr_text"], F.lit(""))
    return F.struct(c["t"].alias("t"), c["file"].alias("file"), F.bround(c["score"], 4).alias("score"), c["ocr_chars"].alias("ocr_chars"), text.alias("ocr_text"), F.bround(c["ink"], 4).alias("ink"), F.bround(c["sharp"], 5).alias("sharp"), c["dhash"].alias("dhash"), c["role"].alias("role"), c["role_evidence"].alias("role_evidence"))
