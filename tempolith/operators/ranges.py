"""Order over keys of any size: rows in ranges of (key, order), row numbers, and folds that carry their state from range to range.

WIN-04, WIN-07, WIN-08, WIN-12, TOP-02 for keys that one task should not hold.

A range holds about ``rows_per_range`` rows of one or many keys, so a key that has a third of a table lies in many ranges, and a range
boundary cuts one key at most. What is known of cut keys therefore has two rows for each range.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import versions

Step = Callable[[pd.DataFrame, object, bool], tuple[pd.DataFrame, object]]


def in_ranges(df: DataFrame, *, key: Sequence[str], order: Sequence[str], rows_per_range: int) -> DataFrame:
    """``df`` with its range as ``_range``, written down, so that a row's range never changes. Nulls in ``order`` come last."""
    ranges = max(1, -(-df.count() // rows_per_range))
    by = [*(F.asc_nulls_first(k) for k in key), *(F.asc_nulls_last(c) for c in order)]
    table = versions.VersionedTable(df.sparkSession, versions.fresh_folder(df.sparkSession, "ranges"))
    table.write(df.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()))
    return table.read()


def met_by(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "left", also: Column | None = None) -> DataFrame:
    """``a`` with the other columns of ``b`` where the columns ``on`` are equal, nulls included. What ``also`` names must be names of one side."""
    other = {k: f"_on_{k}" for k in on}
    equal = F.lit(True) if also is None else also
    for k, there in other.items():
        equal &= F.col(k).eqNullSafe(F.col(there))
    return a.join(b.withColumnsRenamed(other), equal, how).drop(*other.values())


def running(dealt: DataFrame, *, key: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """The sum of ``value`` over a key's rows up to each row, of a table with ``_range`` (which goes): ranges are added up first, then rows
    within their range. ``order`` must be complete within a key's range."""
    valued = dealt.withColumn("_value", value.cast("long"))
    sums = valued.groupBy(*key, "_range").agg(F.sum("_value").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    later = sums.withColumn("_before", before).where("_before is not null").drop("_sum")
    own = F.sum("_value").over(Window.partitionBy(*key, "_range").orderBy(*[F.asc_nulls_last(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0))
    met = met_by(valued.withColumn("_own", own), later, [*key, "_range"])
    return met.select(*[c for c in dealt.columns if c != "_range"], (F.col("_own") + F.coalesce("_before", F.lit(0).cast("long"))).alias(out))


def numbered(df: DataFrame, *, key: Sequence[str], order: Sequence[str], rows_per_range: int = 1_000_000, out: str = "i") -> DataFrame:
    """``df`` with each row's place within its key, from 0. ``order`` must be complete within a key."""
    placed = running(in_ranges(df, key=key, order=order, rows_per_range=rows_per_range), key=key, order=order, value=F.lit(1), out=out)
    return placed.withColumn(out, F.col(out) - 1)


def fold_in_ranges(df: DataFrame, *, key: Sequence[str], order: Sequence[str], columns: Sequence[str], step: Step, schema: str, rows_per_range: int) -> DataFrame:
    """``step(rows, state, final)`` over each key's rows in order, a range at a time: it gets the state that the key's range before left (none
    at the key's start) and returns its output and the state that it leaves, which JSON must hold; ``final`` tells a key's last range.

    First every range but a key's last is folded as if a key began there. Then each gets the state that the one before left, and those for
    which that is another state than they were folded from are folded again, until none is. Decisions that forget where they
    started, as packing and picking do, need two or three such rounds; the worst need one for each range, and are right, too. What counts from
    a key's start belongs into ``running`` over the result, which keeps ``_range``.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    dealt = in_ranges(df.select(*dict.fromkeys([*key, *order, *columns])), key=key, order=order, rows_per_range=rows_per_range)
    by_range = Window.partitionBy(*key).orderBy("_range")
    spans = dealt.select(*key, "_range").distinct().withColumns({"_final": F.lead("_range").over(by_range).isNull(), "_first": F.lag("_range").over(by_range).isNull()})
    states = versions.VersionedTable(df.sparkSession, versions.fresh_folder(df.sparkSession, "states"))
    states.write(spans.where(~(F.col("_final") & F.col("_first"))).select(*key, "_range", "_final", F.lit(None).cast("string").alias("_state"), F.lit(None).cast("string").alias("_exit"), (~F.col("_final")).alias("_open")))

    def folded(rows: DataFrame, cut: DataFrame, how: str, of: Callable[[pd.DataFrame, str], pd.DataFrame], shape: str) -> DataFrame:
        given = met_by(rows, cut, [*key, "_range"], how).select(*rows.columns, F.coalesce("_final", F.lit(True)).alias("_final"), "_state")

        def run(names, part: pd.DataFrame) -> pd.DataFrame:
            state, final = part["_state"].iloc[0], bool(part["_final"].iloc[0])
            ordered = part.sort_values(list(order), kind="stable").reset_index(drop=True)
            made, left = step(ordered, None if pd.isna(state) else json.loads(state), final)
            out = of(made, json.dumps(left))
            for place, (k, v) in enumerate(zip([*key, "_range"], names, strict=True)):
                out.insert(place, k, v)
            return out

        return given.groupBy(*key, "_range").applyInPandas(run, f"{kinds}, _range int, {shape}")

    while (held := states.read()).where("_open").limit(1).count():
        again = folded(dealt, held.where("_open"), "inner", lambda made, left: pd.DataFrame({"_left": [left]}), "_left string")
        left = met_by(held, again, [*key, "_range"]).withColumn("_exit", F.coalesce("_left", "_exit")).drop("_left").withColumn("_given", F.lag("_exit").over(by_range))
        states.write(left.select(*key, "_range", "_final", F.col("_given").alias("_state"), "_exit", (~F.col("_final") & ~F.col("_given").eqNullSafe(F.col("_state"))).alias("_open")))
    return folded(dealt, states.read(), "left", lambda made, left: made, schema)
