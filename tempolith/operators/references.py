"""Votes of reference rows: AGG-29.

Each key keeps a bounded reservoir of its own rows, evenly spaced. A row gets a vote from each reference that lies far enough away in
order, looks different as a whole and the same in a part: what stays in that part while the rest changes is resident.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import met_by, numbered

#: Copies of a key's references, so that the rows of a large key are dealt to as many tasks.
SALTS = 16


def rms_distance(a: Column, b: Column, size: int) -> Column:
    """Root of the mean squared difference of two arrays of ``size`` doubles; null if one is null or holds a null."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / size)


def stride(rows: Column, *, usual: int, least: int, most: int) -> Column:
    """How far apart references are: ``usual``, wider where there would be more than ``most``, closer where there would be under ``least``."""
    wide, close = F.ceil(rows / most), F.greatest(F.lit(1).cast("long"), F.floor(rows / least))
    usually = F.lit(max(1, usual)).cast("long")
    n = F.floor(rows / usually)
    return F.when(n > most, wide).when((n < least) & (rows >= least), close).otherwise(usually)


def reference_votes(
    df: DataFrame, *, key: Sequence[str], order: Sequence[str], vector: str, width: int, part: tuple[int, int], same: float, apart: float, usual: int = 8, least: int = 128, most: int = 512, gap: int = 40, rows_per_range: int = 1_000_000
) -> DataFrame:
    """``df``'s key and order columns with ``i`` (place within the key) and ``votes``.

    A reference at least ``gap`` rows away (a quarter of the key's rows, where that is less) votes if the whole vectors are ``apart`` or more
    from each other and the components ``part`` are within ``same``. ``order`` must be complete within a key. A row whose vector is null or too
    short has no votes and gives none. Each row meets ``most`` references at the most.
    """
    components = F.when(F.size(vector) >= width, F.slice(F.col(vector).cast("array<double>"), 1, width))
    placed = numbered(df.select(*key, *order, components.alias("_v")), key=key, order=order, rows_per_range=rows_per_range)
    sizes = placed.groupBy(*key).agg(F.count("*").alias("_rows"))
    rows = met_by(placed, sizes, key)
    first, last = part
    rows = rows.withColumn("_p", F.slice("_v", first + 1, last - first))
    salted = rows.withColumn("_salt", (F.col("i") % SALTS).cast("int"))
    chosen = rows.where(F.col("i") % stride(F.col("_rows"), usual=usual, least=least, most=most) == 0)
    references = chosen.select(*key, F.col("i").alias("_i"), F.col("_v").alias("_r"), F.col("_p").alias("_q"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"))
    far = F.abs(F.col("i") - F.col("_i")) >= F.least(F.lit(gap).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("_rows") / 4)))
    # the part is short and few pairs pass it; only those are compared as a whole
    near = met_by(salted, references, [*key, "_salt"], "inner", far & (rms_distance(F.col("_p"), F.col("_q"), last - first) <= same))
    votes = near.where(rms_distance(F.col("_v"), F.col("_r"), width) >= apart).groupBy(*key, "i").agg(F.count("*").alias("votes"))
    return met_by(placed.drop("_v"), votes, [*key, "i"]).withColumn("votes", F.coalesce("votes", F.lit(0).cast("long")))
