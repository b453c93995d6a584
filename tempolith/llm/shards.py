"""Sharding by histogram sort.

Documents are ordered by (hash of the text, document id). Shard boundaries are keys in that order. They are
found by rounds: every task counts the exact bytes and rows below a set of candidate keys, the sums narrow
the interval in which each boundary lies, and new candidates are drawn there until the boundary's bytes are
within tolerance of its target or no document is left between. Then rows are exchanged once. The same
rounds find boundaries of smaller ranges inside shards, whose exact row counts give each range's first
slot, so that no task has to see a whole shard.

The law is ``bytes``: shards hold near-equal bytes. Equal texts have equal hashes and so stand together; they
stay in one shard unless a boundary's tolerance is smaller than their group, in which case the group is
split by document id. Null texts count one byte and hash as the empty text; null ids come first; rows that
repeat both text and id can't be told apart and stay in one shard. Other columns pass through; those with a result's name get
``_input`` after theirs. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import store

SHARDS = 8
#: How far a shard's boundary may be from its target, as a share of a shard's bytes; of a range's, for ranges.
TOLERANCE, RANGE_TOLERANCE = 0.001, 0.2
#: Candidates per boundary and round.
FAN = 24
#: Bytes of a range, which one task writes. So the ranges grow with the table, and no task does.
RANGE_BYTES = 64_000_000
LEAST = -(1 << 63)
MOST = (1 << 63) - 1

Key = tuple[int, int]
HISTOGRAM = "bucket int, rows long, bytes long, min_h long, max_h long, min_d long, max_d long"


class Buckets:
    """How many of the sorted probes are at or below each key."""

    def __init__(self, probes: list[Key]):
        self.h, self.d = (np.array([p[i] for p in probes], np.int64) for i in (0, 1))
        self.heads, self.first, self.count = np.unique(self.h, return_index=True, return_counts=True)

    def of(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.h, h, "left")
        at = np.searchsorted(self.heads, h)
        tied = np.flatnonzero(self.heads[np.minimum(at, len(self.heads) - 1)] == h) if len(self.heads) else np.zeros(0, np.int64)
        for group in np.unique(at[tied]):  # only keys whose hash is itself a probe
            rows = tied[at[tied] == group]
            out[rows] += np.searchsorted(self.d[self.first[group] : self.first[group] + self.count[group]], d[rows], "right")
        return out


def histogram(keys: DataFrame, probes: list[Key]) -> dict[int, tuple]:
    """Exact rows, bytes and extreme keys between neighbouring probes; as many rows as probes at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, buckets = len(probes) + 1, Buckets(probes)
        rows, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low_h, high_h, low_d, high_d = np.full(n, MOST), np.full(n, LEAST), np.full(n, MOST), np.full(n, LEAST)
        for batch in batches:
            h, d, b = (batch.column(i).to_numpy() for i in range(3))
            k = buckets.of(h, d)
            rows += np.bincount(k, minlength=n)
            np.add.at(size, k, b)
            np.minimum.at(low_h, k, h)
            np.maximum.at(high_h, k, h)
            np.minimum.at(low_d, k, d)
            np.maximum.at(high_d, k, d)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *(pa.array(x[used]) for x in (rows, size, low_h, high_h, low_d, high_d))],
            names=["bucket", "rows", "bytes", "min_h", "max_h", "min_d", "max_d"],
        )

    parts = keys.mapInArrow(count, HISTOGRAM).groupBy("bucket")
    summed = parts.agg(F.sum("rows"), F.sum("bytes"), F.min("min_h"), F.max("max_h"), F.min("min_d"), F.max("max_d"))
    return {row[0]: tuple(row[1:]) for row in summed.collect()}


class Boundary:
    """A target in bytes and the interval of keys in which its boundary lies."""

    def __init__(self, target: float, tolerance: float, rows: int, size: int):
        self.target, self.tolerance = target, tolerance
        self.low, self.high = (LEAST, LEAST), (MOST, MOST)
        self.below_low, self.below_high = (0, 0), (rows, size)  # rows and bytes below
        self.settled: Key | None = None
        self._try()

    def _try(self, exhausted: bool = False) -> None:
        off_low, off_high = self.target - self.below_low[1], self.below_high[1] - self.target
        if exhausted or min(off_low, off_high) <= self.tolerance:
            nearest = off_low <= off_high
            self.settled, self.rows_below, self.bytes_below = (self.low, *self.below_low) if nearest else (self.high, *self.below_high)

    def probes(self, fan: int) -> list[Key]:
        (h0, d0), (h1, d1) = self.low, self.high
        if h0 < h1:
            step = max(1, (h1 - h0) // fan)
            drawn = [(x, LEAST) for x in range(h0 + step, h1 + 1, step)]
        else:  # one hash: inside a group of equal texts
            step = max(1, (d1 - d0) // fan)
            drawn = [(h0, x) for x in range(d0 + step, d1 + 1, step)]
        return [*drawn, self.low, self.high]

    def narrow(self, probes: list[Key], k: int, found: tuple, below: tuple[int, int]) -> None:
        """The boundary lies in bucket ``k``; ``found`` is that bucket, ``below`` the rows and bytes before it."""
        rows, size, min_h, max_h, min_d, max_d = found
        self.below_low, self.below_high = below, (below[0] + rows, below[1] + size)
        start, end = probes[k - 1] if k else (LEAST, LEAST), probes[k] if k < len(probes) else (MOST, MOST)
        if min_h < max_h:
            self.low = max(start, (min_h, LEAST))
            self.high = min(end, (max_h + 1, LEAST)) if max_h < MOST else end
            self._try()
        else:
            self.low, self.high = (min_h, min_d), (min_h, max_d + 1)
            self._try(exhausted=min_d == max_d)


def settle(open_: list[Boundary], probes: list[Key], found: dict[int, tuple]) -> None:
    """Narrow every open boundary to the bucket that its target lies in: the first whose bytes reach it."""
    used = sorted(found)  # buckets with rows, and the rows and bytes up to the end of each
    rows_to, bytes_to = (np.cumsum([found[k][i] for k in used]) for i in (0, 1))
    for b, place in zip(open_, np.searchsorted(bytes_to, [b.target for b in open_], "left"), strict=True):
        place = min(place, len(used) - 1)
        k = used[place]
        rows_in, bytes_in = found[k][:2]
        b.narrow(probes, k, found[k], (int(rows_to[place]) - rows_in, int(bytes_to[place]) - bytes_in))


def find_boundaries(keys: DataFrame, shards: int, *, ranges: int | None = None, tolerance: float = TOLERANCE, range_tolerance: float = RANGE_TOLERANCE, fan: int = FAN) -> tuple[list[tuple[Key, int]], int]:
    """The starts of all ranges but the first with the exact rows below them, and how many ranges each shard has: as
    many as ``RANGE_BYTES`` asks for."""
    total = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    rows, size = int(total[0]), int(total[1])
    ranges = ranges or max(1, -(-size // (shards * RANGE_BYTES)))
    n = shards * ranges
    bounds = [Boundary(size * k / n, (tolerance * size / shards) if k % ranges == 0 else (range_tolerance * size / n), rows, size) for k in range(1, n)]
    while open_ := [b for b in bounds if b.settled is None]:
        probes = sorted({p for b in open_ for p in b.probes(fan)})
        found = histogram(keys, probes)
        settle(open_, probes, found)
    return [(b.settled, b.rows_below) for b in bounds], ranges


RESULTS = ("size", "shard", "slot")


def sharded(df: DataFrame, *, shards: int = SHARDS, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """``df`` with ``size``, ``shard`` and ``slot``, each partition holding one range of one shard in order."""
    from pyspark.sql.functions import pandas_udf

    size = (F.coalesce(F.octet_length(store.column(text)), F.lit(0)) + 1).cast("long").alias("size")
    h = F.xxhash64(F.coalesce(store.column(text), F.lit(""))).alias("h")
    d = F.coalesce(store.column(key).cast("long"), F.lit(LEAST + 1)).alias("d")
    keys = store.materialise(df.select(h, d, size), "shard-keys")
    bounds, ranges = find_boundaries(keys, shards, ranges=ranges)
    store.discard(keys)
    starts = [b[0] for b in bounds]
    below = [0, *(b[1] for b in bounds)]

    begin = np.array([below[i] - below[i - i % ranges] for i in range(len(below))], np.int64)

    def locate(h, d):
        import pandas as pd

        k = Buckets(starts).of(h.to_numpy(), d.to_numpy()) if starts else np.zeros(len(h), np.int64)
        return pd.DataFrame({"range": k.astype(np.int32), "first": begin[k]})

    located = pandas_udf(locate, "range int, first long")
    placed = df.select(store.whole_row(df, RESULTS).alias("row"), h, d, size).withColumn("at", located("h", "d"))
    dealt = placed.select("*", F.col("at.range").alias("range")).repartitionById(shards * ranges, F.col("range"))
    order = Window.partitionBy("range").orderBy("h", "d")
    return dealt.select(
        "row.*",
        "size",
        F.floor(F.col("range") / ranges).cast("int").alias("shard"),
        (F.col("at.first") + F.row_number().over(order) - 1).cast("long").alias("slot"),
    )


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = store.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharded(documents).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op1: every document once with its size, and whether slots are gapless and shards near equal."""
    rows = op1_histogram_sort(spark, sf_dir)
    shard = rows.groupBy("shard").agg(F.sum("size").alias("bytes"), (F.count_distinct("slot") == F.count("*")).alias("own"), (F.max("slot") == F.count("*") - 1).alias("dense"))
    whole = shard.agg(F.bool_and(F.col("own") & F.col("dense")).alias("gapless"), (F.max("bytes") - F.min("bytes")).alias("apart"), F.count("*").alias("shards"))
    sizes = rows.groupBy("law").agg(F.count("*").alias("documents"), F.count_distinct("doc_id").alias("ids"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    return sizes.join(F.broadcast(whole), F.lit(True)).select("law", "documents", "ids", "bytes", "shards", "gapless", (F.col("apart") <= F.col("largest") + 0.003 * F.col("bytes")).alias("near_equal"))


QUERIES = {"op1_histogram_sort": op1_histogram_sort, "shard_sizes": shard_sizes}
SQL = {"shard_sizes": "SELECT 'bytes' AS law, count(*) AS documents, count(DISTINCT doc_id) AS ids, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS bytes, 8 AS shards, true AS gapless, true AS near_equal FROM documents"}
