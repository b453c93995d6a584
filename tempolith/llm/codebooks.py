"""Vector compression with a codebook for each part of the vectors.

Components become integers, vectors are cut into ``PARTS`` equal parts, and equal parts at a position become one row with a
weight: a vector that a third of all rows repeat costs no more than any other. Rounds of Lloyd run over these distinct rows: every task
assigns its rows to the entries (the least squared distance, ties to the lower index) and sums weights and weighted components by
entry in numpy, Spark adds up the tasks' sums, and the driver divides: it sees one row for each entry and part, whatever the
table holds. At last codes and errors are joined to the vectors by position and part.

Rows are dropped whose vector is null, holds null or non-finite components, is empty, has a length that ``PARTS`` doesn't divide, or
another length than most vectors have (of equally common lengths the longer). The codebooks start with the smallest ids: nulls
come last, rows that repeat an id in the order of their integers. Other repeated rows and ids are vectors like any other. With fewer vectors
than entries there are fewer entries; an empty table gives an empty result. Components beyond 2^63 / 256 count as the nearest 64-bit
integer; sums and distances are exact (in floating point or 64 bits where those are, else in Python's integers), and errors
beyond 64 bits as the largest such number. Other columns pass through ``compressed``; those with a result's name get ``_input`` after theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
MOST = (1 << 63) - 1
#: Rows that a task compares with the entries at once.
SLICE = 8192
RESULTS = ("code", "error", "label_error", "codebooks_sha256")

Codebooks = list[np.ndarray]  # by part: entries x components


def exact(largest: int, terms: int) -> type:
    """The number type in which sums of ``terms`` products of numbers up to ``largest`` are exact."""
    bound = 4 * terms * largest * largest
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max())))


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first of the nearest entries, and the squared distance."""
    kind = exact(max(largest(rows), largest(entries)), rows.shape[1])
    x, c = rows.astype(kind), entries.astype(kind)
    apart = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    at = apart.argmin(1)
    return at, apart[np.arange(len(x)), at]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def kept_integers(df: DataFrame, *, key: str, vector: str, parts: int = PARTS, keep: Sequence[str] | None = None) -> tuple[DataFrame, int]:
    """``row`` (the columns of ``keep``, all if not given), ``key`` and ``x`` (integer components) of the rows that are kept, and their length."""
    v = store.column(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    row = store.whole_row(df.select(*map(store.column, df.columns if keep is None else keep)), RESULTS)
    held = df.select(row.alias("row"), store.column(key).alias("key"), v.alias("v")).where(v.isNotNull() & finite & (F.size(v) > 0) & (F.size(v) % parts == 0))
    common = held.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = common[0] if common else parts
    return held.where(F.size("v") == width).select("row", "key", F.transform("v", lambda x: F.floor(F.lit(SCALE) * x.cast("double"))).alias("x")), width


def first_codebooks(rows: DataFrame, width: int, parts: int, entries: int) -> Codebooks:
    start = rows.select("key", "x").orderBy(F.asc_nulls_last("key"), "x").limit(entries).collect()
    whole = np.array([r.x for r in start], object).reshape(len(start), width)
    return [whole[:, p * (width // parts) : (p + 1) * (width // parts)] for p in range(parts)]


def distinct_parts(vectors: DataFrame, width: int, parts: int) -> DataFrame:
    """Each different part at a position with its weight; vectors are counted in their tasks before anything is exchanged."""
    cut = vectors.select(F.posexplode(_cut(width, parts)).alias("position", "part"))
    return cut.groupBy("position", "part").agg(F.count("*").alias("weight"))


def _cut(width: int, parts: int):
    step = width // parts
    return F.array(*[F.slice("x", p * step + 1, step) for p in range(parts)])


def improved(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry moves to the floor of its parts' mean, those without any stay."""
    width = books[0].shape[1]
    schema = f"position int, entry int, weight decimal(38, 0), {', '.join(f's{i} decimal(38, 0)' for i in range(width))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((len(books), len(books[0])), object)
        sums = np.zeros((len(books), len(books[0]), width), object)
        for batch in batches:
            position, weight, part = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(1), width)
            for p in np.unique(position):
                mine = np.flatnonzero(position == p)
                for lot in np.array_split(mine, -(-len(mine) // SLICE)):
                    at, _ = nearest(part[lot], books[p])
                    order = np.argsort(at, kind="stable")
                    found, begin = np.unique(at[order], return_index=True)
                    small = largest(part[lot]) * int(weight[lot].sum()) <= MOST
                    rows = (part[lot] if small else part[lot].astype(object)) * weight[lot][:, None]
                    weights[p, found] += np.add.reduceat(weight[lot][order], begin).astype(object)
                    sums[p, found] += np.add.reduceat(rows[order], begin, axis=0).astype(object)
        p, e = np.nonzero(weights)
        if len(p):
            number = pa.decimal128(38, 0)
            columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array([int(x) for x in weights[p, e]], number)]
            columns += [pa.array([int(x) for x in sums[p, e, i]], number) for i in range(width)]
            yield pa.RecordBatch.from_arrays(columns, names=["position", "entry", "weight", *(f"s{i}" for i in range(width))])

    summed = distinct.mapInArrow(run, schema).groupBy("position", "entry").agg(F.sum("weight"), *[F.sum(f"s{i}") for i in range(width)])
    out = [book.copy() for book in books]
    for p, e, weight, *sums in summed.collect():  # one row for each entry of each part
        out[p][e] = [int(s) // int(weight) for s in sums]
    return out


def assigned(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """Each distinct part with its entry and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books[0].shape[1]
        for batch in batches:
            position, part = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            at, off = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
            for p in np.unique(position):
                mine = np.flatnonzero(position == p)
                for lot in np.array_split(mine, -(-len(mine) // SLICE)):
                    at[lot], far = nearest(part[lot], books[p])
                    off[lot] = np.minimum(far, MOST) if far.dtype == object else far
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at), pa.array(off)], names=["position", "part", "entry", "off"])

    return distinct.select("position", "part").mapInArrow(run, "position int, part array<long>, entry int, off long")


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.flat).encode()).hexdigest()


def learned(vectors: DataFrame, width: int, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """The distinct parts of ``vectors`` (columns ``key`` and ``x``), and the codebooks after all rounds."""
    books = first_codebooks(vectors, width, parts, entries)
    distinct = store.materialise(distinct_parts(vectors, width, parts), "codebook-parts")
    for _ in range(rounds if len(books[0]) else 0):
        books = improved(distinct, books)
    return distinct, books


def _capped(total):
    return F.least(total, F.lit(MOST)).cast("long")


def compressed(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, keep: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``df`` that are kept (of its columns those of ``keep``, all if not given) with the columns of ``RESULTS``."""
    integers, width = kept_integers(df.withColumn(labels := store.free_name(df, "labels"), store.column(label)), key=key, vector=vector, parts=parts, keep=[*(df.columns if keep is None else keep), labels])
    numbered = integers.select(F.monotonically_increasing_id().alias("number"), F.col(f"row.{labels}").alias("label"), F.col("row").dropFields(labels).alias("row"), "key", "x")
    vectors = store.materialise(numbered, "codebook-vectors")  # written once, so that numbers stay
    distinct, books = learned(vectors, width, parts=parts, entries=entries, rounds=rounds)
    codes = store.materialise(assigned(distinct, books), "codebook-codes") if len(books[0]) else assigned(distinct, books)
    pieces = vectors.select("number", F.posexplode(_cut(width, parts)).alias("position", "part")).join(codes, ["position", "part"])
    packed = F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda s: F.lower(F.lpad(F.hex(s["entry"]), 2, "0")))
    coded = pieces.groupBy("number").agg(F.array_join(packed, "").alias("code"), _capped(F.sum(F.col("off").cast("decimal(38, 0)"))).alias("error"))
    whole = store.materialise(vectors.select("number", "row", "label").join(coded, "number").drop("number"), "codebook-whole")
    for table in (vectors, distinct, codes):
        store.discard(table)
    sums = store.materialise(whole.groupBy("label").agg(_capped(F.sum(F.col("error").cast("decimal(38, 0)"))).alias("label_error")), "codebook-labels")
    sent = store.bounded(sums.select(F.col("label").alias("_label"), "label_error"), store.SENT_ROWS)
    out = whole.join(sent, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("row.*", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(store.read_table(spark, sf_dir, "embeddings"), keep=["vec_id"]).select("vec_id", *RESULTS)


def _rounds_in_sql() -> str:
    """The rounds as one CTE after another: entries by (position, entry), parts by their list of integers."""
    assign = """
        near{r} AS (
            SELECT position, part, weight, min_by(entry, off * {entries} + entry) AS entry, min(off) AS off FROM (
                SELECT d.*, b.entry, list_sum(list_transform(list_zip(d.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS off
                FROM parts d JOIN book{r} b USING (position)
            ) GROUP BY ALL
        ),"""
    move = """
        mean{r} AS (
            SELECT position, entry, list((s - ((s % c) + c) % c) // c ORDER BY i) AS part FROM (
                SELECT position, entry, i, sum(weight * part[i])::BIGINT AS s, sum(weight)::BIGINT AS c FROM near{r}, range(1, 5) AS t(i) GROUP BY ALL
            ) GROUP BY ALL
        ),
        book{n} AS (SELECT position, entry, coalesce(m.part, b.part) AS part FROM book{r} b LEFT JOIN mean{r} m USING (position, entry)),"""
    return "".join(assign.format(r=r, entries=ENTRIES) + move.format(r=r, n=r + 1) for r in range(ROUNDS)) + assign.format(r=ROUNDS, entries=ENTRIES)


QUERIES = {"op13_codebooks": op13_codebooks}
SQL = {
    "op13_codebooks": f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        cut AS (SELECT vec_id, place, position, list_slice(x, position * 4 + 1, position * 4 + 4) AS part FROM kept, range({PARTS}) AS t(position)),
        parts AS (SELECT position, part, count(*) AS weight FROM cut GROUP BY ALL),
        book0 AS (SELECT position, place AS entry, part FROM cut WHERE place < {ENTRIES}),
        {_rounds_in_sql()}
        coded AS (SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY position) AS code, sum(off)::BIGINT AS error FROM cut JOIN near{ROUNDS} USING (position, part) GROUP BY ALL),
        whole AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM book{ROUNDS})
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), whole
    """,
}
