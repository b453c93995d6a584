"""Exact deduplication with a log-structured merge index of text digests. Built-in functions only.

* Every task is a memtable: it digests its rows, once, and flushes them as runs sorted by digest, in files of at
  most ``MEMTABLE_ROWS`` entries. A run has a filter: a bitmap of ``FILTER_BITS`` bits for an entry.
* Compaction merges runs into one of the next level, in ranges of digests: one entry per digest, with the smallest and largest
  document id and the count of rows. ``FAN`` runs of a level make one of the next, so there are never many.
* A batch is looked up run by run: digests outside a run's range, or whose bit its filter lacks, need no look at its entries.
* Hits are verified byte by byte: only rows that share a digest have their normalised texts
  grouped under it, in every task before anything is exchanged, and a digest with more
  than one text is a collision. Should one ever occur, texts instead of digests decide.

Texts are compared after lower-casing A-Z; null counts as empty. A null id never stays if a row with an id
has the same text. Repeated rows form one group; of
rows with equal text and id all count, and the id stays. An empty table gives an empty result. Other columns
pass through ``survivors`` and ``lookup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

MEMTABLE_ROWS, FAN, FILTER_BITS = 2_000_000, 4, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str = "text") -> Column:
    return F.translate(F.coalesce(store.column(text), F.lit("")), UPPER, LOWER)


def digest(text: str = "text") -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _place(bits: int) -> Column:
    """Where in a filter of ``bits`` bits the digest's bit is, from 1."""
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(bits)) + 1


class MergeIndex:
    """Levels of runs in one folder; ``levels[k]`` has the paths of level ``k``'s runs and their entries."""

    def __init__(self, spark: SparkSession, path: str | None = None, memtable_rows: int = MEMTABLE_ROWS):
        self.spark, self.path, self.memtable_rows = spark, path or store.fresh_path(spark, "merge-index"), memtable_rows
        self.levels: list[list[tuple[str, int]]] = []
        self.written = 0

    def _write(self, entries: DataFrame, level: int) -> str:
        at = f"{self.path}/run-{self.written:04d}"
        self.written += 1
        entries.sortWithinPartitions("digest").write.option("maxRecordsPerFile", self.memtable_rows).parquet(f"{at}/entries")
        run = self.spark.read.parquet(f"{at}/entries")
        rows = run.count()
        place = _place(self._bits(rows))
        filled = run.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        filled.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("filter")).write.parquet(f"{at}/filter")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((at, rows))
        return at

    @staticmethod
    def _bits(rows: int) -> int:
        return FILTER_BITS * max(rows, 1)

    def _merge(self, runs: list[tuple[str, int]], into: int, keep: bool = False) -> None:
        merged = self.spark.read.parquet(*[f"{at}/entries" for at, _ in runs]).groupBy("digest")
        merged = merged.agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("rows").alias("rows"))
        self._write(merged.repartitionByRange("digest"), into)
        for at, _ in () if keep else runs:
            store.drop_path(self.spark, at)

    def flush(self, df: DataFrame, *, key: str = "doc_id", text: str = "text") -> None:
        """Add a batch of documents: each task's rows, sorted by digest, become a run; full levels are merged."""
        self._write(df.select(digest(text).alias("digest"), store.column(key).alias("least"), store.column(key).alias("most"), F.lit(1).cast("long").alias("rows")), 0)
        level = 0
        while len(self.levels[level]) >= FAN:
            full, self.levels[level] = self.levels[level], []
            self._merge(full, level + 1)
            level += 1

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{at}/entries" for runs in self.levels for at, _ in runs])

    def compact(self, keep: bool = False) -> None:
        """Merge all runs into one, in ranges of digests, one entry per digest. ``keep`` leaves the old runs' files."""
        runs = [run for level in self.levels for run in level]
        top = len(self.levels)
        self.levels = [[] for _ in self.levels]
        self._merge(runs, top, keep)

    def entries(self) -> DataFrame:
        """One entry per digest; after ``compact`` this is a plain scan."""
        if not self.levels[0] and sum(map(len, self.levels)) == 1:
            return self.runs()
        return self.runs().groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("rows").alias("rows"))

    def passing(self, digests: DataFrame, at: str, rows: int) -> DataFrame:
        """Those of the digests (column ``digest``) that the run's filter lets pass: all that it has, and about one in
        ``FILTER_BITS`` of the others."""
        place = _place(self._bits(rows))
        placed = digests.withColumns({"bucket": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place)})
        held = F.expr("shiftright(cast(conv(hex(substring(filter, bit div 8 + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1")
        return placed.join(self.spark.read.parquet(f"{at}/filter"), "bucket").where(held).select("digest")

    def found(self, digests: DataFrame) -> DataFrame:
        """Entries of those of the different digests (column ``digest``, materialised) that the index has."""
        low, high = digests.agg(F.min("digest"), F.max("digest")).first()
        out = None
        for at, rows in (run for runs in self.levels for run in runs):
            run = self.spark.read.parquet(f"{at}/entries")
            if low is not None:
                run = run.where(F.col("digest").between(F.lit(bytes(low)), F.lit(bytes(high))))  # reaches the files' ranges
            hit = run.join(self.passing(digests, at, rows), "digest")
            out = hit if out is None else out.unionByName(hit)
        return out.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("rows").alias("rows"))

    def lookup(self, batch: DataFrame, stored: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The rows of ``batch`` whose text the index has, with the smallest id that has it as ``indexed_id``. ``stored`` has the
        indexed documents, whose bytes are compared; of texts that share a digest any equal one counts."""
        rows = batch.select(store.whole_row(batch, ["indexed_id"]).alias("row"), digest(text).alias("digest"), normalised(text).alias("bytes"))
        asked = store.materialise(rows.select("digest").distinct(), "merge-asked")
        hits = store.materialise(self.found(asked).select("digest"), "merge-hits")
        texts = stored.select(store.column(key).alias("id"), digest(text).alias("digest"), normalised(text).alias("bytes")).join(hits, "digest", "left_semi")
        known = texts.groupBy("digest", "bytes").agg(F.min("id").alias("indexed_id"))
        return rows.join(known, ["digest", "bytes"]).select("row.*", "indexed_id")


def indexed(df: DataFrame, *, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Each row's (digest, id); one entry per digest; the ids of rows that share a digest; whether two texts share one.
    Texts are digested once, and read again only for hits."""
    spark = df.sparkSession
    index = MergeIndex(spark)
    index.flush(df, key=key, text=text)
    rows = index.runs().select("digest", F.col("least").alias("id"))
    index.compact(keep=True)
    entries = index.entries()
    hits = store.materialise(rows.join(entries.where("rows > 1"), "digest", "left_semi").select("id").distinct(), "merge-hits")
    same = _with_ids(df, hits, key, "left_semi").select(digest(text).alias("digest"), normalised(text).alias("bytes"))
    collided = same.groupBy("digest", "bytes").agg(F.lit(1)).groupBy("digest").count().where("count > 1")
    return rows, entries, hits, bool(collided.limit(1).count())


def _with_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """The rows of ``df`` whose key is among ``ids`` (column ``id``), or with ``left_anti`` is not; a null is an id, too."""
    sent = store.bounded(ids, store.SENT_ROWS)
    return df.join(sent, df[f"`{key}`"].eqNullSafe(sent["id"]), how)


def groups(df: DataFrame, *, key: str = "doc_id", text: str = "text", keep: str = "most") -> DataFrame:
    """Every row's id with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``keep`` is ``most`` or ``least``: whether the largest or the smallest id of equal texts stays.
    """
    rows, entries, _, collided = indexed(df, key=key, text=text)
    on = ["digest"]
    if collided:
        on = ["digest", "bytes"]
        rows = df.select(store.column(key).alias("id"), digest(text).alias("digest"), normalised(text).alias("bytes"))
        entries = rows.groupBy(*on).agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("rows"))
    return rows.join(entries, on).select(
        F.col("id").alias("doc_id"),
        F.col(keep).alias("keep_id"),
        F.col("rows").alias("group_size"),
        F.coalesce(F.col("id") == F.col(keep), F.col(keep).isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: str = "most") -> DataFrame:
    """One row of each group of equal texts, columns as they were; of rows that repeat the id that stays, one. Rows whose id has no
    hit stay as they are; only the others are exchanged."""
    _, _, hits, collided = indexed(docs, key=key, text=text)
    same = _with_ids(docs, hits, key, "left_semi")
    packed = same.select(store.whole_row(same).alias("row"), store.column(key).alias("id"), digest(text).alias("digest"), *([normalised(text).alias("bytes")] if collided else []))
    chosen = F.max_by("row", F.struct(F.col("id").isNotNull(), "id")) if keep == "most" else F.min_by("row", F.struct(F.col("id").isNull(), "id"))
    kept = packed.groupBy("digest", *(["bytes"] if collided else [])).agg(chosen.alias("row")).select("row.*").toDF(*docs.columns)
    return _with_ids(docs, hits, key, "left_anti").unionByName(kept)


def op6_merge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(store.read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_merge_index": op6_merge_index}
SQL = {
    "op6_merge_index": f"""
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents
        ), g AS (
            SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
        )
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g USING (norm)
    """,
}
