"""Ranked lexical search over document shards.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. One native pass
counts the documents with terms and all their terms. A second pass tokenises each task's documents as bytes and closes a *shard*
after ``SHARD_POSTINGS`` postings: its terms, its postings in CSR form (slots by term, with offsets) and an integer impact for
each posting, worked out beforehand. Shards are rows of a table in the shared folder. Nothing is exchanged for the index.

A search sends a block of at most ``BLOCK_BYTES`` of queries to the shards, which read whole shards and return for each
of their terms the number of its postings; their sums are the document frequencies. Then every shard scores the queries one term
at a time into a dense array of sums, takes its own best ``k`` by ``argpartition`` (all above the k-th score and, of those that
equal it, the smallest ids), and the best of all shards are merged. All is integer but a term's weight.

A query is a row: repeated or null ``item_id`` are queries of their own and come back as they are. Null and empty texts have no
terms: such documents are in no result and such queries have none. Of equal scores the smaller document id comes first, a null id last;
repeated documents count as often as they stand there. A very long text is tokenised in stretches of ``STRETCH`` bytes.
An empty table of either kind gives an empty result. Other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

#: Postings of a shard, some 10 MB with its terms. A task holds one shard, so shards grow in number only.
SHARD_POSTINGS = 1 << 20
STRETCH = 1 << 20
#: Text of the queries that go to every task at once.
BLOCK_BYTES = 8_000_000
TOP = 10
#: The saturation of repeats and the share of the length, in the score's hundredths and thousandths.
SCALE, WEIGHT, SATURATION, FLOOR, SLOPE = 1_000_000_000, 1000, 8, 10, 90
LETTERS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of terms as they are (A-Z lower-cased), all others as a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SHARD = "ids array<long>, terms array<binary>, offsets array<int>, slots array<int>, impacts array<int>"
_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), *((n, pa.list_(pa.int32())) for n in ("offsets", "slots", "impacts"))])


def stretches(text: str | None, size: int = STRETCH) -> Iterator[list[bytes]]:
    """All terms of ``text`` in order, a stretch at a time."""
    raw = (text or "").encode().translate(_TABLE)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def weight(documents: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * df + 1)))


class ShardBuilder:
    """Postings of one shard while it grows."""

    def __init__(self, documents: int, terms: int, postings: int = SHARD_POSTINGS, stretch: int = STRETCH):
        self.documents, self.total, self.postings, self.stretch = documents, terms, postings, stretch
        self._clear()

    def _clear(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting: list[bytes] = []
        self.waiting_slots: list[tuple[int, int]] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        slot, held = len(self.ids), False
        for words in stretches(text, self.stretch):
            if words:
                held = True
                self.waiting += words
                self.waiting_slots.append((slot, len(words)))
                if len(self.waiting) >= self.stretch // 8:
                    self._count()
        if held:
            self.ids.append(doc_id)

    def _count(self) -> None:
        """Turn the words that wait into postings: Arrow numbers the distinct ones, numpy counts pairs."""
        if not self.waiting:
            return
        coded = pa.array(self.waiting, pa.binary()).dictionary_encode()
        numbers = np.fromiter((self.vocabulary.setdefault(t, len(self.vocabulary)) for t in coded.dictionary.to_pylist()), np.int64)
        slots, lengths = (np.array(x, np.int64) for x in zip(*self.waiting_slots, strict=True))
        pairs, tf = np.unique(numbers[coded.indices.to_numpy()] << 32 | np.repeat(slots, lengths), return_counts=True)
        self.parts.append((pairs, tf))
        self.size += len(pairs)
        self.waiting, self.waiting_slots = [], []

    @property
    def full(self) -> bool:
        return self.size + len(self.waiting) >= self.postings

    def close(self) -> pa.RecordBatch | None:
        """The shard as one row, or nothing if it has no terms."""
        self._count()
        if not self.ids:
            return None
        pairs, tf = np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])
        pairs, which = np.unique(pairs, return_inverse=True)
        tf = np.bincount(which, weights=tf, minlength=len(pairs)).astype(np.int64)
        term, slot = pairs >> 32, pairs & 0xFFFFFFFF
        n = np.bincount(slot, weights=tf, minlength=len(self.ids)).astype(np.int64)
        m = FLOOR + SLOPE * n * self.documents // self.total
        impacts = SCALE * tf // (1000 * tf + SATURATION * m[slot])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.vocabulary)))])
        row = {"ids": self.ids, "terms": list(self.vocabulary), "offsets": offsets.astype(np.int32), "slots": slot.astype(np.int32), "impacts": impacts.astype(np.int32)}
        out = pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _ARROW], schema=_ARROW)
        self._clear()
        return out


def built(docs: DataFrame, *, key: str = "doc_id", text: str = "text", postings: int = SHARD_POSTINGS, stretch: int = STRETCH) -> tuple[DataFrame, int]:
    """The shards of ``docs``, and how many documents have terms."""
    terms = F.regexp_count(store.column(text), F.lit(LETTERS))
    documents, total = docs.select(terms.alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    total = total or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = ShardBuilder(documents, total, postings, stretch)
        for batch in batches:
            for doc_id, whole in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, whole.as_py())
                if shard.full:
                    yield shard.close()
        if last := shard.close():
            yield last

    rows = docs.select(store.column(key).cast("long").alias("doc_id"), store.column(text).alias("text"))
    return store.materialise(rows.mapInArrow(run, SHARD), "search-shards", **store.LARGE_ROWS), documents


def blocks_of(queries: DataFrame, key: str, text: str, size: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The queries with terms as (id, distinct terms), in blocks of at most ``size`` bytes of text."""
    block, held = [], 0
    for item_id, whole in queries.select(store.column(key).cast("long"), store.column(text)).toLocalIterator():
        found = sorted({t for words in stretches(whole) for t in words})
        if found:
            block.append((item_id, found))
            held += len(whole)
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def best(scores: np.ndarray, ids: np.ndarray, absent: np.ndarray, k: int) -> np.ndarray:
    """Slots of the ``k`` highest scores above 0; of equal ones those of the smallest ids, ``absent`` ids last."""
    held = np.flatnonzero(scores > 0)
    if len(held) > k:
        least = scores[held[np.argpartition(scores[held], len(held) - k)[len(held) - k]]]
        above, equal = held[scores[held] > least], held[scores[held] == least]
        held = np.concatenate([above, equal[np.lexsort((ids[equal], absent[equal]))][: k - len(above)]])
    return held


def _searched(shards: DataFrame, documents: int, block: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    terms = sorted({t for _, found in block for t in found})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, df = pa.array(terms, pa.binary()), np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, offsets in zip(batch.column(0), batch.column(1), strict=True):
                at = pc.index_in(asked, own.values).to_numpy(zero_copy_only=False)
                here, lengths = ~np.isnan(at.astype(float)), np.diff(offsets.values.to_numpy())
                df[here] += lengths[at[here].astype(np.int64)]
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(df[used])], names=["term", "df"])

    counted = shards.select("terms", "offsets").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df"))
    weights = {terms[t]: weight(documents, df) for t, df in counted.collect()}  # as many as the block has terms at most
    items = [(number, item_id, [t for t in found if weights.get(t)]) for number, (item_id, found) in enumerate(block)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(list(weights), pa.binary())
        for batch in batches:
            for ids, own, offsets, slots, impacts in zip(*(batch.column(i) for i in range(5)), strict=True):
                at = dict(zip(weights, pc.index_in(asked, own.values).to_pylist(), strict=True))
                ends, places, parts = (x.values.to_numpy() for x in (offsets, slots, impacts))
                absent = np.asarray(ids.values.is_null())
                names = ids.values.fill_null(0).to_numpy()
                sums, out = np.zeros(len(names), np.int64), []
                for number, item_id, found in items:
                    sums[:] = 0
                    for t in found:
                        if (j := at[t]) is not None:
                            lot = slice(ends[j], ends[j + 1])
                            sums[places[lot]] += weights[t] * parts[lot].astype(np.int64)  # a document once in a term's postings
                    out += [(number, item_id, None if absent[s] else int(names[s]), int(sums[s])) for s in best(sums, names, absent, k)]
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["number", "item_id", "doc_id", "score"])

    found = shards.mapInArrow(score, "number int, item_id long, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # every task keeps its own k before the exchange
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(shards: DataFrame, documents: int, queries: DataFrame, *, key: str = "item_id", text: str = "text", k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best documents of every query: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``. The shards are read twice for
    each block of queries."""
    out: DataFrame | None = None
    for block in blocks_of(queries, key, text, block_bytes) if documents else ():
        found = store.materialise(_searched(shards, documents, block, k), "search-found")
        out = found if out is None else out.unionByName(found)
    return shards.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, documents = built(store.read_table(spark, sf_dir, "documents"))
    out = search(shards, documents, store.read_table(spark, sf_dir, "benchmark"))
    store.discard(shards)
    return out


QUERIES = {"op11_ranked_search": op11_ranked_search}
_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LETTERS}')"
SQL = {
    "op11_ranked_search": f"""
        WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
        lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
        whole AS (SELECT count(*) AS documents, sum(n)::BIGINT AS terms FROM lengths),
        weights AS (SELECT term, floor(1000 * ln((2 * max(documents) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
        asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
        scored AS (
            SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents) // terms))))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), whole GROUP BY ALL
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 10
    """,
}
