"""Benchmark decontamination by the q-gram lemma.

An occurrence of an item of ``m`` characters with at most ``e`` edits shares at least ``m - q + 1 - q * e``
of the item's q-grams with the document, all on ``e + 1`` neighbouring diagonals (document position minus
item position). Shared q-grams are counted in bands of ``2 * (e + 1)`` diagonals that overlap by half, so
each such run of diagonals lies in one band. Coarse bands of whole items, which hold those of all their windows, are
counted first, and q-grams in none that reaches the least bound are left out; bands that reach the bound are retained and verified by an
alignment confined to the band's diagonals.

Texts are compared in lower case, with every run of ASCII marks and blanks as one blank. An item longer than
``WINDOW`` characters is looked for in overlapping windows of that length; a window found counts. Of an item longer
than ``PART`` characters a passage counts too: any window of ``PART`` characters, one begins every ``PART_STEP``; its edits
are given only if the item, or a long window of it, isn't found. Items of
fewer than ``LEAST`` characters are looked for as whole words: the blanks around them are characters of theirs. Their budget is a
tenth of their characters, too, or fewer, as many as leave ``FEWEST`` shared q-grams to tell them by.
Null and empty texts contain nothing; items of a null or empty text are never found, those of a null id are found under it; repeated rows get equal results;
empty tables give empty results or no finds; other columns pass through, one with the result's name with ``_input`` after
it. The benchmark is gone through in blocks of at most ``BLOCK_BYTES``: one block at a time is in the driver and sent to executors,
and each is one pass over the texts whose few finds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

Q = 8
EDITS = 0.1  # of an item's characters
WINDOW, LEAST = 400, 48
FEWEST = 4  # q-grams that the bound of an item of fewer than LEAST characters demands
PART, PART_STEP = 200, 50
COARSE = 128  # diagonals, no fewer than a band of any window has
BLOCK_BYTES = 8_000_000
CHUNK = 400_000  # characters that are compared at once, beside a longer text
BITS = 22
WORD_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
FOUND = "array<struct<item_id: long, edits: int, at: int>>"


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode().translate(WORD_BYTES).split())


def grams(raw: np.ndarray) -> np.ndarray:
    """All q-grams of the bytes, each as one 64-bit number."""
    return np.lib.stride_tricks.as_strided(raw, (len(raw) - Q + 1, Q), (1, 1)).copy().view(np.uint64).ravel() if len(raw) >= Q else np.zeros(0, np.uint64)


def met(known: np.ndarray, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``codes``, entry of the sorted ``known``) of each equal pair, for the places ``at``."""
    low = np.searchsorted(known, codes[at], "left")
    count = np.searchsorted(known, codes[at], "right") - low
    return np.repeat(at, count), np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def sorted_grams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q-gram, text, place) of all q-grams, sorted by q-gram."""
    codes = [grams(t) for t in texts]
    number = np.repeat(np.arange(len(codes)), [len(c) for c in codes]) if codes else np.zeros(0, np.int64)
    place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
    code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    order = np.argsort(code, kind="stable")
    return code[order], number[order], place[order]


def slots(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def aligned(item: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[int, int]:
    """Least edits of the whole item against any part of ``text`` on diagonals ``low`` to ``low + width - 1``,
    and where that part ends."""
    far, steps = 1 << 20, np.arange(width)
    places = low + steps  # of the text, in front of the item's first character
    row = np.where((places >= 0) & (places <= len(text)), 0, far)
    for i in range(len(item)):
        at = i + places
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[at[inside]] == item[i]
        new = np.minimum(np.where(inside, row + ~same, far), np.append(row[1:], far) + 1)
        new[(at + 1 < 0) | (at + 1 > len(text))] = far
        row = np.minimum.accumulate(new - steps) + steps
    best = int(np.argmin(row))
    return int(row[best]), len(item) + low + best


class Index:
    """The q-grams of one block of items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids: list[int] = []
        self.windows: list[np.ndarray] = []
        self.part: list[bool] = []  # a passage; those of an item follow its long windows
        self.short: list[tuple[int, bytes]] = []
        self.edges: list[bool] = []  # the window has a blank at both ends that its item lacks
        whole: list[np.ndarray] = []
        owner: list[int] = []  # of each window, as a number of ``whole``
        for item_id, text in items:
            raw = normalised(text)
            edges = len(raw) < LEAST
            if edges:
                if not raw:
                    continue
                raw = b" " + raw + b" "
                self.short.append((item_id, raw))
            whole.append(np.frombuffer(raw, np.uint8))
            for size, step in ((WINDOW, WINDOW // 2), (PART, PART_STEP))[: 1 + (len(raw) > PART)]:
                last = max(0, len(raw) - size)
                for start in sorted({*range(0, last + 1, step), last}):
                    self.ids.append(item_id)
                    self.windows.append(np.frombuffer(raw[start : start + size], np.uint8))
                    self.part.append(size == PART)
                    self.edges.append(edges)
                    owner.append(len(whole) - 1)
        length, short = np.array([len(w) for w in self.windows], np.int64), np.array(self.edges, bool)
        self.budget = np.floor(EDITS * (length - 2 * short)).astype(np.int64)
        self.budget = np.where(short, np.minimum(self.budget, np.maximum(0, (length - Q + 1 - FEWEST) // Q)), self.budget)
        self.bound = np.maximum(1, length - Q + 1 - Q * self.budget)
        self.code, self.window, self.place = sorted_grams(self.windows)
        self.item_code, self.item, self.item_place = sorted_grams(whole)
        self.least = np.full(len(whole), 1 << 40)
        np.minimum.at(self.least, np.array(owner, np.int64), self.bound)
        self.longest = max(map(len, whole), default=0)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[slots(self.code)] = True

    def candidates(self, raw: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, first diagonal, diagonals) of the bands that reach the bound."""
        codes = grams(raw)
        at = np.flatnonzero(self.seen[slots(codes)])
        if not len(at) or not len(self.code):
            return []
        place, entry = met(self.item_code, codes, at)
        band = (place - self.item_place[entry] + self.longest) // COARSE + 1
        hit = np.concatenate([self.item[entry] * (1 << 40) + band, self.item[entry] * (1 << 40) + band - 1])
        key, hits = np.unique(hit, return_counts=True)
        at = np.unique(np.tile(place, 2)[np.isin(hit, key[hits >= self.least[key >> 40]])])
        if not len(at):
            return []
        at, entry = met(self.code, codes, at)
        window = self.window[entry]
        diagonal = at - self.place[entry] + WINDOW  # never negative
        step = self.budget[window] + 1
        band = diagonal // step
        hit = np.concatenate([window * (1 << 40) + band, window * (1 << 40) + np.maximum(band - 1, 0)])
        key, hits = np.unique(hit, return_counts=True)
        key = key[hits >= self.bound[key >> 40]]
        # of those, count each of the item's q-grams once
        kept = np.flatnonzero(np.isin(hit, key))
        hit, place = hit[kept], np.tile(self.place[entry], 2)[kept]
        key, hits = np.unique(np.unique(np.stack([hit, place]), axis=1)[0], return_counts=True)
        key = key[hits >= self.bound[key >> 40]]
        w, b = key >> 40, key & ((1 << 40) - 1)
        return [(int(x), int(y) * int(self.budget[x] + 1) - WINDOW, 2 * int(self.budget[x] + 1)) for x, y in zip(w, b, strict=True)]

    def find(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the items in it, with the least edits and the place of the end, in bytes as compared."""
        out: list[list[dict]] = []
        at = 0
        while at < len(texts):  # so many texts at a time as fill a chunk, joined by a byte that no text has
            part, size = [], 0
            while at < len(texts) and (not part or size < CHUNK):
                part.append(b" " + normalised(texts[at]) + b" ")
                size += len(part[-1]) + 1
                at += 1
            out.extend(self._chunk(part))
        return out

    def _chunk(self, part: list[bytes]) -> list[list[dict]]:
        starts = np.cumsum([0, *(len(p) + 1 for p in part)])
        raw = np.frombuffer(b"\0".join(part) + b"\0", np.uint8)
        best: list[dict[int, tuple[bool, int, int]]] = [{} for _ in part]
        for window, low, width in self.candidates(raw):
            item, limit, passage = self.windows[window], int(self.budget[window]), self.part[window]
            owner = min(max(int(np.searchsorted(starts, max(low, 0) + len(item) // 2, "right")) - 1, 0), len(part) - 1)
            for k in {owner, *(n for n in (owner - 1, owner + 1) if 0 <= n < len(part) and starts[n] < low + width + len(item) and starts[n + 1] > low)}:
                known = best[k].get(self.ids[window])
                if known and (known[0], known[1]) <= (passage, 0):
                    continue
                text, first = raw[starts[k] : starts[k + 1] - 1], low - int(starts[k])
                begin = max(0, first)
                same = text[begin : first + width + len(item)].tobytes().find(item.tobytes()) if first + width + len(item) > 0 else -1
                edits, end = (0, begin + same + len(item)) if same >= 0 else aligned(item, text, first, width)
                end -= 1 + self.edges[window]  # the blanks before the text and behind the item
                if edits <= limit and (known is None or (passage, edits, end) < known):
                    best[k][self.ids[window]] = (passage, edits, end)
        if self.short:
            for k, text in enumerate(part):
                for item_id, words in self.short:
                    place = text.find(words)
                    if place >= 0:
                        best[k][item_id] = (False, 0, place + len(words) - 2)
        return [[{"item_id": i, "edits": e, "at": p} for i, (_, e, p) in sorted(b.items(), key=lambda x: (x[0] is None, x[0] or 0))] for b in best]


def blocks_of(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int | None, str]]]:
    block, size = [], 0
    rows = items.select(store.column(key).cast("long").alias("k"), store.column(text).alias("t")).where("t is not null")
    for row in rows.distinct().orderBy("k", "t").toLocalIterator():
        if block and size + len(row[1]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block


def _finder(block: list[tuple[int | None, str]]):
    from pyspark.sql.pandas.functions import PandasUDFType, pandas_udf

    def run(batches):
        import pandas as pd

        index = Index(block)
        for batch in batches:
            yield pd.Series(index.find([x if isinstance(x, str) else None for x in batch]), dtype=object)

    return pandas_udf(run, FOUND, PandasUDFType.SCALAR_ITER)


def _found(df: DataFrame, items: DataFrame, text: str, item_key: str, item_text: str, out: str) -> DataFrame:
    """``df`` with the items that its text contains, in a new column ``out``."""
    blocks = blocks_of(items, item_key, item_text)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return df.withColumn(out, _finder(first)(store.column(text)))
    spark = df.sparkSession
    n = store.free_name(df, "n")
    numbered = store.materialise(df.withColumn(n, F.monotonically_increasing_id()), "numbered")
    path = store.fresh_path(spark, "finds")
    for block in chain([first, second], blocks):
        numbered.select(store.column(n).alias("n"), _finder(block)(store.column(text)).alias("finds")).where(F.size("finds") > 0).write.mode("append").parquet(path)
    each = spark.read.parquet(path).select("n", F.explode("finds").alias("f")).groupBy("n", F.col("f.item_id").alias("item_id")).agg(F.min(F.struct("f.edits", "f.at")).alias("f"))
    found = each.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("item_id", "f.edits", "f.at"))).alias(out)).withColumnRenamed("n", n)
    return numbered.join(found, n, "left").withColumn(out, F.coalesce(store.column(out), F.array().cast(FOUND))).drop(n)


def with_finds(df: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", out: str = "finds") -> DataFrame:
    """``df`` with the items that each whole text contains."""
    rows, text = store.set_apart(df, [out], text)
    return _found(rows, items, text, item_key, item_text, out)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, columns as they were."""
    finds = store.free_name(docs, "finds")
    return _found(docs, items, "text", "item_id", "text", finds).where(F.size(finds) == 0).drop(finds)


def op7_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = store.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_finds(documents, store.read_table(spark, sf_dir, "benchmark")).drop("text")
    return found.select(
        "doc_id",
        (F.size("finds") > 0).alias("contaminated"),
        F.size("finds").cast("long").alias("n_items"),
        F.transform("finds", lambda x: x["item_id"]).alias("item_ids"),
        F.array_min(F.transform("finds", lambda x: x["edits"])).alias("least_edits"),
    )


QUERIES = {"op7_qgram_lemma": op7_qgram_lemma}
SQL: dict[str, str] = {}
