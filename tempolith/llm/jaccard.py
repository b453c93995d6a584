"""Exact Jaccard join of shingle sets in the metric space of Jaccard distance.

Documents with equal sets are one point, named by its smallest id. Points join in regions of pivots:

1. *Pivots.* Nearly all points are at distance exactly 1 from any pivot that isn't a near copy, so a pivot can only
   divide the points that may be near it. Which may is told by projections: the hash universe is cut into
   ``k + 1`` parts, ``k`` being the largest symmetric difference that linked sets of a size class can have; linked
   sets agree exactly on one part at least, so the points that agree on a part (a cell) include both ends of every
   link. A set with many empty parts can't rely on them and also offers its smallest shingles, of which linked sets
   share one. Sets of a class's upper end also offer their cells in the next class. The smallest point of a
   cell is a pivot; its region is all points that share a cell with it whose smallest point it is. Sketches that bound
   the difference of two sets from below divide a region where no link is possible, before any set is exchanged; the
   smallest point of each part is its pivot. Of a large group, many points are pivots, and their regions are nearly the same
   points: too large ones to divide so are one where their least points by a hash are.
2. *Voronoi regions and windows.* Every region meets its pivots: distances of its points to them are computed exactly.
   A point within the threshold of a pivot is linked to it. Balls that share points connect their pivots; the
   points of the largest group of balls are connected and need no test among themselves, so only the others stay
   at home, each in the Voronoi region of its nearest pivot. Any other point goes along if the triangle inequality lets
   it link to a point at home: its distance to the pivot is at least the least distance at home less the
   threshold, and at most the greatest plus the threshold.
3. *Recursion.* A Voronoi region of at most ``REGION`` points is joined exactly in one task, again by pivots and
   windows. A larger one draws ``PIVOTS`` pivots from the points at home and is divided by them in the same way.
   In a dense group, where windows hold nearly everything, points at home are pivots themselves, up to ``SWEPT`` in
   a round, and meet the others with sketches that bound the difference of two sets from below. A group of
   points that are all nearly but not quite linked costs the square of its size at that: no bound tells them apart.

Links are emitted as spanning edges, never as all pairs. Components come from label propagation with pointer
jumping over tables in the shared folder. Shingles are 64-bit hashes of word hashes; two different shingles
of a pair of documents coincide with a probability of the order of 1e-13.

Null and empty texts have no shingles and link with nothing. Texts with fewer words than a shingle are one
shingle. Whole texts count. Repeated rows are equal points; a row with a null id gets the ``component_id`` of a
document with an equal set, else null. Rows that share an id are one document. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

WORDS, THRESHOLD = 3, (9, 10)
#: Points and shingles that one task joins, or lets meet the pivots of a larger region; pivots of one, and of a dense one.
REGION, REGION_SHINGLES, PIVOTS, SWEPT = 2_000, 4_000_000, 32, 1_000
GROWTH = 1.25  # of a size class
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: Cells that one task sorts.
CUT_CELLS = 400_000
#: Characters that are shingled at once, and rows of a batch: they bound what a worker holds beside its longest text.
CHUNK, ROWS = 1_000_000, 1024
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * _A
    x = x ^ (x >> np.uint64(29))
    x = x * _B
    return x ^ (x >> np.uint64(32))


def shingle_rows(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted in each, and the end of each text's share."""
    import xxhash

    raws = [(t or "").encode().translate(LOWER) for t in texts]
    raw = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    blank = BLANK[raw]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    begin, end = edge[0::2], edge[1::2]  # of words
    owner = np.searchsorted(ends, begin, "right")
    if len(begin):
        offsets = np.empty(2 * len(begin) + 1, np.int32)
        offsets[0:-1:2], offsets[1::2], offsets[-1] = begin, end, len(raw)
        runs = pa.Array.from_buffers(pa.binary(), 2 * len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = runs.take(pa.array(np.arange(0, 2 * len(begin), 2))).dictionary_encode()
        distinct = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        word = distinct[coded.indices.to_numpy()]
    else:
        word = np.zeros(0, np.uint64)
    count = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    n = len(word)
    hashed = np.zeros(n, np.uint64)
    for k in range(words):
        shifted = np.zeros(n, np.uint64)
        shifted[: n - k] = word[k:] if k <= n else 0
        hashed = mixed(hashed * _C + shifted)
    last = np.cumsum(count)
    left = last[owner] - np.arange(n) if n else np.zeros(0, np.int64)  # words from here to the text's end
    keep = left >= words
    out, sizes = [], np.zeros(len(texts), np.int64)
    full_h, full_o = hashed[keep], owner[keep]
    cut = np.searchsorted(full_o, np.arange(len(texts) + 1))
    for k in range(len(texts)):
        if count[k] >= words:
            part = np.unique(full_h[cut[k] : cut[k + 1]])
        elif count[k]:
            part = np.array([hashlib.blake2b(b" ".join(raws[k].split()), digest_size=8).digest()]).view(np.uint64)
        else:
            continue
        out.append(part)
        sizes[k] = len(part)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") < CHUNK):
            size += len(texts[to] or "") + 1
            to += 1
        flat, upto = shingle_rows(texts[at:to], words)
        out.extend(np.split(flat, upto[:-1]))
        at = to
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def linked(common: int, a: int, b: int, threshold: tuple[int, int]) -> bool:
    return threshold[1] * common >= threshold[0] * (a + b - common)


class Classes:
    """Size classes, and in each the number of parts that linked sets can't all differ in."""

    def __init__(self, threshold: tuple[int, int]):
        self.least = threshold[0] / threshold[1]
        self.num, self.den = threshold
        self.tops = [1]

    def top(self, c: int) -> int:
        while len(self.tops) <= c:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * GROWTH)))
        return self.tops[c]

    def of(self, n: int) -> int:
        c = 0
        while self.top(c) < n:
            c += 1
        return c

    def differences(self, c: int) -> int:
        """Most elements in which a set of this class and a linked, not larger one can differ."""
        return (2 * self.top(c) * (self.den - self.num)) // (self.den + self.num)

    def spare(self, c: int) -> int:
        """Parts beside those, so that a typical set's empty parts don't matter."""
        expected = self.differences(c) * math.exp(-self.least * self.top(c) / (self.differences(c) + 1))
        return math.ceil(expected + 3 * math.sqrt(expected)) if self.differences(c) else 0

    def parts(self, c: int) -> int:
        return self.differences(c) + 1 + self.spare(c)


SKETCH_BITS = 1 << 17


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """The parities of hashed shingles, in 64-bit words: sets that differ in ``d`` elements have sketches that differ
    in ``d`` bits at most. Bits are a power of two of at least twice the set's size; half of a sketch over the other
    half, by exclusive or, is the sketch of half as many bits."""
    bits = min(SKETCH_BITS, max(64, 1 << (2 * len(shingles) - 1).bit_length())) if len(shingles) else 64
    count = np.bincount((mixed(shingles ^ _C) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def cells_of(shingles: np.ndarray, classes: Classes) -> np.ndarray:
    """The cells that a point is in: linked points share one at least."""
    n = len(shingles)
    if not n:
        return np.zeros(0, np.uint64)
    own = classes.of(n)
    out = []
    # the classes of linked sets that are not smaller than this one
    for c in range(own, classes.of(n * classes.den // classes.num) + 1):
        parts = classes.parts(c)
        tag = mixed(np.array([c + 1], np.uint64))[0]
        if not classes.differences(c):
            continue  # only equal sets link, and those are one point already
        part = (mixed(shingles) >> np.uint64(33)).astype(np.int64) % parts
        content = np.zeros(parts, np.uint64)
        np.add.at(content, part, mixed(shingles ^ tag))
        filled = np.bincount(part, minlength=parts)
        used = np.flatnonzero(filled)
        out.append(mixed(content[used] * _C + mixed(used.astype(np.uint64) + tag)))
        if parts - len(used) > classes.spare(c):
            # too many empty parts: of the smallest hashes, linked sets share one
            first = n - -(-n * classes.num // classes.den) + 1
            out.append(mixed(np.sort(mixed(shingles))[:first] + mixed(np.array([c + 1_000_000], np.uint64))))
    return np.concatenate(out) & np.uint64((1 << 8 * CELL_BYTES) - 1) if out else np.zeros(0, np.uint64)


PROFILE = "doc_id long, n_shingles long, set_id binary, sketch binary, n_cells long, cells array<long>"


def profiles(df: DataFrame, *, key: str, text: str, words: int, threshold: tuple[int, int]) -> DataFrame:
    """Per document the size and identity of its set, and the cells of its point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(threshold)
        for batch in slices(batches, ROWS):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            cells = [cells_of(s, classes).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([sketch_of(s).tobytes() for s in sets], pa.binary()),
                    pa.array([len(c) for c in cells], pa.int64()),
                    pa.array(cells, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_id", "sketch", "n_cells", "cells"],
            )

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PROFILE)


CELL_BYTES, CROWD = 7, 8
#: What a row of a meeting says: ``doc_id`` is in the region; so is all of its crowd; ``doc_id`` is in the crowd of ``region``.
MEMBER, CROWDED, LOCAL = 0, 1, 2


def first_regions(points: DataFrame, total: int, scratch: store.Scratch) -> DataFrame:
    """(region, doc_id) for the points (one for each set: doc_id, cells; ``total`` cells at most) that share a cell with another, the region named by its pivot.

    Cells travel packed, 9 bytes each instead of a row: a batch of points is cut by a hash of the cell, and
    each cut is one row of sorted cells, the points' places in a list, and that list. Where a batch has more than
    ``CROWD`` points in a cell, only the smallest is packed, with a mark, and stands for its crowd, all
    points of the batch that meet it so: a hot cell costs its reader one entry for each batch, and its points go
    to the regions of their crowds by a join of distinct rows.
    """
    cuts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // CUT_CELLS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 * ROWS):
            docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            cell = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.repeat(np.arange(len(docs)), np.diff(lists.offsets.to_numpy()))
            order = np.lexsort((docs[place], cell, cell % np.uint64(cuts)))
            cell, place = cell[order], place[order]
            fresh = np.ones(len(cell), bool)
            fresh[1:] = (cell[1:] != cell[:-1]) | (place[1:] != place[:-1])
            cell, place = cell[fresh], place[fresh]
            head = np.flatnonzero(np.diff(cell, prepend=~cell[:1])) if len(cell) else np.zeros(0, np.int64)
            count = np.diff(np.append(head, len(cell)))
            crowd = np.repeat(count > CROWD, count)
            rows = []
            if crowd.any():
                leader = np.repeat(place[head], count)
                both = np.unique(leader[crowd] * len(docs) + place[crowd])
                for k in np.unique(both // len(docs)):
                    rows.append((int(docs[k] % cuts), struct.pack("<Iq", 0, docs[k]) + docs[both[both // len(docs) == k] % len(docs)].tobytes()))
                first = np.zeros(len(cell), bool)
                first[head] = True
                kept = ~crowd | first
                cell, place, crowd = cell[kept], place[kept], crowd[kept]
            cut = (cell % np.uint64(cuts)).astype(np.int64)
            edge = np.searchsorted(cut, np.arange(cuts + 1))
            for k in np.flatnonzero(np.diff(edge)):
                part = slice(edge[k], edge[k + 1])
                used, local = np.unique(place[part], return_inverse=True)
                low = cell[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CELL_BYTES].tobytes()
                sizes = np.array([len(local), len(used)], "<u4").tobytes()
                rows.append((int(k), sizes + low + (local.astype("<u2") | (crowd[part].astype("<u2") << 15)).tobytes() + docs[used].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["cut", "packed"])

    def meet(key, rows):
        import pandas as pd

        cells, docs, marks, out = [], [], [], []
        for raw in rows["packed"]:
            n, used = np.frombuffer(raw, "<u4", 2)
            if not n:  # a crowd
                members = np.frombuffer(raw, "<i8", offset=12)
                out.append(pd.DataFrame({"kind": LOCAL, "region": struct.unpack_from("<q", raw, 4)[0], "doc_id": members}))
                continue
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :CELL_BYTES] = np.frombuffer(raw, np.uint8, int(n) * CELL_BYTES, 8).reshape(-1, CELL_BYTES)
            local = np.frombuffer(raw, "<u2", int(n), 8 + int(n) * CELL_BYTES)
            names = np.frombuffer(raw, "<i8", int(used), 8 + int(n) * (CELL_BYTES + 2))
            cells.append(wide.view("<u8").ravel())
            docs.append(names[local & 0x7FFF])
            marks.append(local >> 15 == 1)
        if cells:
            cell, doc, mark = np.concatenate(cells), np.concatenate(docs), np.concatenate(marks)
            order = np.lexsort((doc, cell))
            cell, doc, mark = cell[order], doc[order], mark[order]
            head = np.flatnonzero(np.diff(cell, prepend=~cell[:1]))
            count = np.diff(np.append(head, len(cell)))
            region = np.repeat(doc[head], count)  # sorted: the first is the smallest
            shared = np.repeat((count > 1) | np.logical_or.reduceat(mark, head), count)
            found = np.unique(np.stack([mark[shared].astype(np.int64) * CROWDED, region[shared], doc[shared]]), axis=1)
            out.append(pd.DataFrame({"kind": found[0], "region": found[1], "doc_id": found[2]}))
        return pd.concat(out)

    packed = points.mapInArrow(pack, "cut long, packed binary")
    met = scratch.keep(packed.groupBy("cut").applyInPandas(meet, "kind int, region long, doc_id long"), "jaccard-cells")
    crowds = met.where(F.col("kind") == CROWDED).select(F.col("doc_id").alias("leader"), "region").distinct()
    local = met.where(F.col("kind") == LOCAL).select(F.col("region").alias("leader"), "doc_id")
    members = met.where(F.col("kind") == MEMBER).select("region", "doc_id")
    return members.unionByName(local.join(crowds, "leader").select("region", "doc_id")).distinct()


class Points:
    """Union of points by links, with the pairs already known to be connected."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def largest(self) -> int:
        """A point of the largest component."""
        roots = [self.find(x) for x in range(len(self.parent))]
        names, counts = np.unique(roots, return_counts=True)
        return int(names[np.argmax(counts)])


def common_with(pivot: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of ``pivot`` with each of the sets laid end to end in ``flat``."""
    if not len(flat) or not len(pivot):
        return np.zeros(len(bounds) - 1, np.int64)
    at = np.searchsorted(pivot, flat)
    at[at == len(pivot)] = 0
    total = np.concatenate([[0], np.cumsum(pivot[at] == flat)])
    return total[bounds[1:]] - total[bounds[:-1]]


def possible_groups(sizes: np.ndarray, sketches: list[np.ndarray], threshold: tuple[int, int]) -> list[np.ndarray]:
    """Points that a chain of pairs connects whose sketches leave a link possible; no group of one."""
    num, den = threshold
    words = min(map(len, sketches))
    folds, left, out = np.stack([folded(s, words) for s in sketches]), np.arange(len(sizes)), []
    while len(left):
        group, queue, left = [], [int(left[0])], left[1:]
        while queue:
            at = queue.pop()
            group.append(at)
            apart = np.bitwise_count(folds[left] ^ folds[at]).sum(1, dtype=np.int64)
            near = (den + num) * apart <= (den - num) * (sizes[left] + sizes[at])
            queue += left[near].tolist()
            left = left[~near]
        if len(group) > 1:
            out.append(np.sort(np.array(group)))
    return out


class Region:
    """Points of one task and the spanning edges of their links."""

    def __init__(self, sets: list[np.ndarray], home: np.ndarray, threshold: tuple[int, int]):
        self.sets, self.sizes, self.threshold = sets, np.array([len(s) for s in sets]), threshold
        self.known, self.edges = Points(len(sets)), []
        settled = np.flatnonzero(~home)  # they are connected already
        for x in settled[1:]:
            self.known.join(int(settled[0]), int(x))
        sketches = [sketch_of(s) for s in sets]
        words = min(map(len, sketches))
        self.sketches = np.stack([folded(s, words) for s in sketches])

    def distances(self, pivot: int, rest: np.ndarray) -> np.ndarray:
        """Exact distances; what is linked to the pivot is joined with it."""
        flat = np.concatenate([self.sets[m] for m in rest])
        common = common_with(self.sets[pivot], flat, np.concatenate([[0], np.cumsum(self.sizes[rest])]))
        union = self.sizes[rest] + self.sizes[pivot] - common
        for m in rest[self.threshold[1] * common >= self.threshold[0] * union]:
            if self.known.join(pivot, int(m)):
                self.edges.append((pivot, int(m)))
        return 1 - common / union

    def link(self, pivot: int, rest: np.ndarray) -> None:
        """Join ``pivot`` with what is linked to it and not connected yet; only pairs that sketches leave possible are tested."""
        num, den = self.threshold
        apart = np.bitwise_count(self.sketches[rest] ^ self.sketches[pivot]).sum(1, dtype=np.int64)
        due = rest[(den + num) * apart <= (den - num) * (self.sizes[rest] + self.sizes[pivot])]
        while len(due):
            root = self.known.find(pivot)
            due = np.array([m for m in due.tolist() if self.known.find(m) != root], np.int64)
            if len(due):
                self.distances(pivot, due[:64])
                due = due[64:]

    def sweep(self, pivots: np.ndarray, others: np.ndarray, first: int = 0) -> None:
        """Each pivot meets the others and the pivots after it. After the ``first`` ones, a pivot connected
        to what is then the largest component needs no test: what isn't is tested against it."""
        chief = None
        for k, pivot in enumerate(pivots.tolist()):
            if first and k == first:
                chief = self.known.largest()
            if chief is None or self.known.find(pivot) != self.known.find(chief):
                self.link(pivot, np.concatenate([pivots[k + 1 :] if chief is None else np.delete(pivots, k), others]))


def join_region(sets: list[np.ndarray], threshold: tuple[int, int], home: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the link graph of a small region. Points not at home are connected already.

    Large regions are divided between two far pivots: a point goes to its nearer pivot, and to the other one too if
    its distances to both differ by no more than twice the threshold, which two linked points' distances can. Where
    that divides no more, points meet by their sketches first.
    """
    home = np.ones(len(sets), bool) if home is None else home
    reach = 1 - threshold[0] / threshold[1] + 1e-9
    region = Region(sets, home, threshold)
    stack = [np.arange(len(sets))]
    while stack:
        members = stack.pop()
        roots = np.array([region.known.find(int(m)) for m in members])
        names, counts = np.unique(roots, return_counts=True)
        if len(names) < 2:
            continue
        if len(members) > 64:
            one = int(members[np.flatnonzero(roots == names[np.argmin(counts)])[0]])
            rest = members[members != one]
            near = region.distances(one, rest)
            two = int(rest[np.argmax(near)])
            near, rest = near[rest != two], rest[rest != two]
            far = region.distances(two, rest)
            parts = rest[near - far <= 2 * reach], rest[far - near <= 2 * reach]
            if max(map(len, parts)) <= 0.8 * len(rest):
                stack += parts
                continue
            members = rest
        settled = ~home[members]
        if settled.any():  # one component: what is at home meets it
            region.sweep(members[~settled], members[settled])
        else:
            region.sweep(members, members[:0], PIVOTS)
    return region.edges


def _sets_for(df: DataFrame, members: DataFrame, *, key: str, text: str, words: int) -> DataFrame:
    """(doc_id, n, shingles) of the documents among ``members`` (column ``doc_id``, distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "n", "shingles"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(members, "doc_id").distinct()
    return rows.mapInArrow(run, "doc_id long, n long, shingles binary")


EDGE = "a long, b long"


def _volume(regions: DataFrame) -> tuple[int, int]:
    """How many rows, and so many tasks' worth of points and shingles, at least as many as partitions: regions (or
    parts of large ones) that share a hash are worked on together."""
    rows, shingles = regions.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = max(rows / REGION, shingles / REGION_SHINGLES)
    return rows, max(int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * weight))


def _with_sets(rows: DataFrame, count: int, sets: DataFrame) -> DataFrame:
    """``rows`` (ids and flags, ``count`` of them) with the sets of their ``doc_id``: sets stay where they are as long as the rows
    are few enough to be sent."""
    return sets.join(F.broadcast(rows) if count <= store.SENT_ROWS // 2 else rows, "doc_id")


def runs_of(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    if not len(columns[0]):
        return []
    fresh = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
    return list(zip([0, *fresh.tolist()], [*fresh.tolist(), len(columns[0])], strict=True))


def _least_point(seed: int):
    """The point of a group with the least hash. Regions that have it in common share it the likelier, the more points they share."""
    return F.min_by("doc_id", F.struct(F.xxhash64(F.lit(seed), "doc_id"), "doc_id"))


def _as_one(regions: DataFrame, least: DataFrame) -> DataFrame:
    """Regions (region, doc_id) with the same ``least`` point (region, least) become one, named by it; what shared a region still does."""
    return regions.join(least, "region").select(F.col("least").alias("region"), "doc_id").distinct()


def _parted(regions: DataFrame, sketches: DataFrame, threshold: tuple[int, int], scratch: store.Scratch) -> DataFrame:
    """(region, pivot, doc_id, n): the regions of pivots (region, doc_id) in parts between which sketches (doc_id, n, sketch) leave no link.
    A part is named by its points, so that one that came about with many pivots is one. Larger regions than one task's stay whole;
    a large group has many pivots, so those of nearly the same points become one."""

    def divide(lot):
        import pandas as pd

        lot = lot.sort_values(["region", "doc_id", "n"], ignore_index=True)
        ids, n, out = lot["doc_id"].to_numpy(), lot["n"].to_numpy(), []
        for begin, end in runs_of(lot["region"].to_numpy()):
            groups = possible_groups(n[begin:end], [np.frombuffer(x, np.uint64) for x in lot["sketch"].iloc[begin:end]], threshold)
            for k in groups:
                mine = ids[begin:end][k]
                name = int.from_bytes(hashlib.blake2b(mine.tobytes(), digest_size=8).digest(), "little", signed=True)
                out.append(pd.DataFrame({"region": name, "pivot": mine[0], "doc_id": mine, "n": n[begin:end][k]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("region", "pivot", "doc_id", "n")}, dtype="int64")

    counted = regions.groupBy("region").agg(F.count("*").alias("points"), _least_point(0).alias("least"))
    large = scratch.keep(counted.where(F.col("points") > REGION).select("region", "least"), "jaccard-large")  # few
    small = regions.join(large, "region", "left_anti").join(sketches, "doc_id")
    lots = _volume(regions.withColumn("n", F.lit(0)))[1]
    parts = small.withColumn("lot", F.pmod(F.xxhash64("region"), F.lit(lots))).groupBy("lot").applyInPandas(divide, "region long, pivot long, doc_id long, n long")
    whole = scratch.keep(_as_one(regions, large), "jaccard-whole")
    whole = _as_one(whole, whole.groupBy("region").agg(_least_point(1).alias("least"))).join(sketches.select("doc_id", "n"), "doc_id")
    return parts.unionByName(whole.select("region", F.col("region").alias("pivot"), "doc_id", "n")).distinct()


def _small(regions: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Edges of regions (region, doc_id, n, home) that one task can hold."""

    def solve(lot):
        import pandas as pd

        lot = lot.sort_values(["region", "doc_id"], ignore_index=True)
        out = []
        for begin, end in runs_of(lot["region"].to_numpy()):
            part = lot.iloc[begin:end]
            ids = part["doc_id"].to_numpy()
            out += [(ids[i], ids[j]) for i, j in join_region([np.frombuffer(x, np.uint64) for x in part["shingles"]], threshold, part["home"].to_numpy(bool))]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    rows, lots = _volume(regions)
    dealt = _with_sets(regions, rows, sets.drop("n")).withColumn("lot", F.pmod(F.xxhash64("region"), F.lit(lots)))
    return dealt.groupBy("lot").applyInPandas(solve, EDGE)


def merged_masks(masks: list[int]) -> list[int]:
    """Masks that share a bit become one, until none do."""
    groups: list[int] = []
    for mask in masks:
        apart = []
        for g in groups:
            if g & mask:
                mask |= g
            else:
                apart.append(g)
        groups = [*apart, mask]
    return groups


def drawn(regions: DataFrame, most: int) -> DataFrame:
    """(region, pivot): up to ``most`` points at home of each region, by a hash."""
    order = Window.partitionBy("region").orderBy(F.xxhash64("region", "doc_id"), "doc_id")
    return regions.where("home").withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("region", F.col("doc_id").alias("pivot"))


def _meeting(regions: DataFrame, pivots: DataFrame, sets: DataFrame, work, schema: str) -> DataFrame:
    """``work(region, points, pivots)`` for each region: the points (doc_id, n, home, shingles) of a region meet all of its pivots
    (pivot, raw), a bounded number of points in one task. Large regions are salted into parts, and each part gets a
    copy of the pivots."""
    rows, lots = _volume(regions)
    sizes = regions.groupBy("region").agg(F.ceil(F.greatest(F.count("*") / REGION, F.sum("n") / REGION_SHINGLES, F.lit(1))).cast("int").alias("parts"))
    lot = F.pmod(F.xxhash64("region", "part"), F.lit(lots))
    copies = pivots.join(sizes, "region").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = _with_sets(copies.withColumnRenamed("pivot", "doc_id"), copies.count(), sets.drop("n"))
    right = right.select(lot.alias("at"), F.col("region").alias("r"), F.col("part").alias("p"), F.col("doc_id").alias("pivot"), F.col("shingles").alias("raw"))
    salted = regions.join(sizes, "region").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    left = _with_sets(salted, rows, sets.drop("n")).select(lot.alias("lot"), "region", "part", "doc_id", "n", "home", "shingles")

    def meet(a, b):
        import pandas as pd

        a, b = a.sort_values(["region", "part", "doc_id"], ignore_index=True), b.sort_values(["r", "p", "pivot"], ignore_index=True)
        mine = {(int(b["r"][i]), int(b["p"][i])): (i, j) for i, j in runs_of(b["r"].to_numpy(), b["p"].to_numpy())}
        out = []
        for i, j in runs_of(a["region"].to_numpy(), a["part"].to_numpy()):
            region = int(a["region"][i])
            if (found := mine.get((region, int(a["part"][i])))) is not None:
                out += work(region, a.iloc[i:j], b.iloc[slice(*found)])
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)

    return left.groupBy("lot").cogroup(right.groupBy("at")).applyInPandas(meet, schema)


#: The mark of the points that are connected already, which count as one more ball.
SETTLED = 1 << 62
MET = "region long, doc_id long, n long, near long, pivots array<long>, distances array<float>"


def _met(regions: DataFrame, pivots: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Each point of a region with its distances to the region's pivots and which balls it is in. Rows with a null
    ``doc_id`` have the groups of pivots that a part's points connect."""

    def work(region, points, pivots):
        sets = [np.frombuffer(x, np.uint64) for x in points["shingles"]]
        sizes = np.array([len(s) for s in sets])
        flat, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
        names = list(dict.fromkeys(pivots["pivot"].tolist()))
        near, far = np.where(points["home"].to_numpy(bool), 0, SETTLED), np.ones((len(sets), len(names)), np.float32)
        for name, raw in zip(pivots["pivot"], pivots["raw"], strict=True):
            pivot, k = np.frombuffer(raw, np.uint64), names.index(name)
            common = common_with(pivot, flat, bounds)
            union = sizes + len(pivot) - common
            near |= (threshold[1] * common >= threshold[0] * union).astype(np.int64) << k
            far[:, k] = np.minimum(far[:, k], 1 - common / union)
        rows = [(region, d, n, m, names, f) for d, n, m, f in zip(points["doc_id"].tolist(), points["n"].tolist(), near.tolist(), far.tolist(), strict=True)]
        return rows + [(region, None, None, g, names, None) for g in merged_masks([x for x in set(near.tolist()) if x])]

    return _meeting(regions, pivots, sets, work, MET)


def _swept(regions: DataFrame, pivots: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Edges between pivots, points at home of dense regions, and all points of the region. Pivots are met in the parts that they are in, too."""

    def work(region, points, pivots):
        apart, n = points[~points["doc_id"].isin(pivots["pivot"])], len(pivots)
        ids = [*pivots["pivot"].tolist(), *apart["doc_id"].tolist()]
        home = np.concatenate([np.ones(n, bool), apart["home"].to_numpy(bool)])
        part = Region([np.frombuffer(x, np.uint64) for x in [*pivots["raw"], *apart["shingles"]]], home, threshold)
        part.sweep(np.arange(n), np.arange(n, len(ids)))
        return [(ids[i], ids[j]) for i, j in part.edges]

    return _meeting(regions, pivots, sets, work, EDGE)


def _pivot_groups(met: DataFrame, lots: int) -> DataFrame:
    """Per region the groups of pivots that its points connect; a few masks for each part come together."""

    def merge(lot):
        import pandas as pd

        return pd.DataFrame([(region, g) for region, rows in lot.groupby("region") for g in merged_masks(rows["near"].tolist())], columns=["region", "mask"])

    masks = met.where("doc_id is null").select("region", "near").distinct()
    return masks.groupBy(F.pmod(F.xxhash64("region"), F.lit(lots))).applyInPandas(merge, "region long, mask long")


REGIONS = ["region", "doc_id", "n", "home", "dense"]


def divided(met: DataFrame, groups: DataFrame, threshold: tuple[int, int], scratch: store.Scratch) -> tuple[DataFrame, DataFrame]:
    """Edges within balls, and the next regions: Voronoi regions of the pivots for the points at home, with the
    windows of the triangle inequality."""
    reach = 1 - threshold[0] / threshold[1] + 1e-6
    points = met.where("doc_id is not null")
    first = F.expr("try_element_at(filter(pivots, (p, k) -> (shiftright(near, k) & 1) = 1), 1)")
    edges = points.where("near <> 0").select(first.alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    named = groups.join(met.groupBy("region").agg(F.first("pivots").alias("pivots")), "region")
    together = named.select(F.expr("filter(pivots, (p, k) -> (shiftright(mask, k) & 1) = 1)").alias("g"))
    edges = edges.unionByName(together.select(F.try_element_at("g", F.lit(1)).alias("a"), F.explode("g").alias("b")).where("a <> b"))
    # the group of pivots with the most points is the region's majority: links within it are implied
    held = points.where("near <> 0").join(groups, "region").where("(near & mask) <> 0").groupBy("region", "mask").agg(F.count("*").alias("points"))
    majority = held.groupBy("region").agg(F.max_by("mask", F.struct("points", "mask")).alias("major"))
    rest = points.where("not array_contains(pivots, doc_id)").join(majority, "region", "left")
    rest = rest.withColumn("home", F.coalesce(F.expr("near & major"), F.lit(0)) == 0)
    nearest = F.expr("array_position(distances, array_min(distances))").cast("int")
    rest = scratch.keep(rest.select("region", "doc_id", "n", "distances", "home", F.when(F.col("home"), nearest).alias("nearest")), "jaccard-open")
    ring = rest.where("home").groupBy("region", F.col("nearest").alias("k")).agg(F.min(F.array_min("distances")).alias("least"), F.max(F.array_min("distances")).alias("most"))
    rings = ring.groupBy("region").agg(F.collect_list(F.struct("k", "least", "most")).alias("rings"))  # as many as pivots
    around = F.expr(f"transform(filter(rings, w -> element_at(distances, w.k) between w.least - {reach} and w.most + {reach}), w -> w.k)")
    windowed = scratch.keep(rest.join(rings, "region").select("region", "doc_id", "n", "home", "nearest", around.alias("around")), "jaccard-windows")
    spread = windowed.groupBy("region").agg((F.sum(F.size("around")) > 1.5 * F.count("*")).alias("dense"))
    placed = windowed.join(spread, "region").select("region", "doc_id", "n", "home", "nearest", "dense", F.explode(F.when(F.col("dense"), F.array(F.lit(0))).otherwise(F.col("around"))).alias("k"))
    at_home = F.col("home") & ((F.col("k") == 0) | (F.col("k") == F.col("nearest")))
    return edges, scratch.keep(placed.select(F.xxhash64("region", "k").alias("region"), "doc_id", "n", at_home.alias("home"), "dense"), "jaccard-placed")


def links(regions: DataFrame, sets: DataFrame, threshold: tuple[int, int], scratch: store.Scratch) -> DataFrame:
    """Edges that span the components of the links inside the regions of pivots (region, pivot, doc_id, n)."""
    pivots = regions.select("region", "pivot").distinct()
    due, edges = regions.select("region", "doc_id", "n", F.lit(True).alias("home")), None
    while True:
        met = scratch.keep(_met(due, pivots, sets, threshold), "jaccard-met")
        groups = scratch.keep(_pivot_groups(met, _volume(due)[1]), "jaccard-groups")
        found, regions = divided(met, groups, threshold, scratch)
        edges = found if edges is None else edges.unionByName(found)
        fits = (F.count("*") <= REGION) & (F.sum("n") <= REGION_SHINGLES)
        alive = regions.groupBy("region").agg(fits.alias("fits"), F.bool_or("home").alias("open"), F.count("*").alias("points")).where("open and points > 1")
        sized = scratch.keep(regions.join(alive.select("region", "fits"), "region"), "jaccard-regions")
        edges = edges.unionByName(scratch.keep(_small(sized.where("fits"), sets, threshold), "jaccard-links"))
        dense = sized.where("not fits and dense").select("region", "doc_id", "n", "home")
        while dense.where("home").limit(1).count():
            swept = scratch.keep(drawn(dense, SWEPT), "jaccard-swept")
            edges = edges.unionByName(scratch.keep(_swept(dense, swept, sets, threshold), "jaccard-links"))
            tested = swept.withColumnRenamed("pivot", "doc_id")
            dense = scratch.keep(dense.join(tested, ["region", "doc_id"], "left_anti"), "jaccard-dense")
        due = sized.where("not fits and not dense").select("region", "doc_id", "n", "home")
        if not due.limit(1).count():
            return edges
        pivots = scratch.keep(drawn(due, PIVOTS), "jaccard-pivots")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ends of edges: the smallest id that each reaches."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct()
    both = store.materialise(both, "component-edges")
    labels = store.materialise(both.groupBy("id").agg(F.least("id", F.min("other")).alias("component")), "component-labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("other"), F.col("component").alias("theirs")), "other").groupBy("id").agg(F.min("theirs").alias("theirs"))
        lower = labels.join(heard, "id").select("id", F.least("component", "theirs").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = lower.join(jump, "component", "left").select("id", F.least("component", F.coalesce("root", "component")).alias("component"), "was")
        new = store.materialise(new, "component-labels")
        changed = new.where("component <> was").limit(1).count()
        store.discard(labels)
        labels = new
        if not changed:
            store.discard(both)
            return labels.select("id", "component")


def joined(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, and the number of documents with the same set."""
    scratch = store.Scratch()
    profiled = store.materialise(profiles(df, key=key, text=text, words=words, threshold=threshold), "jaccard-profiles")
    named = profiled.where("n_shingles > 0").select("doc_id", "n_shingles", "set_id")
    classes = named.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("same_set"))
    alone = profiled.where("n_shingles = 0").select("doc_id", "n_shingles", "set_id", F.col("doc_id").alias("rep"), F.lit(1).cast("long").alias("same_set"))
    members = store.materialise(named.join(classes, "set_id").select("doc_id", "n_shingles", "set_id", "rep", "same_set").unionByName(alone), "jaccard-members")
    # one point for each set: copies go no further
    copies = scratch.keep(members.where("n_shingles > 0 and doc_id <> rep").select("doc_id", "set_id").distinct(), "jaccard-copies")
    points = profiled.where("doc_id is not null and n_cells > 0").select("doc_id", "set_id", "cells").join(store.bounded(copies, store.SENT_ROWS), ["doc_id", "set_id"], "left_anti")
    total = profiled.agg(F.sum("n_cells")).first()[0] or 0
    first = scratch.keep(first_regions(points.select("doc_id", "cells"), total, scratch), "jaccard-first")
    met = scratch.keep(first.select("doc_id").distinct(), "jaccard-met")
    sketches = profiled.where("n_shingles > 0").select("doc_id", F.col("n_shingles").alias("n"), "sketch").join(store.bounded(met, store.SENT_ROWS), "doc_id", "left_semi").distinct()
    regions = scratch.keep(_parted(first, scratch.keep(sketches, "jaccard-sketches"), threshold, scratch), "jaccard-regions")
    store.discard(profiled)
    asked = scratch.keep(regions.select("doc_id").distinct(), "jaccard-asked")
    sets = scratch.keep(_sets_for(df, store.bounded(asked, store.SENT_ROWS), key=key, text=text, words=words), "jaccard-sets")
    found = components(links(regions, sets, threshold, scratch))
    scratch.clear()
    return members.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), "same_set")


def representatives(docs: DataFrame, *, key: str = "doc_id", words: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, columns as they were."""
    kept = joined(docs, key=key, words=words, threshold=threshold).where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs[key].cast("long").eqNullSafe(kept["_kept"]), "left_semi")


def op3_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(store.read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_metric_join": op3_metric_join}
SQL = {
    "op3_metric_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w
        ), n AS (
            SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k, s FROM s
        ), u AS (
            SELECT k, min(doc_id) AS rep, count(*) AS same_set, any_value(n) AS n, any_value(s) AS s FROM n WHERE n > 0 GROUP BY k
        ), x AS (
            SELECT rep, n, unnest(s) AS g FROM u
        ), p AS (
            SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
            GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ), e AS (
            SELECT a, b FROM p UNION ALL SELECT b, a FROM p
        ), r AS (
            SELECT rep AS a, rep AS b FROM u UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
        ), c AS (
            SELECT a AS rep, min(b) AS component FROM r GROUP BY a
        )
        SELECT n.doc_id, n.n AS n_shingles, coalesce(component, n.doc_id) AS component_id, coalesce(same_set, 1) AS same_set
        FROM n LEFT JOIN u ON u.k = n.k AND n.n > 0 LEFT JOIN c USING (rep)
    """,
}
