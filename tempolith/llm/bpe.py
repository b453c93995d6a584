"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can stand last in that prefix's encoding.
Storing it per prefix gives the encoding of any prefix by walking back, lets bytes be appended without
looking at what came before, and lets an edit be re-encoded from the first changed byte on. A token may
stand last at prefix ``i`` if it ends there and is stable next to the token that is last where it begins;
stability of a pair is read off the merge rules for the pair's own bytes and remembered.

Nulls and empty texts encode to no ids. Every text is encoded whole. Repeated rows give repeated results;
an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .pieces import BatchEncoder, split_pieces

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixCoder:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.stable: dict[tuple[int, int], bool] = {}
        self.lengths: dict[int, list[int]] = {}
        for token in ranks:  # lengths of the tokens by last byte, longest first
            self.lengths.setdefault(token[-1], set()).add(len(token))
        self.lengths = {k: sorted(v, reverse=True) for k, v in self.lengths.items()}

    def merged(self, raw: bytes) -> list[bytes]:
        """The merge rules carried out literally; only for the few bytes of one or two tokens."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = min((rank(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pair_stable(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.stable.get(key)
        if known is None:
            a, b = self.tokens[left] if left >= 0 else b"", self.tokens[right]
            known = self.merged(a + b) == ([a, b] if a else [b])
            if len(self.stable) > 2_000_000:
                self.stable.clear()
            self.stable[key] = known
        return known

    def extend(self, raw: bytes, last: list[int]) -> list[int]:
        """Complete ``last`` (the unique last token of each non-empty prefix of ``raw``) in place.

        As only one token can be valid, the likely ones are tried first: the last token grown by the new
        byte, then the byte alone, then every other token length that ends in this byte.
        """
        ranks, stable, known = self.ranks, self.pair_stable, self.stable.get
        grown = len(self.tokens[last[-1]]) + 1 if last else 1
        for end in range(len(last) + 1, len(raw) + 1):
            for size in (grown, 1, *self.lengths[raw[end - 1]]):
                begin = end - size
                if begin < 0:
                    continue
                token = ranks.get(raw[begin:end])
                if token is None:
                    continue
                before = last[begin - 1] if begin else -1
                valid = known((before, token))
                if valid or valid is None and stable(before, token):
                    last.append(token)
                    grown = size + 1
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
        return last

    def walk(self, last: list[int]) -> tuple[int, ...]:
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        return tuple(reversed(out))

    def encode_piece(self, raw: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else self.walk(self.extend(raw, []))

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """In sorted order each piece goes on from the prefix that it shares with the one before."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        ranks, before, last = self.ranks, b"", []
        for k in sorted(range(len(pieces)), key=pieces.__getitem__):
            raw = pieces[k]
            whole = ranks.get(raw)
            if whole is not None:
                out[k] = (whole,)
                continue
            shared = 0
            for a, b in zip(before, raw):
                if a != b:
                    break
                shared += 1
            del last[shared:]
            self.extend(raw, last)
            before = raw
            out[k] = self.walk(last)
        return out

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


class EditableEncoding:
    """A text with its ids, kept exact under appends and edits by work near the change only."""

    #: A piece is settled by what it holds and at most this many characters behind it.
    LOOK = 3

    def __init__(self, coder: PrefixCoder, text: str = ""):
        self.coder, self.text = coder, ""
        self.starts: list[int] = []  # in characters
        self.tables: list[tuple[bytes, list[int]]] = []
        self.encoded_bytes = 0  # prefixes that had to be worked out so far
        self.edit(0, 0, text)

    @property
    def ids(self) -> list[int]:
        out: list[int] = []
        for raw, last in self.tables:
            whole = self.coder.ranks.get(raw)
            out.extend([whole] if whole is not None else self.coder.walk(last))
        return out

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace ``text[start:end]`` by ``new``."""
        old_starts, old_tables = self.starts, self.tables
        bounds = [*old_starts, len(self.text)]
        keep = max(0, bisect.bisect_right(bounds, start - self.LOOK) - 1)  # pieces that end early enough stay
        keep = min(keep, len(old_tables))
        begin = bounds[keep] if old_tables else 0
        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - len(self.text)
        starts, tables = old_starts[:keep], old_tables[:keep]
        place = {s + shift: k for k, s in enumerate(old_starts) if k >= keep and s >= end}
        self.text = text
        at = begin
        while at < len(text):
            resume = place.get(at)
            if resume is not None and at >= start + len(new):
                starts += [s + shift for s in old_starts[resume:]]
                tables += old_tables[resume:]
                break
            window = 64
            while True:  # the next piece, from a window long enough to settle it
                found, _ = split_pieces([text[at : at + window]])
                raw = found[0].as_py()
                if at + window >= len(text) or len(raw.decode()) + self.LOOK < window:
                    break
                window *= 4
            starts.append(at)
            tables.append((raw, self._table(raw, old_tables[len(tables)] if len(tables) < len(old_tables) else None)))
            at += len(raw.decode())
        self.starts, self.tables = starts, tables

    def _table(self, raw: bytes, old: tuple[bytes, list[int]] | None) -> list[int]:
        shared = 0
        if old:
            most = min(len(raw), len(old[0]))
            while shared < most and raw[shared] == old[0][shared]:
                shared += 1
        self.encoded_bytes += len(raw) - shared
        return self.coder.extend(raw, old[1][:shared] if old else [])


@lru_cache(maxsize=2)
def coder_for(path: str) -> tuple[PrefixCoder, BatchEncoder]:
    """One per Python worker: rebuilding it for every batch would cost more than the batch."""
    coder = PrefixCoder(read_ranks(path))
    return coder, BatchEncoder(coder.encode_pieces, remember=100_000)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_ids(df: DataFrame, *, text: str = "text", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Add the ids of every whole text as ``array<int>`` (null: empty). A column that has the name already stays with ``_input`` after it."""
    path = vocabulary or vocabulary_path()

    def encode(batches):
        import pandas as pd

        for batch in batches:
            yield pd.Series([x.astype(np.int32) for x in coder_for(path)[1].encode(_strings(batch))])

    rows, text = store.set_apart(df, [ids], text)
    return rows.withColumn(ids, _iterating(encode, "array<int>")(store.column(text)))


def with_text(df: DataFrame, *, ids: str = "ids", out: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Add the bytes that an array of ids stands for (null: null). A column that has the name already stays with ``_input`` after it."""
    path = vocabulary or vocabulary_path()

    def decode(batches):
        import pandas as pd

        for batch in batches:
            coder = coder_for(path)[0]
            yield pd.Series([None if x is None else coder.decode(x.tolist()) for x in batch], dtype=object)

    rows, ids = store.set_apart(df, [out], ids)
    return rows.withColumn(out, _iterating(decode, "binary")(store.column(ids)))


def _strings(batch) -> list[str | None]:
    return [x if isinstance(x, str) else None for x in batch]


def _iterating(func, kind: str):
    from pyspark.sql.pandas.functions import PandasUDFType, pandas_udf

    return pandas_udf(func, kind, PandasUDFType.SCALAR_ITER)


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode_digests(df: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encode and decode every text; digests of the ids (little-endian, unsigned 32 bits) and decoded bytes.

    Ids and bytes stay inside one Python pass, as nothing else needs them; ``with_ids`` and ``with_text``
    return them.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, encoder = coder_for(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(coder.decode(x.tolist())).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select(store.column(key).cast("long").alias("doc_id"), store.column(text).alias("text")).mapInArrow(run, DIGEST_SCHEMA)


def op2_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(store.read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_prefix_bpe": op2_prefix_bpe}
SQL: dict[str, str] = {}
