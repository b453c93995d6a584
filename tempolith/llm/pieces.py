"""Splitting texts into the pre-token pieces of byte-level BPE, whole batches at a time.

The pattern is that of ``public_tokenizers.PATTERN`` (contractions, letters, digits, other marks, white
space). A batch is split by array operations on code point classes instead of a regex engine: a run of one
class is a piece, a single U+0020 before a run joins it, and a white-space run leaves its last character to
what follows. Distinct pieces are found by Arrow's dictionary encoding, so that an encoder sees each piece
of a batch once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)
#: What may follow an apostrophe in a contraction.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
CHUNK_CHARS = 2_000_000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, asked of the regex engine that the tiktoken library uses.

    With single bytes as ranks and a class as pattern, an encoding of all code points holds the bytes of
    those in the class only.
    """
    import tiktoken

    table = np.zeros(0x110000, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    alone = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        coded = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=alone, special_tokens={})
        members = bytes(coded.encode_ordinary(text)).decode()
        table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    return table


def cut_long(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """Cut a very long text where a piece surely starts: before a U+0020 that follows a non-space."""
    parts, at = [], 0
    table = class_table()
    while len(text) - at > 2 * size:
        cut = text.find(" ", at + size)
        while cut != -1 and table[ord(text[cut - 1])] == SPACE:
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


def split_pieces(texts: Sequence[str]) -> tuple[pa.BinaryArray, np.ndarray]:
    """All pieces of ``texts`` in order, and how many each text has."""
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1  # the separators' places
    cls = class_table()[cp]
    cls[ends] = BREAK
    n = len(cp)
    before = np.empty(n, np.uint8)
    before[0] = BREAK
    before[1:] = cls[:-1]
    start = cls != before
    start[ends] = True
    start[1:][cls[:-1] == BREAK] = True
    start[0] = True
    # the last character of a white-space run before a visible run
    solid = (cls != SPACE) & (cls != BREAK)
    heads = np.flatnonzero(start & solid & (before == SPACE))
    last = heads - 1
    plain = cp[last] == 32
    start[last] = True
    start[heads[plain]] = False
    # contractions: a lone apostrophe, no blank before it, letters right behind it
    marks = np.flatnonzero((cp == 39) & start)
    marks = marks[marks + 1 < n]
    marks = marks[cls[marks + 1] == LETTER]
    for i in marks:
        two = joined[i + 1 : i + 3]
        step = 1 if two[:1] in ONE_LETTER else 2 if two in TWO_LETTERS else 0
        if step:
            start[i + 1] = False
            start[i + 1 + step] = True
    at = np.flatnonzero(start)
    raw = joined.encode()
    if len(raw) == n:
        offsets = at
    else:
        width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
        total = np.cumsum(width, dtype=np.int64)
        offsets = total[at] - width[at]
    offsets = np.append(offsets, len(raw)).astype(np.int32)
    everything = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    real = cls[at] != BREAK
    owner = np.searchsorted(ends, at[real], side="left")
    return everything.filter(pa.array(real)), np.bincount(owner, minlength=len(texts))


class BatchEncoder:
    """Encode batches of texts with a function of one piece, remembering pieces in two bounded tables.

    A full table becomes the older one, and the older one goes: pieces that keep coming back move to the new table, those seen once go.
    The function gives a piece's ids as numbers, or as bytes of little-endian 32-bit numbers.
    """

    def __init__(self, encode_pieces: Callable[[list[bytes]], Sequence[Sequence[int] | bytes]], remember: int = 200_000):
        self.encode_pieces, self.remember = encode_pieces, remember
        self.known: dict[bytes, bytes] = {}  # ids as 32-bit numbers: a fifth of a tuple's memory
        self.older: dict[bytes, bytes] = {}

    def chunk(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, counts = split_pieces(texts)
        coded = pieces.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(distinct) > self.remember:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = []
        for piece in distinct:
            if piece not in known:
                if piece in older:
                    known[piece] = older[piece]
                else:
                    new.append(piece)
        for piece, ids in zip(new, self.encode_pieces(new), strict=True):
            known[piece] = ids if isinstance(ids, bytes) else pack(f"<{len(ids)}I", *ids)
        coded_ids = [known[p] for p in distinct]
        size = np.fromiter(map(len, coded_ids), np.int64, len(coded_ids)) // 4
        flat = np.frombuffer(b"".join(coded_ids), "<u4")
        begin = np.cumsum(size) - size
        each = size[codes]
        total = np.cumsum(each)
        out = flat[np.repeat(begin[codes] - (total - each), each) + np.arange(int(each.sum()))]
        upto = np.concatenate([[0], total])[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        return out, upto

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: none), 32-bit."""
        parts: list[str] = []
        owner: list[int] = []
        for k, text in enumerate(texts):
            for part in cut_long(text or ""):
                parts.append(part)
                owner.append(k)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        at = 0
        while at < len(parts):
            to, chars = at, 0
            while to < len(parts) and (to == at or chars + len(parts[to]) <= CHUNK_CHARS):
                chars += len(parts[to]) + 1
                to += 1
            flat, upto = self.chunk(parts[at:to])
            low = 0
            for k, high in zip(owner[at:to], upto.tolist(), strict=True):
                out[k].append(flat[low:high])
                low = high
            at = to
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]
