"""Token ids as length-delimited binary records, with a separate offset index.

A record is framed as: payload length (unsigned 64-bit), masked checksum of those 8 bytes (unsigned
32-bit), payload, masked checksum of the payload, one line feed. All numbers are little-endian. A masked
checksum is CRC-32 rotated right by 15 bits plus a constant, so that a checksum stored inside checksummed
data doesn't vanish. The payload is the document's id (signed 64-bit), the bytes per token id (one byte: 2
or 4, the fewest that hold all of the record's ids) and the token ids, unsigned.

Spark's own text writer puts out the frames (the line feed is its separator), so files go through the
task commit protocol of any file system that Spark writes to: a lost executor leaves no half file, and
nothing is opened by path on an executor. Files ascend in document id, within and among each other. The
index has file, offset and length of each record for reading records in any order.

Documents with a null id come first; repeated ids keep one record per row; null and empty texts have the
end id only. An empty table writes no records and gives an empty index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .bpe import vocabulary_path
from .pieces import BatchEncoder

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
NO_ID = -(1 << 63)
#: Bytes of text of a file; its records are smaller. A reader holds one file.
FILE_BYTES = 256_000_000
#: Pieces that the library encodes as the words of one sequence.
SEQUENCE = 256
MASK_DELTA = 0xA282EAD8
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<IB")
INDEX_SCHEMA = "file string, ordinal long, offset long, length long, doc_id long, n_tokens long, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int, ids: np.ndarray) -> bytes:
    """One record without its line feed."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = struct.pack("<qB", doc_id, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def parse(raw: bytes, offset: int = 0) -> tuple[int, np.ndarray, int]:
    """The record at ``offset``: document id, token ids, offset of the next; fails if a checksum differs."""
    size, length_crc = HEAD.unpack_from(raw, offset)
    if masked_crc(raw[offset : offset + 8]) != length_crc:
        raise ValueError(f"the length at {offset} is damaged")
    begin, end = offset + HEAD.size, offset + HEAD.size + size
    payload = raw[begin:end]
    payload_crc, feed = TAIL.unpack_from(raw, end)
    if len(payload) != size or masked_crc(payload) != payload_crc or feed != 10:
        raise ValueError(f"the record at {offset} is damaged")
    doc_id, width = struct.unpack_from("<qB", payload)
    return doc_id, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4"), end + TAIL.size


@lru_cache(maxsize=2)
def encoder_for(path: str) -> BatchEncoder:
    """The tokenizers library over distinct pieces, many in one sequence.

    The pieces are cut already, so the library's own pattern is left out; each is a word of a sequence and is merged by itself. The ids of a
    sequence are dealt back to its pieces by their lengths in bytes, which are those of the piece together.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True  # their strings in a text are ordinary text
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    vocabulary = library.get_vocab()
    width = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        width[i] = len(token)  # a character stands for a byte

    def encode_pieces(pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(pieces), 20_000):
            batch = pieces[at : at + 20_000]
            words = [p.decode() for p in batch]
            groups = [words[k : k + SEQUENCE] for k in range(0, len(words), SEQUENCE)]
            coded = library.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(x.ids for x in coded), np.uint32)
            upto = np.cumsum(width[ids])
            ends = np.cumsum(np.fromiter(map(len, batch), np.int64, len(batch)))
            cuts = np.searchsorted(upto, ends)
            if len(cuts) and (cuts[-1] != len(ids) - 1 or (upto[cuts] != ends).any()):  # a vocabulary without some bytes: one by one
                out.extend(np.array(x.ids, "<u4").tobytes() for x in library.encode_batch_fast(words, add_special_tokens=False))
                continue
            raw, low = ids.astype("<u4").tobytes(), 0
            for high in (4 * (cuts + 1)).tolist():
                out.append(raw[low:high])
                low = high
        return out

    return BatchEncoder(encode_pieces)


def write_records(
    df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, files: int | None = None
) -> None:
    """Encode every whole text, append ``end_id`` and write the records under ``path`` in ascending ``key``."""
    spark = df.sparkSession
    tokenizer = vocabulary or vocabulary_path(VOCABULARY)
    if not files:
        size = df.agg(F.sum(F.octet_length(store.column(text)))).first()[0] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = part.column(0).to_pylist()
                ids = encoder.encode(part.column(1).to_pylist())
                framed = [frame(NO_ID if k is None else k, np.append(x, np.uint32(end_id))) for k, x in zip(keys, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(framed, pa.binary())], names=["frame"])

    rows = df.select(store.column(key).cast("long").alias("k"), store.column(text).alias("t"))
    dealt = rows.repartitionByRange(files, F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), F.col("t"))
    dealt.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Scan the record files, verify every checksum, and return one row per record: the offset index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py()
                file, at, rows = name.rsplit("/", 1)[-1], 0, []
                while at < len(raw):
                    doc_id, ids, after = parse(raw, at)
                    rows.append((file, len(rows), at, after - at, None if doc_id == NO_ID else doc_id, len(ids), zlib.crc32(ids.tobytes())))
                    at = after
                columns = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.string(), *[pa.int64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "ordinal", "offset", "length", "doc_id", "n_tokens", "ids_crc32"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return found.mapInArrow(run, INDEX_SCHEMA)


def with_starts(index: DataFrame) -> DataFrame:
    """Add ``start``: how many ids precede a record. Totals per file are few (one row for each file)."""
    from pyspark.sql import Window

    number = F.regexp_extract("file", r"^part-([0-9]+)", 1).cast("long")  # names don't sort beyond five digits
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return (
        index.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(bases, "file")
        .withColumn("start", (F.col("base") + F.col("inner")).cast("long"))
        .drop("inner", "base")
    )


def write_dataset(df: DataFrame, path: str, **options) -> DataFrame:
    """Records under ``path``/records, the index with starts under ``path``/index; returns the index as read."""
    spark = df.sparkSession
    write_records(df, f"{path}/records", **options)
    with_starts(read_index(spark, f"{path}/records")).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_shuffled(spark: SparkSession, path: str, *, seed: int = 0) -> DataFrame:
    """All records as (doc_id, ids) in an order drawn from ``seed``, found through the offset index."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    order = F.xxhash64(F.lit(seed), "file", "ordinal")
    entries = spark.read.parquet(f"{path}/index").groupBy("file").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "offset"))).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, entries in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = raw.as_py()
                found = [(e["o"], *parse(raw, e["offset"])[:2]) for e in entries]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in found], pa.int64()), pa.array([None if x[1] == NO_ID else x[1] for x in found], pa.int64()), pa.array([x[2].astype(np.int64) for x in found], pa.list_(pa.int64()))],
                    names=["o", "doc_id", "ids"],
                )

    return files.join(entries, "file").select("content", "entries").mapInArrow(run, "o long, doc_id long, ids array<long>").orderBy("o").drop("o")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_dataset(store.read_table(spark, sf_dir, "documents"), store.fresh_path(spark, "records"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32", "file", "offset", "length")


QUERIES = {"op10_token_records": op10_token_records}
SQL: dict[str, str] = {}
