"""Language identification by compression.

A text is compressed once per language with a zstandard compressor primed with raw content of that
language; the language whose dictionary leaves the fewest bytes wins. Long texts are compressed in blocks
of ``BLOCK`` bytes, all of them, so that the dictionary and not the text's own past decides. The margin is
how much larger the second-best result is. Where it is narrow, as for short texts whose sizes tie in whole bytes,
the text is compressed once more behind each of ``STRETCHES`` stretches of each language's content, and the sums of
the bytes that it adds decide and give the margin; a margin that is narrow even then is a rejection.

Null texts and texts without a letter are ``und`` with score 0. Equal sums go to the language with more
learned documents, then to the first in alphabetical order, with score 0. With no learned language everything is ``und``.
A null id is not held out. Repeated rows get equal results; an empty table gives an empty one. Other columns pass through; those with a
result's name get ``_input`` after theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import store

#: The bounds of what is learned from: documents and bytes of raw content per language, and bytes of all languages together. Every
#: language is learned; where there are more than ``SAMPLE_BYTES // DICTIONARY_BYTES`` of them, each from fewer bytes and documents.
SAMPLE_DOCUMENTS, DICTIONARY_BYTES, SAMPLE_BYTES = 400, 131_072, 1 << 25
BLOCK = 4096
LEVEL = 5
STRETCHES, STRETCH = 16, 2048
UNDETERMINED = "und"
#: A margin (as a share of the best size) below this is narrow: the two languages explain the text alike.
NARROW = 0.002
SCHEMA = "lang_pred string, score double, margin double"


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(df: DataFrame, *, text: str = "text", label: str = "lang", documents: int = SAMPLE_DOCUMENTS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw content per language, most frequent language first, from labelled rows: of each language's different texts
    the ``documents`` least by hash, equal parts of each up to ``size`` bytes. What can't be among them is left out by a
    threshold on the hash before anything is exchanged, so a frequent language or text costs no task more than others."""
    rows = df.where(store.column(label).isNotNull() & (F.length(store.column(text)) > 0)).select(store.column(label).alias("lang"), store.column(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "lang").collect()  # a row for each language
    if not counts:
        return {}
    fitting = max(1, min(size, SAMPLE_BYTES // len(counts)))
    documents, size = max(1, documents * fitting // size), fitting
    # four times as many as needed pass, so that fewer than needed are as good as impossible
    least = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4 * max(documents, 100) / max(r["texts"], 1)))])
    share = max(1, size // documents)
    parts = (
        rows.where(F.pmod("h", F.lit(1 << 32)) / F.lit(float(1 << 32)) < F.try_element_at(least, F.col("lang")))
        # a middle part: beginnings may hold titles and markup; only the part is exchanged
        .select("lang", "h", F.expr(f"substring(text, greatest(1, cast(length(text) / 2 as int) - {share}), {4 * share})").alias("part"))
        .groupBy("lang", "h").agg(F.min("part").alias("part"))
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
        .where(F.col("n") <= documents)
    )
    content: dict[str, list[bytes]] = {}
    for row in parts.select("lang", "n", "part").orderBy("lang", "n").collect():  # short parts, four times SAMPLE_BYTES at most
        content.setdefault(row["lang"], []).append(row["part"].lower().encode())
    out = {}
    for lang in (r["lang"] for r in counts if r["lang"] in content):
        each = max(1, size // len(content[lang]))
        out[lang] = b"\n".join(p[:each] for p in content[lang])[:size]
    return out


class Compressors:
    def __init__(self, content: dict[str, bytes]):
        import zstandard

        self.names = list(content)  # the more frequent wins a tie
        self.of = []
        for name in self.names:
            primed = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=LEVEL)
            self.of.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False))

        # behind a stretch, letters are coded by how often the language has them: a finer grain than whole bytes
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.stretches = []
        for name in self.names:
            last = max(0, len(content[name]) - STRETCH)
            parts = [content[name][k * last // (STRETCHES - 1) :][:STRETCH] + b"\n" for k in range(STRETCHES)]
            self.stretches.append([(p, len(self.plain.compress(p))) for p in parts])

    def sizes(self, raw: bytes) -> list[int]:
        parts = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.of]

    def added(self, raw: bytes) -> list[int]:
        """Bytes that the text adds behind each language's stretches, summed."""
        parts = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(self.plain.compress(s + p)) - alone for s, alone in of for p in parts) for of in self.stretches]

    @staticmethod
    def ranked(sizes: list[int]) -> tuple[int, float]:
        """The least of ``sizes``, and by which share of it the second is larger."""
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[order[0]]
        return order[0], (sizes[order[1]] - best) / max(best, 1) if len(order) > 1 else 1.0

    def judge(self, text: str | None) -> tuple[str, float, float]:
        if text is None or not self.names or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0
        raw = text.lower().encode()  # case tells nothing of the language
        first, margin = self.ranked(self.sizes(raw))
        if margin < NARROW:
            first, margin = self.ranked(self.added(raw))
        return self.names[first], min(1.0, margin / (margin + 0.05)), margin


RESULTS = ("lang_pred", "score", "margin")


def classify(df: DataFrame, content: dict[str, bytes], *, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``margin`` for every whole text."""
    rows, text = store.set_apart(df, RESULTS, text)
    judged = store.free_name(rows, "judged")
    return rows.withColumn(judged, _judge(content)(store.column(text))).select(*[store.column(c) for c in rows.columns], f"{judged}.*")


def _judge(content: dict[str, bytes]):
    from pyspark.sql.pandas.functions import PandasUDFType, pandas_udf

    def run(batches):
        import pandas as pd

        models = Compressors(content)
        for batch in batches:
            yield pd.DataFrame([models.judge(x if isinstance(x, str) else None) for x in batch], columns=list(RESULTS))

    return pandas_udf(run, SCHEMA, PandasUDFType.SCALAR_ITER)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = store.read_table(spark, sf_dir, "documents")
    content = learn(documents.where(~held_out()))
    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return classify(rows, content).select("doc_id", "held_out", "lang_pred", "score", "margin")


def identified(docs: DataFrame, content: dict[str, bytes], *, text: str = "text", narrow: float = NARROW) -> DataFrame:
    """The rows of ``docs`` whose language is told with a margin that isn't narrow, columns as they were."""
    judged = store.free_name(docs, "judged")
    told = docs.withColumn(judged, _judge(content)(store.column(text)))
    return told.where((F.col(f"{judged}.lang_pred") != UNDETERMINED) & (F.col(f"{judged}.margin") >= narrow)).drop(judged)


def language_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op8: which documents are held out, and which have no letter."""
    return op8_language(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == UNDETERMINED).alias("undetermined"))


QUERIES = {"op8_language": op8_language, "language_flags": language_flags}
SQL = {
    "language_flags": """
        WITH b AS (
            SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i)
        ), t AS (SELECT list(c ORDER BY i) AS t FROM b),
        d AS (SELECT doc_id, text, hex(encode(doc_id::VARCHAR)) AS h FROM documents)
        SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || substr(h, 2 * k + 1, 2))::UBIGINT FOR k IN range(length(h) // 2)]), lambda c, x: xor(t[(xor(c, x) & 255)::INT + 1], c >> 8)), 4294967295::UBIGINT) % 5 = 0 AS held_out,
            NOT regexp_matches(coalesce(text, ''), '\\pL') AS undetermined
        FROM d, t
    """,
}
