"""Secret scans: patterns find candidates, ownership over the whole corpus tells examples from credentials.

A candidate is a match of a pattern of ``KINDS`` whose value is long enough. Its value is hashed, and for each hash the distinct
repositories and owners that hold it are counted over all documents: a value that ``COPIED`` or more owners hold is a widely copied example;
one that fewer hold is owner-specific, however often the owner repeats it, and *live-looking* if its characters are varied and it names no
placeholder. The kinds of ``BASE`` are always reported, with their verdict; the wider kinds only where a value is live-looking.

All of it is expressions of Spark. Places come from the matches and the gaps between them (``split`` by the same pattern): lengths
only go on, and a window adds them up for each row. Owners are counted from distinct (hash, owner, repository) and then by owner, so that a
value that a third of all documents hold has a row for each task before it is exchanged; verdicts return by a join, whose large keys
Spark splits.

Places are in code points, ends exclusive. Null texts count as empty; a null owner or repository is one of its own. A row
is a document, so repeated rows are reported for each. The kinds may overlap; spans of equal start stand in the order of ``KINDS``. A very
long text yields as many candidates as it holds. An empty table gives an empty result. Other columns pass through ``with_findings``; those
with a result's name get ``_input`` after theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

#: The patterns of the base kinds, with letters in either case spelt out, and the least length of a value.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Tokens that their issuers mark by a prefix, keys in armour, signed tokens, and passwords in addresses.
ISSUED = "|".join((
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{40,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"sk-[A-Za-z0-9_-]{20,}",
    r"xox[abeoprs]-[A-Za-z0-9-]{10,}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"[sr]k_live_[A-Za-z0-9]{16,}",
    r"npm_[A-Za-z0-9]{36}",
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D]+",
    r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~%-]{1,80}:[A-Za-z0-9._~%!$&*+,;=-]{6,}@",
))
#: Long runs of the letters of base 64.
OPAQUE = r"[A-Za-z0-9+/_-]{32,}"
#: By kind: the pattern, the group that is the value, the least length of it.
KINDS = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24), "issued": (ISSUED, 0, 14), "opaque": (OPAQUE, 0, 32)}
BASE = ("assign", "access", "hex")
#: Owners from which on a value counts as an example that everybody copies.
COPIED = 3
#: Different characters that a live-looking value has at least, and what names a placeholder.
VARIED = 6
PLACEHOLDER = "example|sample|changeme|change_me|placeholder|dummy|your|xxxx|1234567|abcdef0123|redacted|insert"
RESULTS = ("findings",)
FINDING = "array<struct<start:bigint,place:int,kind:string,end:bigint,value_start:bigint,digest:string,owners:bigint,repositories:bigint,verdict:string>>"


FOUND = "array<struct<place:int,number:int,gap:bigint,size:bigint,value_size:bigint,digest:string,looks:boolean>>"


def _matches(text: Column, place: int, kind: str) -> Column:
    """The matches of a kind in order: gap before, length, and length, digest and looks of the value."""
    pattern, group, least = KINDS[kind]
    gaps = F.transform(F.split(text, F.lit(pattern), -1), lambda g: F.length(g).cast("long"))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(gaps, whole, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))  # each made once; the last gap has no match

    def row(x: Column, number: Column) -> Column:
        v = x["2"]
        looks = (F.array_size(F.array_distinct(F.split(v, F.lit("")))) >= VARIED) & ~F.lower(v).rlike(PLACEHOLDER)
        return F.struct(F.lit(place), number, x["0"], F.length(x["1"]).cast("long"), F.length(v).cast("long"), F.when(F.length(v) >= least, F.sha2(v.cast("binary"), 256)), looks)

    return F.when(text.rlike(pattern), F.transform(zipped, row).cast(FOUND))


def scanned(docs: DataFrame, *, text: str, owner: str, repository: str, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` as (number, row, owner, repository, found); ``row`` has the columns of ``keep``, all if not given."""
    whole = F.coalesce(store.column(text), F.lit(""))
    found = F.concat(*[F.coalesce(_matches(whole, place, kind), F.array().cast(FOUND)) for place, kind in enumerate(KINDS)])
    row = store.whole_row(docs.select(*map(store.column, docs.columns if keep is None else keep)), RESULTS)
    return docs.select(F.monotonically_increasing_id().alias("number"), row.alias("row"), store.column(owner).alias("owner"), store.column(repository).alias("repository"), found.alias("found"))


def placed(rows: DataFrame) -> DataFrame:
    """A row for each candidate of ``scanned`` with its places: lengths of gaps and matches added up within the row and kind."""
    each = rows.select("number", "owner", "repository", F.explode("found").alias("m"))
    before = Window.partitionBy("number", "m.place").orderBy("m.number").rowsBetween(Window.unboundedPreceding, 0)
    at = each.select("number", "owner", "repository", "m", F.sum(F.col("m.gap") + F.col("m.size")).over(before).alias("end")).where("m.digest is not null")
    start, value_start = F.col("end") - F.col("m.size"), F.col("end") - F.col("m.value_size")
    return at.select("number", "owner", "repository", "m.place", start.alias("start"), "end", value_start.alias("value_start"), "m.digest", "m.looks")


def ownership(found: DataFrame) -> DataFrame:
    """For each digest the distinct owners, and the distinct repositories (a repository is one of its owner)."""
    owned = found.groupBy("digest", "owner", "repository").agg(F.lit(1)).groupBy("digest", "owner").agg(F.count("*").alias("repositories"))
    return owned.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def verdict(copied: int) -> Column:
    return F.when(F.col("owners") >= copied, "copied").when(F.col("looks"), "live").otherwise("dull")


def with_findings(docs: DataFrame, *, text: str = "text", owner: str = "source", repository: str = "doc_id", copied: int = COPIED, keep: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (of its columns those of ``keep``, all if not given) with ``findings``: all spans of the base kinds and
    the live-looking ones of the others, in order."""
    rows = store.materialise(scanned(docs, text=text, owner=owner, repository=repository, keep=keep), "secrets-scanned")
    found = store.materialise(placed(rows), "secrets-candidates")
    judged = found.join(ownership(found), "digest").withColumn("verdict", verdict(copied))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    kept = judged.where((F.col("place") < len(BASE)) | (F.col("verdict") == "live"))
    one = F.struct("start", "place", kinds[F.col("place")].alias("kind"), "end", "value_start", "digest", "owners", "repositories", "verdict")
    listed = kept.groupBy("number").agg(F.array_sort(F.collect_list(one)).cast(FINDING).alias("findings"))
    return rows.join(listed, "number", "left").select("row.*", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def spans(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op12_owned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = store.read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = with_findings(documents, keep=["doc_id"])
    f = F.col("findings")
    count = lambda field, wanted: F.array_size(F.filter(f, lambda x: x[field] == wanted)).cast("long")
    return found.select(
        "doc_id",
        *[count("kind", k).alias(f"n_{k}") for k in BASE],
        F.sha2(spans(F.filter(f, lambda x: x["kind"].isin(*BASE))).cast("binary"), 256).alias("base_sha256"),
        spans(f).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "copied").alias("n_copied"),
    )


def _in_sql(kind: str, place: int) -> str:
    pattern, group, least = KINDS[kind]
    quoted = pattern.replace("'", "''")
    return f"""
        SELECT doc_id, source, '{kind}' AS kind, {place} AS place, {least} AS least, unnest(range(len(whole))) AS i, unnest(whole) AS whole, unnest(value) AS value, unnest(gaps[:len(whole)]) AS gap FROM (
            SELECT doc_id, source, regexp_extract_all(text, '{quoted}', 0) AS whole, regexp_extract_all(text, '{quoted}', {group}) AS value, string_split_regex(text, '{quoted}') AS gaps
            FROM documents WHERE regexp_matches(text, '{quoted}')
        )"""


QUERIES = {"op12_owned_secrets": op12_owned_secrets}
SQL = {
    "op12_owned_secrets": f"""
        WITH matches AS ({" UNION ALL ".join(_in_sql(kind, place) for place, kind in enumerate(KINDS))}),
        places AS (
            SELECT *, (sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS stop FROM matches
        ),
        owned AS (SELECT value, count(DISTINCT coalesce('+' || source, '')) AS owners FROM places WHERE length(value) >= least GROUP BY value),
        judged AS (
            SELECT doc_id, kind, place, stop - length(whole) AS start, kind || ':' || (stop - length(whole)) || ':' || stop AS span,
                CASE WHEN owners >= {COPIED} THEN 'copied' WHEN len(list_distinct(string_split(value, ''))) >= {VARIED} AND NOT regexp_matches(lower(value), '{PLACEHOLDER}') THEN 'live' ELSE 'dull' END AS verdict
            FROM places JOIN owned USING (value) WHERE length(value) >= least
        ),
        kept AS (SELECT * FROM judged WHERE place < {len(BASE)} OR verdict = 'live'),
        listed AS (
            SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
                coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (place < {len(BASE)}), '') AS base, string_agg(span, ',' ORDER BY start, place) AS spans,
                count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'copied') AS n_copied
            FROM kept GROUP BY doc_id
        )
        SELECT doc_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in (*(f"n_{k}" for k in BASE), "n_live", "n_copied"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents LEFT JOIN listed USING (doc_id)
    """,
}
