"""Registered queries of versioned tables, audited publishing and stored files, on the turns of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble, integrity
from ..sources import versions
from .driver_queries import query, table

#: Turns as pages: numbered within their conversation.
TURNS = """SELECT conv_id AS vid, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS id, turn * 60.0 AS t_start,
 role, coalesce(text, '') AS text FROM {conversations}"""
#: The same conversations cut anew: short turns are no pages of their own.
RECUT = f"SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY id) AS id, t_start, role, text FROM ({TURNS}) t WHERE length(text) >= 60"


def _made(spark, sf_dir: str, sql: str):
    return spark.sql(sql, conversations=table(spark, sf_dir, "conversations"))


def _duck(**parts: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v.replace('{conversations}', 'conversations')})" for k, v in parts.items())


def _pages(spark, sf_dir: str, sql: str):
    return _made(spark, sf_dir, sql).withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")


@query(_duck(old=TURNS, new=RECUT) + """,
told AS (SELECT v, vid, count(*) AS n, string_agg(id || '|' || printf('%.1f', t_start), ',' ORDER BY id) AS places,
 string_agg(id || '|' || printf('%.1f', t_start) || '|' || role || '|' || sha256(text), ',' ORDER BY id) AS whole
 FROM (SELECT 1 AS v, * FROM old UNION ALL SELECT 2, * FROM new) GROUP BY ALL)
SELECT vid, coalesce(a.n, 0) AS pages_before, coalesce(b.n, 0) AS pages_now, a.places IS DISTINCT FROM b.places AS order_changed, a.whole IS DISTINCT FROM b.whole AS identity_changed, 2 AS in_force
FROM (SELECT * FROM told WHERE v = 1) a FULL JOIN (SELECT * FROM told WHERE v = 2) b USING (vid)""")
def page_versions(spark, sf_dir):
    """Two versions of a page table are written; the older one is read back and held against the one in force."""
    pages = versions.VersionedTable(spark, versions.fresh_folder(spark, "pages"))
    first = pages.write(_pages(spark, sf_dir, TURNS), "as fetched")
    pages.write(_pages(spark, sf_dir, RECUT), "cut anew")
    changes = versions.page_changes(pages.read(first), pages.read(), key=["vid"], order="id", time="t_start", fields=[F.col("role"), F.col("sha256")])
    return changes.withColumn("in_force", F.lit(pages.current()))


#: What is wrong with the second map of tiles: pictures that changed, columns beyond the sheet.
FAULTS = {"sha256": ("vid % 5 = 0", "'other'"), "tile_col": ("vid % 7 = 0 AND index_ % 4 = 0", "tile_col + 3")}
GOOD = f"""SELECT vid, id AS index_, (id - 1) // 12 + 1 AS sheet, (id - 1) % 12 // 3 + 1 AS tile_row, (id - 1) % 3 + 1 AS tile_col, sha256(text) AS sha256 FROM ({TURNS}) t"""


@query(_duck(good=GOOD) + f""",
bad AS (SELECT * REPLACE ({", ".join(f"CASE WHEN {when} THEN {then} ELSE {c} END AS {c}" for c, (when, then) in FAULTS.items())}) FROM good),
issues AS (
 SELECT 'V-50-hash' AS code FROM bad JOIN good g USING (vid, index_) WHERE bad.sha256 <> g.sha256
 UNION ALL SELECT 'V-50-col' FROM bad WHERE tile_col NOT BETWEEN 1 AND 3
 UNION ALL SELECT 'V-50-place' FROM bad WHERE (sheet - 1) * 12 + (tile_row - 1) * 3 + tile_col <> index_),
sizes AS (SELECT count(*) AS n, count(*) FILTER (vid % 5 <> 0 AND vid % 7 <> 0) AS fewer FROM good)
SELECT 1 AS attempt, true AS published, 1 AS in_force, n AS tiles, NULL AS code, 0 AS issues FROM sizes
UNION ALL SELECT 2, false, 1, (SELECT n FROM sizes), code, count(*) FROM issues GROUP BY code
UNION ALL SELECT 3, true, 2, fewer, NULL, 0 FROM sizes""")
def audited_tiles(spark, sf_dir):
    """Three maps of tiles: a good one, one with faults that is written, judged and not published, and a smaller good one."""
    turns = _made(spark, sf_dir, TURNS)
    frames = turns.select("vid", F.concat(F.lit("f"), "id").alias("frame"), (F.col("id") * 2.0).alias("t"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.lit(0).alias("window"), "id")
    tiles = assemble.tile_map(frames, key=["vid"], order=["id"]).drop("id")
    sheets = tiles.select("vid", "sheet").distinct()
    faults = {c: F.expr(f"CASE WHEN {when.replace('index_', 'index')} THEN {then} ELSE {c} END") for c, (when, then) in FAULTS.items()}
    fewer = "vid % 5 <> 0 AND vid % 7 <> 0"
    maps = versions.VersionedTable(spark, versions.fresh_folder(spark, "tiles"))
    out = None
    for attempt, made, shown in ((1, tiles, sheets), (2, tiles.withColumns(faults), sheets), (3, tiles.where(fewer), sheets.where(fewer))):
        version, found = maps.audited(made, lambda df, shown=shown: integrity.tile_rules(df, frames, shown))
        tally = found.groupBy("code").agg(F.count("*").alias("issues"))
        if version:
            tally = spark.range(1).select(F.lit(None).cast("string").alias("code"), F.lit(0).cast("long").alias("issues"))
        told = tally.select(F.lit(attempt).alias("attempt"), F.lit(version is not None).alias("published"), F.lit(maps.current()).alias("in_force"), F.lit(maps.read().count()).alias("tiles"), "code", "issues")
        out = told if out is None else out.unionByName(told)
    return out


#: Files of 32 conversations each: a line for each turn.
PAGES = f"""SELECT CAST(vid // 32 % 2 AS INT) AS vid, CAST(vid // 32 AS INT) AS id, vid AS conv, id AS ord, vid || '|' || id || '|' || role || '|' || sha256(text) AS line FROM ({TURNS}) t"""


@query(_duck(lines=PAGES) + """,
pages AS (SELECT vid, id, string_agg(line, chr(10) ORDER BY conv, ord) AS text FROM lines GROUP BY ALL),
stored AS (SELECT vid, id, CASE WHEN id % 3 = 1 THEN 'changed ' ELSE '' END || text AS text FROM pages WHERE id % 5 <> 2
 UNION ALL SELECT vid, id + 1000000, text FROM pages WHERE id % 5 = 3),
met AS (SELECT vid, id, 'sha256:' || sha256(p.text || chr(10)) AS recorded, 'sha256:' || sha256(s.text || chr(10)) AS actual FROM pages p FULL JOIN stored s USING (vid, id)),
ids AS (SELECT vid, sha256('pages/1' || chr(10) || string_agg(id || '|' || recorded, chr(10) ORDER BY id) FILTER (recorded IS NOT NULL)) AS recorded_id,
 sha256('pages/1' || chr(10) || string_agg(id || '|' || actual, chr(10) ORDER BY id) FILTER (actual IS NOT NULL)) AS actual_id FROM met GROUP BY vid)
SELECT vid, recorded_id, actual_id, coalesce(list(id ORDER BY id) FILTER (actual IS NULL), []) AS missing, coalesce(list(id ORDER BY id) FILTER (recorded <> actual), []) AS changed,
 coalesce(list(id ORDER BY id) FILTER (recorded IS NULL), []) AS unrecorded FROM met JOIN ids USING (vid) GROUP BY ALL""")
def recomputed_digests(spark, sf_dir):
    """Files written from a table, some since changed, lost or added: their digests made anew against the recorded ones."""
    lines = _made(spark, sf_dir, TURNS).select(
        F.expr("CAST(vid div 32 % 2 AS INT)").alias("vid"), F.expr("CAST(vid div 32 AS INT)").alias("id"), F.col("vid").alias("conv"), F.col("id").alias("ord"),
        F.concat_ws("|", "vid", "id", "role", F.sha2(F.col("text").cast("binary"), 256)).alias("line"),
    )
    pages = assemble.joined_lines(lines, key=["vid", "id"], order=["conv", "ord"], line=F.col("line"))
    folder = versions.fresh_folder(spark, "files")
    recorded = versions.VersionedTable(spark, f"{folder}/recorded")
    recorded.write(pages.withColumn("recorded", assemble.file_digest(F.concat("text", F.lit("\n")).cast("binary"))))
    stored = recorded.read()
    kept = stored.where("id % 5 <> 2").withColumn("text", F.concat(F.when(F.expr("id % 3 = 1"), "changed ").otherwise(""), "text"))
    added = stored.where("id % 5 = 3").withColumn("id", F.expr("id + 1000000"))
    versions.write_pages(kept.unionByName(added), f"{folder}/pages", key=["vid", "id"], text="text")
    files = versions.file_digests(spark, f"{folder}/pages", key=["vid", "id"])
    return versions.recomputed_sets(stored.drop("text"), files, key=["vid"], page="id")
