"""The rules of ``operators.integrity`` over artifacts made from the driver tables, each rule anew in SQL.

Every artifact is one SELECT that Spark and DuckDB both read; ``_ARRAY`` and the like stand for what they write differently. Faults of every
kind are spread over all rows by arithmetic on keys, so that each rule has rows to find and rows to leave.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity
from .driver_queries import query, table

HMS = "lpad(CAST(CAST(floor({0} / 3600) AS INT) AS VARCHAR(9)), 2, '0') || ':' || lpad(CAST(CAST(floor({0} / 60) AS INT) % 60 AS VARCHAR(9)), 2, '0') || ':' || lpad(CAST(CAST({0} AS INT) % 60 AS VARCHAR(9)), 2, '0')"

#: Artifacts as (name, SELECT over tables in braces).
ORDERED = "SELECT o_custkey + 3 AS vid, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS n FROM {orders}"
BEGIN, LENGTH = "(n * 1500 - k % 5 * 400 + 200)", "(k % 7 * 300)"
CHAPTERS = f"""SELECT vid, k, n, CASE WHEN k % 19 = 0 THEN '01' ELSE lpad(CAST(n AS VARCHAR(9)), 2, '0') END AS id, CASE WHEN k % 31 = 0 THEN ' ' WHEN k % 37 = 0 THEN NULL ELSE 'title' END AS title,
 CASE WHEN k % 29 = 0 THEN _ARRAY('00:00:01') WHEN k % 23 = 0 THEN _ARRAY('9:00', '00:10:00') ELSE _ARRAY({HMS.format(BEGIN)}, {HMS.format(f'({BEGIN} + {LENGTH})')}) END AS range, k % 29 <> 0 AND k % 23 <> 0 AS well, {BEGIN} AS a, {BEGIN} + {LENGTH} AS z,
 _ARRAY(CAST(n AS INT), CAST(k % 30 AS INT)) AS slides, 'c' || CAST(k AS VARCHAR(20)) || '.md' AS body, CAST(k % 4 AS INT) AS n_keypoints, CAST(k % 3 AS INT) AS n_questions, CASE WHEN k % 41 = 0 THEN '' ELSE 'notes' END AS coverage_notes,
 CASE WHEN k % 6 = 0 THEN ' ' ELSE 'w' END AS wrong, CASE WHEN k % 10 = 0 THEN NULL ELSE 'r' END AS right_, CAST(CASE WHEN k % 5 = 0 THEN 77 ELSE n END AS INT) AS merged, CAST(CASE WHEN k % 9 = 0 THEN 78 ELSE n END AS INT) AS kept FROM ({ORDERED}) o"""
MANIFESTS = "SELECT c_custkey AS vid, CASE WHEN c_custkey % 11 = 0 THEN 'chapters/0' WHEN c_custkey % 13 = 0 THEN NULL ELSE 'chapters/1' END AS schema, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey % 7 <> 0 END AS video_ok, CAST(c_custkey % 12 AS INT) AS slide_count, 20000 + c_custkey % 3 * 9000 AS duration FROM {customer}"
SLIDES = "SELECT DISTINCT o_custkey + 3 AS vid, CAST(o_orderkey % 12 + 1 AS INT) AS id FROM {orders}"
CUES = "SELECT o_custkey + 3 AS vid, o_orderkey AS seq, o_orderkey % 20000 + 0.5 AS t_from FROM {orders}"
BODY = """CASE WHEN k % 8 = 0 THEN ' ' WHEN k % 8 = 1 THEN '---_NLx: 1' WHEN k % 8 = 2 THEN 'text_NL<!-- meta -->_NL![a](slides/0001.jpg)' WHEN k % 8 = 3 THEN 'no picture' WHEN k % 8 = 4 THEN '![a](../slides/0002.jpg) ![b](figures/fig_1.png) ![c](figures/odd.png)'
 WHEN k % 8 = 5 THEN '![a](slides/12345.jpg) ![b](x/y.gif) ![b](x/y.gif)' ELSE '![a](slides/0001.jpg)_NL![d](sheets/sheet_2.png)' END"""
FILES = f"""SELECT vid, 'chapters/c' || CAST(k AS VARCHAR(20)) || '.md' AS path, {BODY} AS text FROM ({ORDERED}) o WHERE k % 27 <> 4
UNION ALL SELECT DISTINCT o_custkey + 3 AS vid, CASE WHEN o_custkey % 3 = 0 THEN 'slides/0001.jpg' WHEN o_custkey % 3 = 1 THEN 'figures/fig_1.png' ELSE 'slides/0002.jpg' END AS path, '' AS text FROM {{orders}}"""


def _duck(sql: str) -> str:
    return sql.replace("_ARRAY(", "list_value(").replace("_NL", "' || chr(10) || '").replace("{orders}", "orders").replace("{customer}", "customer").replace("{lineitem}", "lineitem").replace("{conversations}", "conversations").replace("VARCHAR(9)", "VARCHAR").replace("VARCHAR(20)", "VARCHAR")


def _spark(spark, sf_dir: str, sql: str):
    names = [n for n in ("orders", "customer", "lineitem", "conversations") if "{" + n + "}" in sql]
    sql = sql.replace("_ARRAY(", "array(").replace("_NL", "' || chr(10) || '").replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def _with(**parts: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({_duck(sql)})" for name, sql in parts.items())


TARGET = r"'!\[[^\]\n]*\]\(([^)\s]+)\)', 1"
KNOWN = r"'^(?:[^()\s]*/)?(?:slides/\d{1,4}\.(jpg|png)|sheets/sheet_\d+\.(jpg|png)|figures/fig_\d+\.(jpg|png))$'"


def _issue(level: str, code: str, source: str, chapter: str = "NULL", detail: str = "NULL", owner: str | None = None) -> str:
    owned = owner or ("'manifest'" if chapter == "NULL" else f"'chapter:' || {chapter}")
    return f"SELECT vid, '{level}' AS level, {owned} AS owner, {chapter} AS chapter, '{code}' AS code, CAST({detail} AS VARCHAR) AS detail FROM {source}"


def _union(rules: list[str]) -> str:
    return " UNION ALL ".join(f"({r})" for r in rules)


E, W = "error", "warning"
MANIFEST_SQL = _with(m=MANIFESTS, ch=CHAPTERS, sl=SLIDES, cu=CUES, fi=FILES) + r""",
cnt AS (SELECT vid, count(*) AS n_slides, max(id) AS max_slide FROM sl GROUP BY vid), good AS (SELECT * FROM ch WHERE well),
bo AS (SELECT ch.vid, ch.id, f.text FROM ch LEFT JOIN fi f ON f.vid = ch.vid AND f.path = 'chapters/' || ch.body),
tg AS (SELECT vid, id, unnest(list_distinct(list_filter(regexp_extract_all(text, """ + TARGET + r"""), lambda x: NOT regexp_matches(x, """ + KNOWN + r""")))) AS target FROM bo WHERE text IS NOT NULL),
na AS (SELECT vid, id, unnest(regexp_extract_all(text, '\]\((?:\.\./)*((?:slides|sheets|figures)/[^)\s]+)\)', 1)) AS path FROM bo WHERE text IS NOT NULL),
us AS (SELECT vid, id, unnest(slides) AS slide FROM ch),
ov AS (SELECT *, max(z) OVER (PARTITION BY vid ORDER BY a, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM good)
""" + _union([
    _issue(E, "V-01", "(SELECT DISTINCT vid FROM ch WHERE vid NOT IN (SELECT vid FROM m))"),
    _issue(E, "V-02", "m WHERE schema IS DISTINCT FROM 'chapters/1'", detail="schema"),
    _issue(E, "V-03", "m WHERE video_ok IS DISTINCT FROM true"),
    _issue(E, "V-04", "m WHERE vid NOT IN (SELECT vid FROM ch)"),
    _issue(E, "V-05", "(SELECT m.vid, slide_count FROM m LEFT JOIN cnt USING (vid) WHERE slide_count <> coalesce(n_slides, 0))", detail="slide_count"),
    _issue(E, "V-06", "(SELECT vid, id, count(*) AS n FROM ch GROUP BY vid, id HAVING count(*) > 1)", "id", "n"),
    _issue(E, "V-07", "(SELECT vid, id, unnest(list_filter([CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN n_keypoints = 0 THEN 'keypoints' END, CASE WHEN n_questions = 0 THEN 'questions' END, CASE WHEN coverage_notes = '' THEN 'coverage_notes' END], lambda x: x IS NOT NULL)) AS field FROM ch)", "id", "field"),
    _issue(E, "V-08", "ch WHERE NOT well", "id"),
    _issue(E, "V-09", "good WHERE z <= a", "id"),
    _issue(E, "V-10", "ov WHERE a < reached - 1", "id"),
    _issue(E, "V-11", r"bo WHERE text IS NULL OR trim(text) = '' OR starts_with(text, '---' || chr(10)) OR regexp_matches(text, '(?m)^<!--\s*meta')", "id"),
    _issue(E, "V-12", r"bo WHERE text IS NOT NULL AND NOT regexp_matches(text, '\]\([^)]*slides/\d+')", "id"),
    _issue(E, "V-13", "na WHERE starts_with(path, 'slides/') AND (vid, path) NOT IN (SELECT vid, path FROM fi)", "id", "path"),
    _issue(E, "V-15", "tg", "id", "target"),
    _issue(E, "V-16", "na WHERE NOT starts_with(path, 'slides/') AND (vid, path) NOT IN (SELECT vid, path FROM fi)", "id", "path"),
    _issue(E, "V-18", "ch WHERE n_keypoints < 2 OR n_questions < 1", "id"),
    _issue(E, "V-19", "(SELECT us.vid, us.id, slide FROM us JOIN m USING (vid) WHERE NOT slide BETWEEN 1 AND slide_count)", "id", "slide"),
    _issue(E, "V-20", "(SELECT vid, max(z) AS z, any_value(duration) AS duration FROM good JOIN m USING (vid) GROUP BY vid) WHERE z < duration - 5", detail="z"),
    _issue(E, "V-21", "cu WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.vid = cu.vid AND floor(t_from) BETWEEN g.a - 1 AND g.z)", detail="seq"),
    _issue(W, "V-22", "(SELECT vid, unnest(range(1, max_slide + 1)) AS s FROM cnt EXCEPT SELECT vid, slide FROM us)", detail="s"),
    _issue(E, "V-30", "ch WHERE trim(wrong) = '' OR right_ IS NULL", "id"),
    _issue(E, "V-31", "ch WHERE NOT list_contains(slides, merged) OR merged <> kept", "id"),
    _issue(W, "V-32", "ch WHERE n_keypoints < 1", "id"),
])


@query(MANIFEST_SQL)
def manifest_rules(spark, sf_dir):
    made = lambda sql: _spark(spark, sf_dir, sql)
    words = lambda n: F.array_repeat(F.lit("x"), F.col(n))
    fixes = F.array(F.struct(F.col("wrong"), F.col("right_").alias("right"), F.lit("seen").alias("evidence")))
    merges = F.array(F.struct(F.array("merged").alias("slides"), F.col("kept")))
    chapters = made(CHAPTERS).withColumns({"keypoints": words("n_keypoints"), "questions": words("n_questions"), "corrections": fixes, "stage_merges": merges}).drop("well", "a", "z", "k", "n")
    return integrity.manifest_rules(made(MANIFESTS), chapters, made(SLIDES), made(CUES), made(FILES))


# --- sections -------------------------------------------------------------------------------------------------------

SECTIONS = """SELECT vid, lpad(CAST(k % 3 AS VARCHAR(9)), 2, '0') AS chapter, CAST(k AS INT) AS ord, 't' || CAST(k AS VARCHAR(20)) AS title, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN '*TODO*' WHEN k % 6 = 2 THEN '*{{x}} 00:01*' ELSE '*set*' END AS time_line,
 k % 6 > 2 AS timed, k % 4000 AS a, k % 4000 + k % 8 * 100 - 100 AS z, CAST(k % 14 AS INT) AS shown, CAST(k % 15 AS INT) AS pictured, k % 5 = 0 AS two FROM (""" + ORDERED + ") o"
SPANS = "SELECT DISTINCT o_custkey + 3 AS vid, lpad(CAST(o_orderkey % 3 AS VARCHAR(9)), 2, '0') AS chapter, 300 AS t_start, 3500 AS t_end, _ARRAY(1, 2, 3, 5, 8, 11) AS slides FROM {orders}"
PICTURES = "SELECT vid, 'slides/' || lpad(CAST(id AS VARCHAR(9)), 4, '0') || '.jpg' AS path FROM (" + SLIDES + ") s WHERE id % 4 <> 3"
SECTION_SQL = _with(se=SECTIONS, sp=SPANS, sl=SLIDES, pi=PICTURES) + """,
pl AS (SELECT se.*, t_start, t_end, slides FROM se JOIN sp USING (vid, chapter)), ti AS (SELECT * FROM pl WHERE timed),
im AS (SELECT *, unnest(CASE WHEN two THEN [pictured, shown] ELSE [pictured] END) AS page FROM pl),
ov AS (SELECT *, max(z) OVER (PARTITION BY vid, chapter ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM ti)
""" + _union([
    _issue(E, "V-26-missing", "se WHERE time_line IS NULL", "chapter", "title"),
    _issue(E, "V-26-unexpanded", "se WHERE contains(time_line, '{{') OR contains(time_line, 'TODO')", "chapter", "title"),
    _issue(E, "V-26-format", "se WHERE time_line IS NOT NULL AND NOT timed", "chapter", "title"),
    _issue(E, "V-27-inverted", "ti WHERE z <= a", "chapter", "title"),
    _issue(E, "V-27-outside", "ti WHERE a < t_start - 1 OR z > t_end + 1", "chapter", "title"),
    _issue(E, "V-27-overlap", "ov WHERE a < reached", "chapter", "title"),
    _issue(E, "V-28-unknown", "pl WHERE (vid, shown) NOT IN (SELECT vid, id FROM sl)", "chapter", "shown"),
    _issue(E, "V-28-foreign", "pl WHERE NOT list_contains(slides, shown)", "chapter", "shown"),
    _issue(E, "V-28-picture", "im WHERE (vid, 'slides/' || lpad(page::VARCHAR, 4, '0') || '.jpg') NOT IN (SELECT vid, path FROM pi)", "chapter", "page"),
    _issue(E, "V-28-picture-foreign", "im WHERE NOT list_contains(slides, page)", "chapter", "page"),
    _issue(E, "V-29", "pl WHERE two AND time_line IS NULL", "chapter", "title"),
])


@query(SECTION_SQL)
def section_rules(spark, sf_dir):
    made = lambda sql: _spark(spark, sf_dir, sql)
    image = lambda c: F.struct(F.lit(1).alias("line"), F.col(c).alias("page"))
    images = F.when(F.col("two"), F.array(image("pictured"), image("shown"))).otherwise(F.array(image("pictured")))
    time = F.when(F.col("timed"), F.struct(F.col("a").cast("long").alias("a"), F.col("z").cast("long").alias("b")))
    made_sections = made(SECTIONS.replace("{{x}}", "_OPEN x}}")).withColumn("time_line", F.replace("time_line", F.lit("_OPEN "), F.lit("{{")))
    sections = made_sections.withColumns({"raw_time": time, "raw_slides": F.array("shown"), "images": images}).drop("a", "z", "timed", "shown", "pictured", "two")
    return integrity.section_rules(sections, made(SPANS), made(SLIDES), made(PICTURES))


# --- streams --------------------------------------------------------------------------------------------------------

PARAGRAPHS = "SELECT conv_id AS vid, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS INT) AS id, CAST(turn * 40 - length(text) % 4 * 20 AS INT) AS t_start, CAST(turn * 40 + 30 + length(text) % 5 * 10 AS INT) AS t_end, CAST(turn * 2 + 1 AS INT) AS seg_from, CAST(turn * 2 + 2 - CASE WHEN length(text) % 7 = 6 THEN 1 ELSE 0 END AS INT) AS seg_to, CAST(length(text) AS INT) AS chars, text FROM {conversations}"
ANCHORS = "SELECT conv_id AS vid, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS INT) AS ord, CAST(turn * 40 - length(text) % 4 * 20 + CASE WHEN length(text) % 9 = 0 THEN 1 WHEN length(text) % 9 = 1 THEN 40 ELSE 0 END AS INT) AS t FROM {conversations} WHERE role <> 'user' OR length(text) % 2 = 0"
CAPTIONS = "SELECT conv_id AS vid, 0.5 + max(turn) / 10.0 AS coverage, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 3 = 0 END AS partial FROM {conversations} GROUP BY conv_id"
STREAM_REFS = "SELECT conv_id AS vid, 'figures/fig_' || CAST(length(text) % 9 AS VARCHAR(9)) || '.png' AS path FROM {conversations}"
STREAM_SQL = _with(pa=PARAGRAPHS, an=ANCHORS, ca=CAPTIONS, re=STREAM_REFS) + r""",
vi AS (SELECT vid, max(t_end) * CASE WHEN vid % 4 = 0 THEN 0.9 ELSE 1 END AS duration FROM pa GROUP BY vid), bd AS (SELECT vid, string_agg(text, '') FILTER (id % 4 <> 1) AS text FROM pa GROUP BY vid),
st AS (SELECT vid, t_start AS t, min(id) AS para FROM pa GROUP BY ALL), pl AS (SELECT an.*, para FROM an LEFT JOIN st USING (vid, t)),
sa AS (SELECT vid, sum(chars) AS said, max(t_end) AS t_end, count(*) AS paras FROM pa GROUP BY vid),
fi AS (SELECT vid, min(para) AS f FROM pl GROUP BY vid), tl AS (SELECT sa.*, n FROM sa LEFT JOIN (SELECT vid, count(*) AS n FROM an GROUP BY vid) USING (vid)),
nc AS (SELECT *, coalesce(lag(seg_to) OVER (PARTITION BY vid ORDER BY id), 0) + 1 AS e FROM pa), ov AS (SELECT *, max(t_end) OVER (PARTITION BY vid ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM pa),
mo AS (SELECT *, lag(t) OVER (PARTITION BY vid ORDER BY ord) AS before FROM an)
""" + _union([_issue(level, code, source, detail=detail, owner="'stream'") for level, code, source, detail in [
    (E, "V-33", "nc WHERE seg_from <> e", "id"), (E, "V-34", "ov WHERE t_start < reached", "id"), (E, "V-34", "pa WHERE t_end <= t_start", "id"), (E, "V-35", "pl WHERE para IS NULL", "t"), (E, "V-36", "mo WHERE t <= before", "ord"),
    (E, "V-37-uncovered", "(SELECT pa.vid, pa.id AS para FROM pa JOIN st ON st.vid = pa.vid AND st.para = pa.id LEFT JOIN fi ON fi.vid = pa.vid WHERE f IS NULL OR pa.id < f UNION ALL SELECT pa.vid, pa.id FROM pa LEFT JOIN fi USING (vid) WHERE (vid, id) NOT IN (SELECT vid, para FROM st) AND (f IS NULL OR id < f))", "para"),
    (E, "V-37-duplicate", "(SELECT vid, para FROM pl WHERE para IS NOT NULL GROUP BY ALL HAVING count(*) > 1)", "para"),
    (W, "V-38", r"(SELECT bd.vid FROM bd JOIN sa USING (vid) WHERE length(regexp_replace(text, '\s+', '', 'g')) < 0.7 * said)", "NULL"), (W, "V-39", "(SELECT sa.vid FROM sa JOIN vi USING (vid) WHERE t_end > 1.05 * duration)", "NULL"),
    (W, "V-40", "ca WHERE coalesce(partial, false) OR coverage < 0.8", "NULL"), (W, "V-41", "tl WHERE coalesce(n, 0) < paras / 2", "NULL"),
    (E, "V-43", "(SELECT DISTINCT vid, path FROM re WHERE path NOT IN ('figures/fig_1.png', 'figures/fig_2.png', 'figures/fig_3.png', 'figures/fig_4.png', 'figures/fig_5.png') OR vid % 3 = 0)", "path"),
    (W, "V-43-quota", "(SELECT vid, count(DISTINCT path) AS n FROM re GROUP BY vid HAVING count(DISTINCT path) > 4)", "n"),
]])


@query(STREAM_SQL)
def stream_rules(spark, sf_dir):
    made = lambda sql: _spark(spark, sf_dir, sql)
    paragraphs, refs = made(PARAGRAPHS), made(STREAM_REFS)
    videos = paragraphs.groupBy("vid").agg((F.max("t_end") * F.when(F.col("vid") % 4 == 0, 0.9).otherwise(1.0)).alias("duration"))
    bodies = paragraphs.where("id % 4 <> 1").groupBy("vid").agg(F.array_join(F.collect_list("text"), "").alias("text"))
    registry = refs.where("vid % 3 <> 0").select("vid").distinct().select("vid", F.explode(F.array(*[F.lit(f"figures/fig_{k}.png") for k in range(1, 6)])).alias("path"))
    return integrity.stream_rules(videos, paragraphs, made(ANCHORS), made(CAPTIONS), bodies, refs, registry)


# --- samples, tiles, notes, resolution, digests -----------------------------------------------------------------------

SAMPLES = "SELECT c_custkey AS vid, 100.0 AS planned, 100.0 + c_custkey % 5 * 0.2 AS measured FROM {customer}"
WINDOWS = "SELECT o_custkey AS vid, o_orderkey AS window_, o_orderkey * 10.0 AS orig_from FROM {orders}"
FRAMES = "SELECT o_custkey AS vid, l_orderkey AS window_, l_orderkey * 10.0 + (l_linenumber + l_orderkey % 3 - 1) * 0.6 AS t FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_linenumber > l_orderkey % 4"
SAMPLE_SQL = _with(sa=SAMPLES, wi=WINDOWS, fr=FRAMES) + """, f AS (SELECT wi.*, first, n FROM wi LEFT JOIN (SELECT vid, window_, min(t) AS first, count(*) AS n FROM fr GROUP BY ALL) USING (vid, window_))
""" + _union([
    _issue("abort", "V-49-duration", "sa WHERE abs(planned - measured) > 0.5", owner="'pipeline'"),
    _issue("abort", "V-49-empty", "f WHERE n IS NULL", detail="window_", owner="'pipeline'"),
    _issue("abort", "V-49-first", "f WHERE abs(first - orig_from) > 1", detail="window_", owner="'pipeline'"),
])


@query(SAMPLE_SQL)
def sample_rules(spark, sf_dir):
    made = lambda sql: _spark(spark, sf_dir, sql).withColumnRenamed("window_", "window")
    return integrity.sample_rules(made(SAMPLES), made(WINDOWS), made(FRAMES))


TILES = """SELECT vid, CAST(n + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS INT) AS index_, CAST(floor((n - 1) / 12) + 1 + CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END AS INT) AS sheet, CAST(floor((n - 1) % 12 / 3) + 1 + CASE WHEN k % 23 = 0 THEN 4 ELSE 0 END AS INT) AS tile_row, CAST((n - 1) % 3 + 1 + CASE WHEN k % 29 = 0 THEN 3 ELSE 0 END AS INT) AS tile_col,
 n * 2.0 - CASE WHEN k % 31 = 0 THEN 5 ELSE 0 END AS t, 'f' || CAST(k AS VARCHAR(20)) AS frame, CASE WHEN k % 11 = 0 THEN 'other' ELSE 'sha' END AS sha256, CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(k % 2 AS INT) END AS window_ FROM (""" + ORDERED + ") o"
TILE_FRAMES = "SELECT vid, 'f' || CAST(k AS VARCHAR(20)) AS frame, n * 2.0 AS t, 'sha' AS sha256, CAST(k % 2 AS INT) AS window_ FROM (" + ORDERED + ") o WHERE k % 37 <> 0"
SHEETS = "SELECT DISTINCT o_custkey + 3 AS vid, CAST(o_orderkey % 3 + 1 AS INT) AS sheet FROM {orders}"
TILE_SQL = _with(ti=TILES, fr=TILE_FRAMES, sh=SHEETS) + """,
fo AS (SELECT ti.*, fr.t AS ft, fr.sha256 AS fsha, fr.window_ AS fw FROM ti LEFT JOIN fr USING (vid, frame)), gp AS (SELECT *, coalesce(lag(index_) OVER (PARTITION BY vid ORDER BY index_), 0) + 1 AS e, lag(t) OVER (PARTITION BY vid ORDER BY index_, frame) AS before FROM ti)
""" + _union([_issue("abort", f"V-50-{code}", source, detail=detail, owner="'pipeline'") for code, source, detail in [
    ("twice", "(SELECT vid, index_ FROM ti GROUP BY ALL HAVING count(*) > 1)", "index_"), ("gap", "gp WHERE index_ <> e", "index_"), ("place", "ti WHERE (sheet - 1) * 12 + (tile_row - 1) * 3 + tile_col <> index_", "index_"),
    ("row", "ti WHERE NOT tile_row BETWEEN 1 AND 4", "index_"), ("col", "ti WHERE NOT tile_col BETWEEN 1 AND 3", "index_"), ("sheet", "ti WHERE (vid, sheet) NOT IN (SELECT vid, sheet FROM sh)", "index_"),
    ("empty", "sh WHERE (vid, sheet) NOT IN (SELECT vid, sheet FROM ti)", "sheet"), ("frame", "fo WHERE ft IS NULL", "index_"), ("time", "fo WHERE abs(t - ft) > 0.001", "index_"), ("hash", "fo WHERE sha256 <> fsha", "index_"),
    ("window", "fo WHERE window_ IS DISTINCT FROM fw AND ft IS NOT NULL", "index_"),
]])


@query(TILE_SQL)
def tile_rules(spark, sf_dir):
    """All but the order of times, which has no one answer where an index occurs twice."""
    made = lambda sql: _spark(spark, sf_dir, sql).withColumnsRenamed({"window_": "window", "index_": "index"})
    return integrity.tile_rules(made(TILES), made(TILE_FRAMES), made(SHEETS)).where("code <> 'V-50-order'")


NOTES = "SELECT conv_id AS vid, max(text) AS text, CAST(sum(length(text)) AS INT) AS lecture_chars FROM {conversations} GROUP BY conv_id"
NODES = "SELECT conv_id AS vid, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS INT) AS ord, lpad(CAST(CAST(turn * 3 - floor(length(text) % 8 / 2) AS INT) + 5 AS VARCHAR(9)), 2, '0') || ':30' AS time_, CASE WHEN length(text) % 3 = 0 THEN 'why' ELSE 'what' END AS one, CASE WHEN length(text) % 5 = 0 THEN 'odd' ELSE 'how' END AS two FROM {conversations}"
HEADS = "SELECT DISTINCT conv_id AS vid, CASE WHEN length(text) % 2 = 0 THEN 'Start' WHEN length(text) % 3 = 0 THEN 'End' ELSE 'Other' END AS title FROM {conversations}"
NOTE_SQL = _with(no=NOTES, nd=NODES, he=HEADS) + r""",
ta AS (SELECT no.vid, coalesce(n, 0) AS n FROM no LEFT JOIN (SELECT vid, count(*) AS n FROM nd GROUP BY vid) USING (vid)), mo AS (SELECT vid, ord, time_, lag(time_) OVER (PARTITION BY vid ORDER BY ord) AS before FROM nd),
sz AS (SELECT vid, lecture_chars, length(regexp_replace(text, '\s+', '', 'g')) AS size FROM no)
""" + _union([_issue(level, code, source, detail=detail, owner="'note'") for level, code, source, detail in [
    (E, "V-44-head", "no WHERE vid NOT IN (SELECT vid FROM he WHERE title = 'Start')", "NULL"), (W, "V-44-tail", "no WHERE vid NOT IN (SELECT vid FROM he WHERE title = 'End')", "NULL"), (E, "V-45-few", "ta WHERE n < 4", "n"), (W, "V-45-many", "ta WHERE n > 6", "n"),
    (E, "V-46-order", "mo WHERE time_ <= before", "ord"), (E, "V-46-required", "nd WHERE one <> 'what'", "ord"), (E, "V-46-unknown", "nd WHERE two = 'odd'", "'odd'"), (W, "V-47-long", "sz WHERE lecture_chars > 0 AND size > 0.2 * lecture_chars", "NULL"), (W, "V-47-short", "sz WHERE size < 400", "NULL"),
]])


@query(NOTE_SQL)
def note_rules(spark, sf_dir):
    made = lambda sql: _spark(spark, sf_dir, sql)
    said = F.array(F.lit("said"))
    nodes = made(NODES).select("vid", "ord", F.col("time_").alias("time"), F.create_map(F.col("one"), said, F.col("two"), said).alias("fields"))
    return integrity.note_rules(nodes, made(NOTES), made(HEADS), labels=["what", "why", "how"], required="what", head="Start", tail="End", least=4, most=6)


RESOLVED = "SELECT o_custkey AS vid, CAST(o_orderkey % 5 AS VARCHAR(9)) AS id, 'slides/' || CAST(o_orderkey % 6 AS VARCHAR(9)) || '.jpg' AS target, CASE WHEN o_orderkey % 4 = 0 THEN 'missing' WHEN o_orderkey % 4 = 1 THEN 'rewritten' ELSE 'ok' END AS status FROM {orders}"
ANNOTATED = "SELECT DISTINCT o_custkey AS vid, CAST(o_orderkey % 5 AS VARCHAR(9)) AS id, CAST(o_custkey % 3 AS INT) AS annotations FROM {orders} WHERE o_orderkey % 5 <> 4"
FLAGGED = "SELECT o_custkey AS vid, CAST(o_orderkey % 5 AS VARCHAR(9)) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'context' ELSE 'screen' END AS basis, CAST(o_orderkey % 3 AS INT) AS doubts FROM {orders}"
CHOSEN = "SELECT o_custkey AS vid, o_orderkey AS segment, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 < 4 THEN 'full_page' ELSE 'presenter' END AS chosen, CASE WHEN o_orderkey % 3 = 0 THEN _ARRAY('presenter', 'insert') WHEN o_orderkey % 3 = 1 THEN _ARRAY('insert', 'zoom_detail') ELSE _ARRAY('full_page') END AS candidates FROM {orders}"
RESOLUTION_SQL = _with(re=RESOLVED, an=ANNOTATED, fl=FLAGGED, ro=CHOSEN) + """, nd AS (SELECT fl.vid, fl.id, (basis = 'context')::INT + doubts AS needed, coalesce(annotations, 0) AS n FROM fl LEFT JOIN an USING (vid, id)),
ol AS (SELECT *, list_has_any(candidates, ['full_page', 'zoom_detail']) AS has, chosen NOT IN ('full_page', 'zoom_detail') AS other FROM ro)
""" + _union([
    _issue(E, "V-14", "(SELECT DISTINCT vid, id, target FROM re WHERE status = 'missing')", "id", "target"),
    _issue(E, "V-17", "nd WHERE n < needed", "id"),
    _issue(W, "V-24", "(SELECT c_custkey AS vid FROM customer WHERE c_custkey NOT IN (SELECT vid FROM ro))", owner="'pipeline'"),
    _issue(E, "V-25", "ol WHERE other AND has", detail="segment", owner="'pipeline'"),
    _issue(W, "V-25", "ol WHERE chosen IS NULL OR (other AND NOT has)", detail="segment", owner="'pipeline'"),
])


@query(RESOLUTION_SQL)
def resolution_rules(spark, sf_dir):
    made = lambda sql: _spark(spark, sf_dir, sql)
    flagged = made(FLAGGED).withColumns({"corrections": F.array(F.struct("basis")), "uncertainties": F.array_repeat(F.lit("?"), F.col("doubts"))})
    chosen = made(CHOSEN)
    videos = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vid"))
    return integrity.resolution_rules(made(RESOLVED), made(ANNOTATED), flagged, chosen, chosen.select("vid").distinct(), videos)


TOPS = "SELECT c_custkey AS vid, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'old' ELSE 'now' END AS digest FROM {customer}"
STAMPS = "SELECT o_custkey AS vid, o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN 'old' ELSE 'now' END AS digest FROM {orders}"
PAGES_WERE = "SELECT DISTINCT o_custkey AS vid, CAST(o_orderkey % 9 AS INT) AS page, 'd' || CAST(o_custkey % 4 AS VARCHAR(9)) AS digest FROM {orders}"
PAGES_ARE = "SELECT DISTINCT o_custkey AS vid, CAST(o_orderkey % 9 + o_custkey % 2 AS INT) AS page, CASE WHEN o_custkey % 7 = 0 THEN 'e' ELSE 'd' || CAST(o_custkey % 4 AS VARCHAR(9)) END AS digest FROM {orders}"
SET_SQL = _with(tp=TOPS, st=STAMPS, pw=PAGES_WERE, pa=PAGES_ARE) + """, dr AS (SELECT pw.vid, pw.page, CASE WHEN pa.vid IS NULL THEN 'missing' WHEN pa.digest <> pw.digest THEN 'differs' END AS state FROM pw LEFT JOIN pa ON pa.vid = pw.vid AND pa.page = pw.page)
""" + _union([
    _issue(E, "V-23-set", "tp WHERE digest <> 'now'"), _issue(E, "V-23-chapter", "st WHERE digest <> 'now'", "id::VARCHAR"), _issue(W, "V-23-unstamped", "st WHERE digest IS NULL", "id::VARCHAR"), _issue(E, "V-23-page", "dr WHERE state IS NOT NULL", detail="page || ':' || state"),
])


@query(SET_SQL)
def slideset_rules(spark, sf_dir):
    made = lambda sql: _spark(spark, sf_dir, sql)
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vid"), F.lit("now").alias("digest"))
    return integrity.slideset_rules(made(TOPS), made(STAMPS), made(PAGES_WERE), current, made(PAGES_ARE))


FINDINGS = "SELECT o_orderkey AS vid, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 2 = 0 THEN ' l' ELSE 'L' END || CAST(o_orderkey % 8 AS VARCHAR(9)) END AS scope, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE 'what' END AS what, CASE WHEN o_orderkey % 3 = 0 THEN 'pipeline' END AS owner FROM {orders}"
FINDING_SQL = _with(fi=FINDINGS) + """, ch AS (SELECT vid, upper(trim(scope)) AS s, trim(what) AS w, coalesce(owner, CASE upper(trim(scope)) WHEN 'L1' THEN 'writer' WHEN 'L2' THEN 'writer' WHEN 'L5' THEN 'editor' END) AS o FROM fi),
re AS (SELECT vid, o, CASE WHEN s IS NULL OR NOT regexp_matches(s, '^L[1-6]$') THEN 'scope' WHEN w = '' THEN 'what' WHEN o IS NULL THEN 'owner' END AS reason FROM ch)
SELECT vid, 'reject' AS level, o AS owner, NULL::VARCHAR AS chapter, 'V-48' AS code, reason AS detail FROM re WHERE reason IS NOT NULL"""


@query(FINDING_SQL)
def finding_rules(spark, sf_dir):
    found = integrity.finding_rules(_spark(spark, sf_dir, FINDINGS), {"L1": "writer", "L2": "writer", "L5": "editor"})
    return found.withColumn("owner", F.when(F.col("owner") != "manifest", F.col("owner")))
