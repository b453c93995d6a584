"""Registered queries of whole compositions (``plans.pipelines``) and of what they rest on, on conversations.

A conversation stands for a recording, a turn for a cue, frame, chapter or node. As in ``rule_queries``, an artifact is one SELECT that both
engines read, and the SQL twin works the result out anew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..operators import markup, state, vision
from . import pipelines
from .driver_queries import query
from .rule_queries import _spark, _with

CUES = "SELECT conv_id AS vid, CAST(turn AS INT) AS seq, turn * 5.0 AS t_from, turn * 5.0 + length(text) % 5 AS t_to, text FROM {conversations}"


@query(_with(c=CUES).replace("WITH ", "WITH RECURSIVE ") + r""",
o AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY seq) AS k FROM c),
r AS (SELECT vid, k, seq, text, t_from AS first, floor(t_to) AS last, floor(t_to) AS z, 1 AS p FROM o WHERE k = 1
 UNION ALL SELECT o.vid, o.k, o.seq, o.text, CASE WHEN o.t_from - last < 1.2 AND floor(o.t_to) - first <= 120 THEN first ELSE o.t_from END, floor(o.t_to), floor(o.t_to), CASE WHEN o.t_from - last < 1.2 AND floor(o.t_to) - first <= 120 THEN p ELSE p + 1 END
 FROM r JOIN o ON o.vid = r.vid AND o.k = r.k + 1),
m AS (SELECT vid, p, min(first) AS a, max(z) AS z, string_agg(text, '' ORDER BY k) AS text FROM r GROUP BY ALL),
q AS (SELECT *, sum(CASE WHEN p = 1 OR length(regexp_replace(text, '\s+', '', 'g')) >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY vid ORDER BY p) AS id FROM m),
pa AS (SELECT vid, id, min(a) AS a, max(z) AS z, length(regexp_replace(string_agg(text, '' ORDER BY p), '\s+', '', 'g')) AS chars FROM q GROUP BY ALL),
h AS (SELECT vid, id, a, z, chars, 1 AS no, chars AS filled FROM pa WHERE id = 1
 UNION ALL SELECT pa.vid, pa.id, pa.a, pa.z, pa.chars, CASE WHEN filled + pa.chars > 1500 AND filled >= 750 THEN no + 1 ELSE no END, CASE WHEN filled + pa.chars > 1500 AND filled >= 750 THEN pa.chars ELSE filled + pa.chars END
 FROM h JOIN pa ON pa.vid = h.vid AND pa.id = h.id + 1)
SELECT vid, no, min(id)::INT AS para_from, max(id)::INT AS para_to, min(a)::INT AS t_start, max(z)::INT AS t_end, sum(chars)::BIGINT AS chars FROM h GROUP BY ALL""")
def stream_chunks(spark, sf_dir):
    """Captions to paragraphs to chunks."""
    return pipelines.stream(_spark(spark, sf_dir, CUES).withColumns({c: F.col(c).cast("double") for c in ("t_from", "t_to")}), cap=1500)[2]


#: Measurement logs: for each turn a frame with two values, marks where stretches of stillness and silence begin and end.
LOGS = """SELECT conv_id AS vid, CAST(turn * 8 AS INT) AS line_no, 'frame:' || CAST(turn AS VARCHAR(9)) || ' pts:1 pts_time:' || CAST(turn * 2 AS VARCHAR(9)) AS line FROM {conversations}
UNION ALL SELECT conv_id, CAST(turn * 8 + 1 AS INT), 'lavfi.scd.mafd=' || CAST(length(text) % 50 AS VARCHAR(9)) || '.5' FROM {conversations}
UNION ALL SELECT conv_id, CAST(turn * 8 + 2 AS INT), 'lavfi.scd.score=' || CAST(length(text) % 20 AS VARCHAR(9)) FROM {conversations}
UNION ALL SELECT conv_id, CAST(turn * 8 + 3 AS INT), 'freeze_' || CASE WHEN length(text) % 3 = 0 THEN 'start' ELSE 'end' END || ': ' || CAST(turn * 2 AS VARCHAR(9)) FROM {conversations} WHERE length(text) % 3 <> 2
UNION ALL SELECT conv_id, CAST(turn * 8 + 4 AS INT), 'x silence_' || CASE WHEN length(text) % 5 < 2 THEN 'start' ELSE 'end' END || '=' || CAST(turn * 2 + 1 AS VARCHAR(9)) || '.5' FROM {conversations} WHERE length(text) % 5 <> 4"""
LENGTHS = "SELECT conv_id AS vid, CAST(max(turn) * 2 + 3 AS DOUBLE) AS duration FROM {conversations} GROUP BY conv_id"


@query(_with(d=LENGTHS) + """, t AS (SELECT conv_id AS vid, turn, length(text) AS n FROM conversations),
f AS (SELECT vid, turn * 2 AS a, n % 3 = 0 AS opens, lead(turn * 2) OVER (PARTITION BY vid ORDER BY turn) AS b FROM t WHERE n % 3 <> 2),
s AS (SELECT vid, turn * 2 + 1.5 AS a, n % 5 < 2 AS opens, lead(turn * 2 + 1.5) OVER (PARTITION BY vid ORDER BY turn) AS b FROM t WHERE n % 5 <> 4),
fs AS (SELECT vid, sum(coalesce(b, duration) - a) AS x FROM f JOIN d USING (vid) WHERE opens GROUP BY vid), ss AS (SELECT vid, sum(coalesce(b, duration) - a) AS x FROM s JOIN d USING (vid) WHERE opens GROUP BY vid)
SELECT vid, count(*) FILTER (n % 20 >= 8) AS n_cuts, round(coalesce(any_value(fs.x), 0) / any_value(duration), 6) AS freeze_ratio, round(coalesce(any_value(ss.x), 0) / any_value(duration), 6) AS silence_ratio, round(sum(n % 50 + 0.5) / (any_value(duration) + 1), 6) AS motion_mean
FROM t JOIN d USING (vid) LEFT JOIN fs USING (vid) LEFT JOIN ss USING (vid) GROUP BY vid""")
def measured_logs(spark, sf_dir):
    """Measurement logs to ratios of cuts, stillness, silence and motion."""
    ratios = pipelines.measure(_spark(spark, sf_dir, LOGS), _spark(spark, sf_dir, LENGTHS))[2]
    return ratios.select("vid", "n_cuts", *[F.round(c, 6).alias(c) for c in ("freeze_ratio", "silence_ratio", "motion_mean")])


META = "SELECT conv_id AS vid, min(CASE WHEN turn = 0 THEN text END) AS title, _ARRAY(max(CASE WHEN turn = 1 THEN text END)) AS tags, CAST(count(*) * 60 AS DOUBLE) AS duration FROM {conversations} GROUP BY conv_id"
RATIOS = "SELECT conv_id AS vid, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE count(*) * (conv_id % 5) END AS n_cuts, conv_id % 10 / 10.0 AS freeze_ratio, conv_id % 8 / 100.0 AS motion_mean FROM {conversations} GROUP BY conv_id"


@query(_with(m=META, r=RATIOS) + """, w AS (SELECT *, (contains(coalesce(title, ''), ' la ') OR contains(coalesce(tags[1], ''), ' la ') OR contains(coalesce(title, ''), ' en ') OR contains(coalesce(tags[1], ''), ' en ')) AS sl, (contains(coalesce(title, ''), ' die ') OR contains(coalesce(tags[1], ''), ' die ')) AS st, n_cuts / (duration / 60) AS cpm FROM m LEFT JOIN r USING (vid)),
p AS (SELECT *, sl::INT + coalesce(cpm >= 3, false)::INT + (freeze_ratio >= 0.6)::INT AS a, st::INT + coalesce(cpm <= 0.5, false)::INT + (motion_mean >= 0.05)::INT AS b FROM w)
SELECT vid, a AS slides, b AS stream, CASE WHEN a - b >= 2 THEN 'slides' ELSE 'stream' END AS suggest, least(round(least(0.9, 0.4 + 0.15 * abs(a - b)), 2), CASE WHEN n_cuts IS NULL THEN 0.5 ELSE 1 END)::DOUBLE AS confidence FROM p""")
def triaged_entities(spark, sf_dir):
    ratios = _spark(spark, sf_dir, RATIOS).withColumns({c: F.col(c).cast("double") for c in ("freeze_ratio", "motion_mean")})
    out = pipelines.triaged(_spark(spark, sf_dir, META), ratios, lists=["tags"], slides=[" la ", " en "], stream=[" die "])
    return out.select("vid", "slides", "stream", "suggest", "confidence")


@query("""WITH d AS (SELECT conv_id AS vid, (sum(length(text)) % 200)::DOUBLE AS d FROM conversations GROUP BY conv_id HAVING sum(length(text)) % 200 > 0),
a AS (SELECT vid, d, CASE WHEN d <= 30 THEN 0 ELSE least(greatest(0.1 * d - 15, 0), d - 30) END AS x FROM d),
b AS (SELECT *, least(greatest(0.5 * d - 15, x + 30), d - 30) AS y FROM a), c AS (SELECT *, CASE WHEN y >= x + 30 THEN y + 30 ELSE x + 30 END AS e FROM b), e AS (SELECT *, least(greatest(0.9 * d - 15, e), d - 30) AS z FROM c),
w AS (SELECT vid, d, x AS s FROM e UNION ALL SELECT vid, d, y FROM e WHERE d > 30 AND y >= x + 30 UNION ALL SELECT vid, d, z FROM e WHERE d > 30 AND z >= e.e)
SELECT vid, row_number() OVER v AS window_no, round(s, 6) AS orig_from, round(s + least(30, d), 6) AS orig_to, round(sum(least(30, d)) OVER v - least(30, d), 6) AS media_from, round(sum(least(30, d)) OVER v, 6) AS media_to FROM w WINDOW v AS (PARTITION BY vid ORDER BY s)""")
def sampled_windows(spark, sf_dir):
    lengths = _spark(spark, sf_dir, "SELECT conv_id AS vid, CAST(sum(length(text)) % 200 AS DOUBLE) AS duration FROM {conversations} GROUP BY conv_id")
    out = pipelines.sampled(lengths)
    return out.select("vid", F.row_number().over(sampled_order()).alias("window_no"), *[F.round(c, 6).alias(c) for c in ("orig_from", "orig_to", "media_from", "media_to")])


def sampled_order():
    from pyspark.sql import Window

    return Window.partitionBy("vid").orderBy("orig_from")


FRAMES = "SELECT conv_id AS vid, CAST(turn AS INT) AS i, 'f' || CAST(turn AS VARCHAR(9)) AS file, CAST(turn * 4 + length(text) % 3 AS DOUBLE) AS t FROM {conversations}"
ASKED = "SELECT conv_id AS vid, CAST(turn AS INT) AS ask, CAST(length(text) % 37 AS DOUBLE) AS t FROM {conversations}"


@query(_with(f=FRAMES, a=ASKED) + """, n AS (SELECT *, lag(i) OVER w AS prev_i, lead(i) OVER w AS next_i FROM f WINDOW w AS (PARTITION BY vid ORDER BY t, i))
SELECT vid, ask, arg_min(i, (abs(n.t - a.t), n.t, i)) AS i, arg_min(file, (abs(n.t - a.t), n.t, i)) AS file, arg_min(coalesce(prev_i, -1), (abs(n.t - a.t), n.t, i)) AS prev_i, arg_min(coalesce(next_i, -1), (abs(n.t - a.t), n.t, i)) AS next_i, min(abs(n.t - a.t)) AS distance
FROM a JOIN n USING (vid) GROUP BY vid, ask""")
def frames_at_times(spark, sf_dir):
    """For each asked time the nearest frame, with the frames beside it."""
    out = pipelines.frames_at(_spark(spark, sf_dir, FRAMES), _spark(spark, sf_dir, ASKED))
    return out.select("vid", "ask", "i", "file", F.coalesce("prev_i", F.lit(-1)).alias("prev_i"), F.coalesce("next_i", F.lit(-1)).alias("next_i"), "distance")


FOUND = """SELECT conv_id AS vid, CASE WHEN length(text) % 4 = 0 THEN 'warning' ELSE 'error' END AS level, CASE WHEN length(text) % 3 = 0 THEN 'manifest' ELSE 'chapter:' || CAST(turn % 3 AS VARCHAR(9)) END AS owner,
 CASE WHEN length(text) % 3 = 0 THEN NULL ELSE CAST(turn % 3 AS VARCHAR(9)) END AS chapter, 'V-' || CAST(length(text) % 10 AS VARCHAR(9)) AS code, CASE WHEN length(text) % 7 = 0 THEN NULL ELSE CAST(length(text) AS VARCHAR(9)) END AS detail FROM {conversations}"""


@query(_with(f=FOUND) + """SELECT vid, owner, string_agg(concat_ws(' ', code, chapter, detail), '; ' ORDER BY concat_ws(' ', code, chapter, detail)) AS messages, count(*) FILTER (level = 'error') AS n_error, count(*) FILTER (level = 'warning') AS n_warning, 0 AS n_review FROM f GROUP BY ALL""")
def checked_routes(spark, sf_dir):
    """All issues routed to their owners."""
    found = _spark(spark, sf_dir, FOUND)
    return pipelines.checked([found.where("level = 'error'"), found.where("level = 'warning'")])[1]


@query(_with(f=FOUND) + """SELECT vid, owner, string_agg(concat_ws(' ', code, chapter, detail), '; ' ORDER BY concat_ws(' ', code, chapter, detail)) AS messages, count(*) FILTER (level = 'error') AS n_error, count(*) FILTER (level = 'warning') AS n_warning, 0 AS n_review FROM f WHERE chapter IN ('0', '2') GROUP BY ALL""")
def checked_chapters(spark, sf_dir):
    """The same for two chapters only."""
    return pipelines.checked([_spark(spark, sf_dir, FOUND)], only=["0", "2", "?"])[1]


OWNERS = FOUND.replace("'chapter:' || CAST(turn % 3 AS VARCHAR(9)) END AS owner", "'chapter:' || CAST(conv_id AS VARCHAR(9)) END AS owner")
ROUNDS = "SELECT 'chapter:' || CAST(conv_id AS VARCHAR(9)) AS owner, CASE WHEN length(text) % 2 = 0 THEN 'done' ELSE 'open' END AS result, CAST(turn AS INT) AS round, turn AS at FROM {conversations} WHERE conv_id % 3 = 0 AND turn < 2"
SENT = "SELECT 'chapter:' || CAST(conv_id AS VARCHAR(9)) AS owner, 'agent' || CAST(length(text) % 5 AS VARCHAR(9)) AS agent, turn AS at FROM {conversations} WHERE conv_id % 2 = 0 AND turn < 3"


@query(_with(f=OWNERS, r=ROUNDS, s=SENT) + """, q AS (SELECT owner, count(*) AS n, min(concat_ws(' ', code, detail)) AS sample FROM f WHERE level = 'error' GROUP BY owner),
d AS (SELECT owner, arg_max(result, ("at", round)) = 'done' AS done, greatest(max(round), count(*)) + 1 AS nxt FROM r GROUP BY owner), g AS (SELECT owner, arg_max(agent, ("at", agent)) AS agent FROM s GROUP BY owner)
SELECT owner, n, sample, coalesce(done, false) AS done, coalesce(nxt, 1) AS next_round, coalesce(nxt > 2, false) AS escalate, CASE WHEN owner <> 'manifest' THEN agent END AS agent FROM q LEFT JOIN d USING (owner) LEFT JOIN g USING (owner)""")
def fix_queues(spark, sf_dir):
    """What to hand out next: owners with errors, their agents, rounds and escalation."""
    return pipelines.fix_queue(*[_spark(spark, sf_dir, s) for s in (OWNERS, ROUNDS, SENT)])


CHAPTERS = "SELECT conv_id AS vid, lpad(CAST(turn AS VARCHAR(9)), 2, '0') AS id, role AS title, ' # Head_NL' || text || '_NL###### six_NL##none ' AS body, _ARRAY(role, 'x') AS keypoints, _ARRAY(role) AS questions FROM {conversations}"
WRONG = "SELECT DISTINCT conv_id AS vid, CASE WHEN conv_id % 4 = 0 THEN 'error' ELSE 'warning' END AS level FROM {conversations} WHERE conv_id % 2 = 0"


@query(_with(c=CHAPTERS, w=WRONG) + r"""SELECT vid, string_agg('# ' || title || chr(10) || chr(10) || regexp_replace(trim(body, ' '), '(?m)^(#{1,5}\s)', '#\1', 'g') || chr(10), chr(10) ORDER BY id) AS text FROM c WHERE vid NOT IN (SELECT vid FROM w WHERE level = 'error') GROUP BY vid""")
def merged_lectures(spark, sf_dir):
    return pipelines.lecture(_spark(spark, sf_dir, CHAPTERS), _spark(spark, sf_dir, WRONG))


NODES = "SELECT conv_id AS vid, CAST(turn AS INT) AS ord, '0' || CAST(turn % 10 AS VARCHAR(9)) || ':' || lpad(CAST(length(text) % 60 AS VARCHAR(9)), 2, '0') AS time, role || ' <' || CAST(length(text) AS VARCHAR(9)) || '> & a title beyond the limit' AS title FROM {conversations}"


@query(_with(n=NODES) + """SELECT vid, string_agg('- [' || time || '] ' || title, chr(10) ORDER BY ord) AS text FROM n GROUP BY vid""")
def note_indexes(spark, sf_dir):
    return pipelines.note_index(_spark(spark, sf_dir, NODES))


@query(_with(n=NODES) + """, r AS (SELECT vid, title, split_part(time, ':', 1)::INT * 60 + split_part(time, ':', 2)::INT AS t, time FROM n),
e AS (SELECT *, CASE WHEN length(title) > 30 THEN left(title, 29) || '…' ELSE title END AS label FROM r),
l AS (SELECT vid, t, title, '<p data-seconds="' || t || '"><b>' || time || '</b> ' || replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ' </p>' AS line FROM e),
h AS (SELECT vid, string_agg(line, chr(10) ORDER BY t, title) AS text FROM l GROUP BY vid)
SELECT vid, text, strlen(text) AS bytes FROM h""")
def note_exports(spark, sf_dir):
    """Anchors of notes as HTML; the clipboard form's offsets hold exactly the fragment."""
    out = pipelines.exported(_spark(spark, sf_dir, NODES))
    at = lambda name: F.regexp_extract("clipboard", name + r":(\d+)", 1).cast("long")
    return out.select("vid", "text", (at("EndFragment") - at("StartFragment")).alias("bytes"))


VIDEOS = "SELECT DISTINCT conv_id AS vid, 'b' || CAST(conv_id % 5 AS VARCHAR(9)) AS bvid, CAST(conv_id % 3 AS INT) AS page, 't' || CAST(conv_id AS VARCHAR(9)) AS title FROM {conversations}"
HOOKS = "SELECT conv_id AS vid, lpad(CAST(length(text) % 60 AS VARCHAR(9)), 2, '0') AS time, role AS hook FROM {conversations} WHERE length(text) % 3 = 0"


@query(_with(v=VIDEOS, c=CHAPTERS, h=HOOKS) + """, k AS (SELECT vid, count(*) AS n_chapters, sum(len(keypoints))::BIGINT AS n_keypoints, sum(len(questions))::BIGINT AS n_questions, sum(length(body))::BIGINT AS chars FROM c GROUP BY vid),
l AS (SELECT vid, string_agg('[' || time || '] ' || hook, chr(10) ORDER BY time, hook) AS hooks FROM h GROUP BY vid)
SELECT vid, bvid, page, title, n_chapters, n_keypoints, n_questions, chars, hooks FROM v LEFT JOIN k USING (vid) LEFT JOIN l USING (vid)""")
def cross_references(spark, sf_dir):
    return pipelines.cross_reference(*[_spark(spark, sf_dir, s) for s in (VIDEOS, CHAPTERS, HOOKS)])


OLD_PAGES = "SELECT conv_id AS vid, CAST(turn AS INT) AS id, CAST(turn * 10 AS DOUBLE) AS t_start, CAST(turn * 10 + 10 AS DOUBLE) AS t_end FROM {conversations}"
NEW_PAGES = "SELECT conv_id AS vid, CAST(turn + 100 AS INT) AS id, CAST(turn * 10 + length(text) % 4 AS DOUBLE) AS t_start, CAST(turn * 10 + 8 AS DOUBLE) AS t_end FROM {conversations} WHERE length(text) % 5 <> 0"
REFS = "SELECT conv_id AS vid, 'n' || CAST(conv_id % 3 AS VARCHAR(9)) AS file, conv_id % 2 AS mtime, CAST(turn + CASE WHEN length(text) % 9 = 0 THEN 50 ELSE 0 END AS INT) AS ref FROM {conversations}"
STAMPS = "SELECT DISTINCT conv_id AS vid, 'n' || CAST(conv_id % 3 AS VARCHAR(9)) AS file, 1 AS mtime FROM {conversations} WHERE conv_id % 3 = 1"


@query(_with(o=OLD_PAGES, n=NEW_PAGES, r=REFS, s=STAMPS) + """, m AS (SELECT o.vid, o.id, arg_max(n.id, (least(o.t_end, n.t_end) - greatest(o.t_start, n.t_start), -n.id)) AS best FROM o JOIN n ON o.vid = n.vid AND least(o.t_end, n.t_end) > greatest(o.t_start, n.t_start) GROUP BY ALL),
l AS (SELECT o.vid, o.id, arg_min(n.id, (abs(n.t_start - o.t_start), n.t_start, n.id)) AS best FROM o JOIN n USING (vid) WHERE (o.vid, o.id) NOT IN (SELECT vid, id FROM m) GROUP BY ALL),
a AS (SELECT * FROM m UNION ALL SELECT * FROM l)
SELECT r.vid, file, mtime, coalesce(best, ref) AS ref, best IS NULL AS dangling FROM r LEFT JOIN a ON a.vid = r.vid AND a.id = r.ref WHERE (r.vid, file, mtime) NOT IN (SELECT vid, file, mtime FROM s)""")
def remapped_references(spark, sf_dir):
    """References of files without a stamp, moved to the new pages that overlap the old ones most."""
    return pipelines.remapped_pages(*[_spark(spark, sf_dir, s) for s in (OLD_PAGES, NEW_PAGES, REFS, STAMPS)]).select("vid", "file", "mtime", "ref", "dangling")


# --- references in texts -------------------------------------------------------------------------------------------------

PICTURED = """SELECT conv_id AS vid, CAST(turn AS INT) AS k, '![a](slides/' || lpad(CAST(turn AS VARCHAR(9)), 4, '0') || '.jpg) and ![b](slides/0001.jpg) ' || CASE WHEN length(text) % 3 = 0 THEN '![c](x/' || CAST(length(text) % 7 AS VARCHAR(9)) || '.gif) ![c](x/' || CAST(length(text) % 7 AS VARCHAR(9)) || '.gif) ![d](up/../y.png)'
 WHEN length(text) % 3 = 1 THEN '![e](figures/fig_' || CAST(turn AS VARCHAR(9)) || '.png)' ELSE '![f](sheets/odd.png) slides/0001.jpg' END AS text FROM {conversations}"""
SWAPS = "SELECT DISTINCT conv_id AS vid, old, new FROM {conversations} CROSS JOIN (SELECT 'slides/0001.jpg' AS old, 'slides/0002.jpg' AS new UNION ALL SELECT 'slides/0002.jpg', 'slides/0001.jpg' UNION ALL SELECT 'slides/0000.jpg', 'figures/fig_9.png') s WHERE conv_id % 4 <> 0"


@query(_with(p=PICTURED) + """SELECT vid, k, CASE WHEN vid % 4 = 0 THEN text ELSE replace(replace(replace(replace(text, '](slides/0001.jpg)', '](#1)'), '](slides/0002.jpg)', '](slides/0001.jpg)'), '](slides/0000.jpg)', '](figures/fig_9.png)'), '](#1)', '](slides/0002.jpg)') END AS text FROM p""")
def rewritten_targets(spark, sf_dir):
    """Picture targets replaced by a mapping that swaps two of them."""
    return markup.rewritten_references(_spark(spark, sf_dir, PICTURED), _spark(spark, sf_dir, SWAPS), key=["vid"], text="text")


@query(_with(p=PICTURED) + r"""SELECT vid, k, list_distinct(list_filter(regexp_extract_all(text, '!\[[^\]\n]*\]\(([^)\s]+)\)', 1), lambda x: NOT regexp_matches(x, '^(?:[^()\s]*/)?(?:slides/\d{1,4}\.(jpg|png)|sheets/sheet_\d+\.(jpg|png)|figures/fig_\d+\.(jpg|png))$'))) AS unknown FROM p""")
def unknown_pictures(spark, sf_dir):
    return _spark(spark, sf_dir, PICTURED).select("vid", "k", F.array_sort(texts.unknown_targets(F.col("text"))).alias("unknown"))


@query("""SELECT DISTINCT conv_id AS vid, unnest(CASE WHEN turn % 2 = 0 THEN ['sheet_' || length(text) % 4, 'panel_' || turn] ELSE ['panel_' || (turn - 1)] END) AS name FROM conversations""")
def panel_registry(spark, sf_dir):
    sheets = _spark(spark, sf_dir, "SELECT conv_id AS vid, 'sheet_' || CAST(length(text) % 4 AS VARCHAR(9)) AS name FROM {conversations} WHERE turn % 2 = 0")
    panels = _spark(spark, sf_dir, "SELECT conv_id AS vid, 'panel_' || CAST(turn - turn % 2 AS VARCHAR(9)) AS name FROM {conversations}")
    return markup.registered(sheets, panels, key=["vid"])


#: Lectures: chapters with a time in the heading, some with timed parts, some times in a line below, and headings in a fence.
LECTURE_LINE = """'# [0' || CAST(turn % 10 AS VARCHAR(9)) || ':10] ' || role || '_NLtext' || CASE WHEN length(text) % 3 = 0 THEN '_NL### part one_NL_NL*0' || CAST(turn % 10 AS VARCHAR(9)) || ':20 and on*_NL### [0' || CAST(turn % 10 AS VARCHAR(9)) || ':30] part two' WHEN length(text) % 3 = 1 THEN '_NL```_NL# [09:59] fenced_NL```_NL### untimed' ELSE '_NL# no time' END"""
LECTURES = f"SELECT conv_id AS vid, CAST(turn AS INT) AS turn, {LECTURE_LINE} AS text, length(text) % 3 AS kind, role FROM {{conversations}}"


@query(_with(l=LECTURES) + """, c AS (SELECT *, turn % 10 * 60 AS s, sum(CASE WHEN kind = 2 THEN 2 ELSE 1 END) OVER (PARTITION BY vid ORDER BY turn) - (kind = 2)::INT AS chapter FROM l)
SELECT vid, chapter::BIGINT AS chapter, s + 10 AS t, role AS title FROM c WHERE kind <> 0 UNION ALL SELECT vid, chapter::BIGINT, s + 20, 'part one' FROM c WHERE kind = 0 UNION ALL SELECT vid, chapter::BIGINT, s + 30, 'part two' FROM c WHERE kind = 0""")
def lecture_times(spark, sf_dir):
    """Timed items of merged lectures."""
    from ..operators import assemble

    whole = assemble.joined_lines(_spark(spark, sf_dir, LECTURES), key=["vid"], order=["turn"], line=F.col("text"))
    return markup.lecture_items(markup.lines_of(whole, key=["vid"], text="text"), key=["vid"])


# --- ledgers and findings --------------------------------------------------------------------------------------------------


@query(_with(r=ROUNDS) + "SELECT owner, result, round, CAST(\"at\" AS VARCHAR) AS at, NULL AS note FROM r UNION ALL SELECT 'chapter:new', 'done', 7, '9', 'by hand'")
def marked_rounds(spark, sf_dir):
    rounds = _spark(spark, sf_dir, ROUNDS).select("owner", "result", "round", F.lit(None).cast("string").alias("agent"), F.lit(None).cast("string").alias("note"), F.col("at").cast("string").alias("at"))
    return state.marked(rounds, "chapter:new", "done", number=7, agent=None, note="by hand", at="9").drop("agent")


FINDINGS = """SELECT conv_id AS vid, CAST(turn AS INT) AS k, CASE WHEN length(text) % 4 = 0 THEN ' l' || CAST(turn % 8 AS VARCHAR(9)) WHEN length(text) % 4 = 1 THEN NULL ELSE 'L2 ' END AS scope, CASE WHEN length(text) % 5 = 0 THEN ' ' ELSE role END AS what,
 CASE WHEN length(text) % 6 = 0 THEN 'chapter:01' END AS owner FROM {conversations}"""


@query(_with(f=FINDINGS) + """, c AS (SELECT vid, k, scope, what, coalesce(owner, CASE upper(trim(scope)) WHEN 'L1' THEN 'manifest' WHEN 'L2' THEN 'chapter:02' WHEN 'L3' THEN 'stream' END) AS owner FROM f)
SELECT vid, k, owner, CASE WHEN NOT coalesce(regexp_matches(upper(trim(scope)), '^L[1-6]$'), false) THEN 'scope' WHEN trim(what) = '' THEN 'what' WHEN owner IS NULL THEN 'owner' END AS reason FROM c""")
def reviewed_findings(spark, sf_dir):
    """Review findings accepted with an owner, or rejected with a reason."""
    accepted, rejected = state.ingested_findings(_spark(spark, sf_dir, FINDINGS), {"L1": "manifest", "L2": "chapter:02", "L3": "stream"})
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected).select("vid", "k", "owner", "reason")


# --- regions ---------------------------------------------------------------------------------------------------------------

CELLS = "SELECT conv_id AS vid, CAST(turn % 4 AS INT) AS row_, CAST(length(text) % 5 AS INT) AS col_ FROM {conversations}"
BLOCKED = "SELECT conv_id AS vid, _ARRAY(turn % 2 * 0.5, 0.25, turn % 2 * 0.5 + 0.375, 0.75) AS box FROM {conversations} WHERE length(text) % 3 = 0 AND turn < 4"


@query(_with(c=CELLS, b=BLOCKED) + "SELECT vid, row_, col_ FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.vid = c.vid AND (col_ + 0.5) / 5 >= box[1] AND (col_ + 0.5) / 5 < box[3] AND (row_ + 0.5) / 4 >= box[2] AND (row_ + 0.5) / 4 < box[4])")
def unblocked_cells(spark, sf_dir):
    boxes = _spark(spark, sf_dir, BLOCKED).withColumn("box", F.col("box").cast("array<double>"))
    return vision.unblocked(_spark(spark, sf_dir, CELLS), boxes, key=["vid"], rows=4, cols=5, row="row_", col="col_")


BANDS = "SELECT conv_id AS vid, CAST(turn AS INT) AS k, CAST(length(text) % 50 AS INT) AS a, CAST(length(text) % 40 + 50 AS INT) AS z, length(text) % 10 / 10.0 AS p, length(text) % 3 AS kind FROM {conversations}"


@query(_with(b=BANDS) + """SELECT vid, k, CASE kind WHEN 0 THEN least(a, 30) WHEN 1 THEN a ELSE 30 END AS first, CASE kind WHEN 0 THEN greatest(z, 60) WHEN 1 THEN z ELSE 60 END AS last, round(least(0.95, CASE WHEN kind = 0 THEN 0.6 ELSE 0.4 END + CASE kind WHEN 0 THEN greatest(p, 0.5) WHEN 1 THEN p ELSE 0.5 END / 2), 6) AS confidence FROM b""")
def caption_bands(spark, sf_dir):
    """Two candidate bands of captions in one."""
    b = _spark(spark, sf_dir, BANDS).withColumn("p", F.col("p").cast("double"))
    band = lambda first, last, peak: F.struct(first.alias("first"), last.alias("last"), peak.alias("peak"))
    fitted = F.when(F.col("kind") < 2, band(F.col("a"), F.col("z"), F.col("p")))
    legacy = F.when(F.col("kind") != 1, band(F.lit(30), F.lit(60), F.lit(0.5)))
    out = b.select("vid", "k", vision.caption_band(legacy, fitted).alias("c"))
    return out.select("vid", "k", "c.band.first", "c.band.last", F.round("c.confidence", 6).alias("confidence"))
