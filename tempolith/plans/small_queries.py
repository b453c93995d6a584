"""Registered queries of the small functions and of state, assembly and choice, on artifacts made from the driver tables.

As in ``rule_queries``, an artifact is one SELECT that both engines read, and the SQL twin works the result out anew.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers, texts, times
from ..operators import assemble, folds, integrity, markup, pick, state, temporal, terms, triage, vision
from .driver_queries import events, query, table
from .rule_queries import _spark, _with

CLOCK = "lpad(CAST(o_orderkey % 60 AS VARCHAR(9)), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR(9)), 2, '0')"
WRITTEN = f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN {CLOCK} ELSE '01:' || {CLOCK} END AS w, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 3600 END + o_orderkey % 60 * CASE WHEN o_orderkey % 3 = 0 THEN 60 ELSE 60 END + o_custkey % 60 AS s, o_totalprice / 7.0 AS x, CASE WHEN o_orderkey % 4 = 0 THEN 'whole' ELSE '*00:10:00-00:2' || CAST(o_custkey % 10 AS VARCHAR(9)) || ':00' END AS section FROM {{orders}}"


@query(_with(w=WRITTEN) + """SELECT k, s AS strict, CASE WHEN section = 'whole' THEN 0 ELSE 600 END AS section_start, CASE WHEN section = 'whole' THEN 0 ELSE 600 END + s AS on_timeline,
 printf('%02d:%02d:%02d', (round_even(x, 0)::BIGINT // 3600)::INT, (round_even(x, 0)::BIGINT // 60 % 60)::INT, (round_even(x, 0)::BIGINT % 60)::INT) AS rounded FROM w""")
def written_times(spark, sf_dir):
    w = _spark(spark, sf_dir, WRITTEN)
    return w.select("k", times.strict_seconds_of(F.col("w")).alias("strict"), times.section_offset(F.col("section")).alias("section_start"), times.to_timeline(times.section_offset(F.col("section")), F.col("w")).alias("on_timeline"), times.hms_rounded(F.col("x")).alias("rounded"))


LOOSE = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' WHEN o_orderkey % 4 = 1 THEN NULL ELSE CAST(o_orderkey % 1000 AS VARCHAR(20)) || '.' || CAST(o_custkey % 1000 + 1 AS VARCHAR(20)) || '7' END AS t FROM {orders}"


@query(_with(l=LOOSE) + "SELECT k, coalesce(round_even(try_cast(t AS DOUBLE), 3), 0) AS three, coalesce(try_cast(t AS DOUBLE), -1) AS filled, least(greatest(coalesce(try_cast(t AS DOUBLE), -1) / 500, 0), 1) AS clamped FROM l")
def loose_numbers(spark, sf_dir):
    filled = numbers.number_or(F.col("t"), -1)
    return _spark(spark, sf_dir, LOOSE).select("k", numbers.rounded3(F.col("t")).alias("three"), filled.alias("filled"), numbers.clamp(filled / 500).alias("clamped"))


BOXES = "SELECT p_partkey AS k, CAST(p_size * 10 AS INT) AS w, CAST(p_partkey % 90 + 10 AS INT) AS h, p_partkey % 8 / 8.0 AS a, p_partkey % 4 / 8.0 AS b, p_partkey % 8 / 8.0 + p_size % 3 / 8.0 AS c, p_partkey % 4 / 8.0 + p_size % 5 / 8.0 - 0.125 AS d FROM {part}"
PIXEL = "greatest(least({low}, {n} - 1), 0)"


@query(_with(b=BOXES.replace("{part}", "part")) + """, p AS (SELECT *, least(greatest(floor(a * w), 0), w - 1)::INT AS x0, least(greatest(floor(b * h), 0), h - 1)::INT AS y0 FROM b)
SELECT k, x0, y0, least(greatest(ceil(c * w), x0 + 1), w)::INT AS x1, least(greatest(ceil(d * h), y0 + 1), h)::INT AS y1, round(greatest(c - a, 0) * greatest(d - b, 0), 6) AS area,
 least(greatest(floor(0.7::DOUBLE * w), 0), w - 1)::INT AS right_zone, greatest(round_even(w * least(64.0 / w, 48.0 / h), 0), 1)::INT AS fit_w, greatest(round_even(h * least(64.0 / w, 48.0 / h), 0), 1)::INT AS fit_h,
 (least(floor(b * 100 * 3 / 60), 2) * 4 + least(floor(a * 100 * 4 / 80), 3))::BIGINT AS cell FROM p""")
def boxes(spark, sf_dir):
    b = spark.sql(BOXES, part=table(spark, sf_dir, "part"))
    box = F.array(*[F.col(x).cast("double") for x in "abcd"])
    px = numbers.box_pixels(box, F.col("w"), F.col("h"))
    fit = numbers.fit_scale(F.col("w"), F.col("h"), F.lit(64.0), F.lit(48.0))
    zone = numbers.corner_bounds(F.col("h"), F.col("w"), "tr")
    cell = numbers.grid_cell(F.col("a") * 100, F.col("b") * 100, 80, 60, 4)
    return b.select("k", *[px[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.round(numbers.box_area(box), 6).alias("area"), zone[0].alias("right_zone"), fit[0].alias("fit_w"), fit[1].alias("fit_h"), cell.cast("long").alias("cell"))


@query("""WITH b AS (SELECT p_partkey AS k, (p_partkey % 8 / 8.0)::DOUBLE AS a, (p_size % 8 / 8.0)::DOUBLE AS z FROM part)
SELECT k, left(sha1('[' || list_aggregate(list_sort(['[' || a || ',0.5]', '[' || z || ',0.25]']), 'string_agg', ',') || ']'), 8) AS boxes, left(sha1('[{"key":"a","value":' || a || '},{"key":"z","value":' || z || '}]'), 8) AS params FROM b""")
def order_free_keys(spark, sf_dir):
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 8 / 8.0).alias("a"), (F.col("p_size") % 8 / 8.0).alias("z"))
    given = F.array(F.array("z", F.lit(0.25)), F.array("a", F.lit(0.5)))
    return b.select("k", numbers.boxes_key(given).alias("boxes"), numbers.params_key(F.create_map(F.lit("z"), F.col("z"), F.lit("a"), F.col("a"))).alias("params"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '[^\pL\pN]+', '', 'g'), '_', '', 'g') AS bare, CASE WHEN length(trim(regexp_replace(regexp_replace(regexp_replace(url, 'https?://|www|example', ' ', 'g'), '\s+', ' ', 'g'), '^ ', ''))) > 0
 THEN trim(left(trim(regexp_replace(regexp_replace(url, 'https?://|www|example', ' ', 'g'), '\s+', ' ', 'g')), 24)) ELSE 'none' END AS title, levenshtein(lower(url), lower(left(url, length(url) - page_id % 3))) <= 1 AS near FROM pages""")
def url_texts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    cut = F.expr("left(url, length(url) - cast(page_id % 3 as int))")
    return p.select("page_id", texts.without_marks(F.col("url")).alias("bare"), texts.clean_title(F.col("url"), F.lit("none"), ["https?://", "www", "example"]).alias("title"), texts.within_one_edit(F.col("url"), cut).alias("near"))


REFERRED = "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'a/b' WHEN p_partkey % 3 = 1 THEN 'out' ELSE 'x/y/z' END AS folder, CASE WHEN p_size % 3 = 0 THEN '../' WHEN p_size % 3 = 1 THEN '../../' ELSE '' END || 'slides/' || CAST(p_size AS VARCHAR(9)) || '.jpg' AS target, CASE WHEN p_size % 4 = 0 THEN '| a | b' || CAST(p_size AS VARCHAR(9)) || ' |' WHEN p_size % 4 = 1 THEN '| --- | --- |' WHEN p_size % 4 = 2 THEN 'no table | x' ELSE '|only|' END AS line FROM {part}"


@query(_with(r=REFERRED.replace("{part}", "part")) + r""", n AS (SELECT *, string_split(folder, '/') AS p, (length(target) - length(ltrim(target, './'))) // 3 AS ups FROM r)
SELECT k, array_to_string(list_append(p[1 : greatest(len(p) - ups, 0)], ltrim(target, './')), '/') AS path, CASE WHEN starts_with(line, '| a') THEN 'a' END AS left_cell, CASE WHEN starts_with(line, '| a') THEN trim(split_part(line, '|', 3)) END AS right_cell FROM n""")
def reference_paths(spark, sf_dir):
    r = spark.sql(REFERRED.replace("VARCHAR(9)", "STRING"), part=table(spark, sf_dir, "part"))
    pair = texts.table_pairs(F.col("line"))
    return r.select("k", markup.reference_path(F.col("folder"), F.col("target")).alias("path"), pair["left"].alias("left_cell"), pair["right"].alias("right_cell"))


# --- scopes and small documents ---------------------------------------------------------------------------------

SCOPES = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'chapter:' || CAST(o_custkey % 9 + 1 AS VARCHAR(9)) || ', 4' WHEN o_orderkey % 4 = 1 THEN 'manifest' WHEN o_orderkey % 4 = 2 THEN NULL ELSE 'chapter:x' END AS owner, CASE WHEN o_orderkey % 5 = 0 THEN 'chapter:03,11' ELSE 'all' END AS scope, CASE WHEN o_orderkey % 3 = 0 THEN '1，2,  intro,' WHEN o_orderkey % 3 = 1 THEN ' , ' ELSE NULL END AS csv FROM {orders}"
IDS = [f"{k:02d}" for k in range(1, 13)]


@query(_with(s=SCOPES) + f""", c AS (SELECT *, list_concat(CASE WHEN k % 4 = 0 THEN [lpad((regexp_extract(owner, ':(\\d+)', 1)), 2, '0'), '04'] ELSE [] END, CASE WHEN scope <> 'all' THEN ['03', '11'] ELSE [] END) AS picked FROM s)
SELECT k, array_to_string(CASE WHEN len(picked) = 0 THEN {IDS} ELSE list_filter({IDS}, lambda x: list_contains(picked, x)) END, ',') AS ids, CASE WHEN k % 3 = 0 THEN '01,02,intro' END AS chapters FROM c""")
def chapter_scopes(spark, sf_dir):
    s = _spark(spark, sf_dir, SCOPES)
    return s.select("k", F.array_join(texts.dispatched_ids(F.array(*map(F.lit, IDS)), F.col("owner"), F.col("scope")), ",").alias("ids"), F.array_join(texts.chapter_list(F.col("csv")), ",").alias("chapters"))


CHAPTERS = "SELECT o_custkey AS vid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS id, o_orderkey AS k, o_orderpriority || ': ' || o_orderstatus AS title, o_orderkey % 7000 AS t_start, '# ' || o_orderstatus || '_NL## x' AS body FROM {orders}"


@query(_with(c=CHAPTERS) + """SELECT vid, 'timeline' || chr(10) || string_agg('    ' || replace(printf('%02d:%02d:%02d', (t_start // 3600)::INT, (t_start // 60 % 60)::INT, (t_start % 60)::INT), ':', '：') || ' : ' || replace(title, ':', '：'), chr(10) ORDER BY id) AS text FROM c GROUP BY vid""")
def timelines(spark, sf_dir):
    return assemble.timeline(_spark(spark, sf_dir, CHAPTERS), key=["vid"])


@query(_with(c=CHAPTERS) + r"""SELECT vid, string_agg('# ' || title || chr(10) || chr(10) || '#' || replace(body, chr(10) || '#', chr(10) || '##') || chr(10), chr(10) ORDER BY id) AS text FROM c WHERE vid NOT IN (SELECT vid FROM c WHERE k % 9 = 0) GROUP BY vid""")
def merged_documents(spark, sf_dir):
    c = _spark(spark, sf_dir, CHAPTERS)
    return assemble.merged_document(c, c.where("k % 9 = 0"), key=["vid"])


@query("""WITH p AS (SELECT l_orderkey AS vid, l_linenumber AS no, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'O' THEN 'short' ELSE ' text of ' || l_quantity::INT || ' pieces ' END AS t FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)),
b AS (SELECT DISTINCT vid FROM p WHERE coalesce(length(trim(t)), 0) < 8) SELECT vid, string_agg(trim(t), chr(10) || chr(10) ORDER BY no) AS text FROM p WHERE vid NOT IN (SELECT vid FROM b) GROUP BY vid""")
def assembled_texts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("vid"), F.col("l_linenumber").alias("no")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")).alias("x"))
    text = F.when(F.col("x.l_returnflag") == "R", None).when(F.col("x.l_linestatus") == "O", "short").otherwise(F.concat(F.lit(" text of "), F.col("x.l_quantity").cast("int").cast("string"), F.lit(" pieces ")))
    out = li.select("vid", "no", text.alias("text"))
    return assemble.assembled_chunks(out.select("vid", "no"), out.where("text is not null"), key=["vid"], least=8)[0]


@query("""SELECT o_custkey AS vid, o_orderkey AS no, CASE WHEN o_orderstatus = 'F' THEN 'missing' ELSE 'short' END AS why FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 30 < 20""")
def bad_chunks(spark, sf_dir):
    out = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vid"), F.col("o_orderkey").alias("no"), F.when(F.col("o_orderstatus") != "F", F.repeat(F.lit("x"), (F.col("o_orderkey") % 30).cast("int"))).alias("text"))
    return assemble.assembled_chunks(out.select("vid", "no"), out.where("text is not null"), key=["vid"], least=20)[1]


@query("SELECT o_custkey AS vid, count(*) AS n_chapters, sum(o_orderkey % 4) AS n_keypoints, sum(o_orderkey % 3) AS n_questions, sum(length(o_orderpriority)) AS chars FROM orders GROUP BY o_custkey")
def briefs(spark, sf_dir):
    words = lambda n: F.array_repeat(F.lit("x"), (F.col("o_orderkey") % n).cast("int"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vid"), words(4).alias("keypoints"), words(3).alias("questions"), F.col("o_orderpriority").alias("body"))
    return assemble.brief(o, key=["vid"])


@query("""WITH r AS (SELECT o_custkey AS vid, o_orderkey, o_orderkey % 9000 AS t, CASE WHEN length(o_orderpriority || o_orderstatus) > 9 THEN left(o_orderpriority || o_orderstatus, 8) || '…' ELSE o_orderpriority || o_orderstatus END AS label, CASE WHEN length('<' || o_orderkey) > 4 THEN left('<' || o_orderkey, 3) || '…' ELSE '<' || o_orderkey END AS d FROM orders)
SELECT vid, string_agg('<p data-seconds="' || t || '"><b>' || CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', (t // 3600)::INT, (t // 60 % 60)::INT, (t % 60)::INT) ELSE printf('%02d:%02d', (t // 60)::INT, (t % 60)::INT) END || '</b> ' || label || ' ' || replace(d, '<', '&lt;') || '</p>', chr(10) ORDER BY o_orderkey) AS text FROM r GROUP BY vid""")
def html_exports(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vid"), "o_orderkey", (F.col("o_orderkey") % 9000).alias("t"), F.concat("o_orderpriority", "o_orderstatus").alias("title"), F.concat(F.lit("<"), F.col("o_orderkey").cast("string")).alias("said"))
    rows = assemble.export_rows(o, key=["vid"], order=["o_orderkey"], title="title", desc="said", title_max=9, desc_max=4)
    return assemble.html_fragment(rows, key=["vid"], time="t")


# --- state ------------------------------------------------------------------------------------------------------

ISSUES = "SELECT o_custkey AS owner_k, CASE WHEN o_custkey % 10 = 0 THEN 'pipeline' ELSE 'c' || CAST(o_custkey AS VARCHAR(20)) END AS owner, CASE WHEN o_orderkey % 3 = 0 THEN 'error' WHEN o_orderkey % 3 = 1 THEN 'review' ELSE 'warning' END AS level, CASE WHEN o_orderkey % 2 = 0 THEN 'major' ELSE 'minor' END AS severity, lpad(CAST(o_orderkey AS VARCHAR(20)), 12, '0') AS message FROM {orders}"
ROUNDS = "SELECT CASE WHEN c_custkey % 10 = 0 THEN 'pipeline' ELSE 'c' || CAST(c_custkey AS VARCHAR(20)) END AS owner, CASE WHEN c_custkey % 4 = 0 THEN 'done' ELSE 'open' END AS result, CAST(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 3 END AS INT) AS round, lpad(CAST(c_custkey AS VARCHAR(20)), 12, '0') AS at, 'agent' || CAST(c_custkey % 5 AS VARCHAR(9)) AS agent FROM {customer}"


@query(_with(i=ISSUES, r=ROUNDS) + """, q AS (SELECT owner, count(*) AS n, min(message) AS sample FROM i WHERE level = 'error' OR (level = 'review' AND severity = 'major') GROUP BY owner),
d AS (SELECT owner, arg_max(result, ("at", round)) = 'done' AS done, arg_max(agent, ("at", agent)) AS agent, greatest(coalesce(max(round), 0), count(*)) + 1 AS nr FROM r GROUP BY owner)
SELECT q.owner, n, sample, coalesce(done, false) AS done, CASE WHEN q.owner <> 'pipeline' THEN agent END AS agent, coalesce(nr, 1) AS next_round, coalesce(nr > 2, false) AS escalate FROM q LEFT JOIN d USING (owner)""")
def work_queues(spark, sf_dir):
    rounds = _spark(spark, sf_dir, ROUNDS)
    return state.work_queue(_spark(spark, sf_dir, ISSUES), rounds, rounds.select("owner", "agent", "at"))


@query("SELECT o_orderkey, o_custkey, o_orderkey % 5 = 4 AS dangling, CASE WHEN o_orderkey % 5 = 4 THEN o_orderkey % 5 ELSE 100 + o_orderkey % 5 END AS page FROM orders")
def remapped_pages(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 5).alias("page"))
    mapping = o.select("o_custkey").distinct().select("o_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("old")).withColumn("new", F.col("old") + 100)
    return state.remapped(o, mapping, key=["o_custkey"], ref="page", old="old", new="new").select("o_orderkey", "o_custkey", "dangling", "page")


@query("SELECT c_custkey, CASE WHEN o IS NOT NULL AND a THEN 'cached' ELSE 'due' END AS state FROM customer LEFT JOIN (SELECT o_custkey AS o, bool_or(o_orderkey % 3 <> 0) AS a FROM orders GROUP BY o_custkey) ON o = c_custkey")
def read_through(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select("c_custkey")
    cache = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey"))).alias("value"))
    have, due = state.read_through(wanted, cache, key=["c_custkey"], needed=["value"])
    return have.select("c_custkey", F.lit("cached").alias("state")).unionByName(due.select("c_custkey", F.lit("due").alias("state")))


@query("""WITH l AS (SELECT o_custkey AS vid, arg_max('s' || o_orderkey % 4, (o_orderkey, 's' || o_orderkey % 4)) AS s, max(o_orderkey) AS m FROM orders GROUP BY o_custkey), c AS (SELECT o_custkey AS vid, o_orderkey AS k, (o_orderkey % 6)::VARCHAR AS id, 'old' AS was FROM orders),
x AS (SELECT c.*, s, CASE WHEN m % 2 = 0 THEN TRUE ELSE id IN ('1', '2', '3') END AS held FROM c JOIN l USING (vid)) SELECT vid, k, id, CASE WHEN held THEN s ELSE was END AS slideset_id, CASE WHEN bool_and(held) OVER (PARTITION BY vid) THEN s END AS top FROM x""")
def stamped_chapters(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vid"), F.col("o_orderkey").alias("k"))
    some = lambda *ids: F.array(*map(F.lit, ids))
    ledger = o.select("vid", F.col("k").alias("at"), F.concat(F.lit("s"), (F.col("k") % 4).cast("string")).alias("slideset_id"), F.when(F.col("k") % 2 == 0, some("0", "1", "2", "3", "4", "5")).otherwise(some("1", "2", "3")).alias("chapters"))
    return state.stamped(o.select("vid", "k", (F.col("k") % 6).cast("string").alias("id"), F.lit("old").alias("slideset_id")), ledger, key=["vid"]).select("vid", "k", "id", "slideset_id", "top")


# --- choice, triage, regions --------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a' WHEN c_custkey % 3 = 0 THEN 'b' END AS source, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal WHEN c_custkey % 3 = 0 THEN -c_acctbal END AS m, CASE WHEN c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 THEN 'no measurement' END AS reason FROM customer")
def measures_by_preference(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    part = lambda n, value: c.where(F.col("c_custkey") % n == 0).select("c_custkey", value.alias("m"))
    out = triage.preferred_measure(part(2, F.col("c_acctbal")), part(3, -F.col("c_acctbal")), key=["c_custkey"], columns=["m"], entities=c)
    return out.withColumn("source", F.when(F.col("source") == "sample", "a").when(F.col("source") == "full", "b")).select("c_custkey", "source", "m", "reason")


@query("""WITH m AS (SELECT c_custkey AS k, c_mktsegment AS s, c_nationkey % 8 AS cuts, c_custkey % 10 / 10.0 AS still, c_nationkey % 9 / 100.0 AS motion, c_custkey % 4 <> 0 AS measured FROM customer),
p AS (SELECT *, contains(s, 'BUILD')::INT + contains(s, 'ING')::INT AS a, contains(s, 'MACH')::INT + contains(s, 'RY')::INT AS b FROM m),
v AS (SELECT *, (a > 0)::INT + (measured AND cuts >= 3)::INT + (measured AND still >= 0.6)::INT AS slides, (b > 0)::INT + (measured AND cuts <= 0.5)::INT + (measured AND motion >= 0.05)::INT AS stream FROM p)
SELECT k, a AS n_slides, b AS n_stream, slides, stream, CASE WHEN slides - stream >= 2 THEN 'slides' ELSE 'stream' END AS suggest, round(CASE WHEN measured THEN least(0.9, 0.4 + 0.15 * abs(slides - stream)) ELSE least(0.5, 0.4 + 0.15 * abs(slides - stream)) END, 2) AS confidence,
 CASE WHEN a > b THEN 'slides likely (' || a || ':' || b || ')' ELSE 'stream likely (' || a || ':' || b || ')' END AS hint, k % 5 = 0 AND (slides - stream >= 2) AS conflict FROM v""")
def triage_votes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("measured", F.col("c_custkey") % 4 != 0)
    seen = lambda x: F.when(F.col("measured"), x)
    m = c.select(F.col("c_custkey").alias("k"), "measured", "c_mktsegment", seen((F.col("c_nationkey") % 8).cast("double")).alias("cuts_per_min"), seen(F.col("c_custkey") % 10 / 10.0).alias("freeze_ratio"), seen(F.col("c_nationkey") % 9 / 100.0).alias("motion_mean"))
    hits = triage.word_hits(m, texts=["c_mktsegment"], slides=["BUILD", "ING"], stream=["MACH", "RY"])
    out = triage.vote(hits, triage.evidence(), measured=F.col("measured"))
    mode = triage.effective_mode(F.when(F.col("k") % 5 == 0, F.lit("stream")), F.col("suggest"))
    return out.select("k", "n_slides", "n_stream", "slides", "stream", "suggest", F.round("confidence", 2).alias("confidence"), triage.hint_line(F.col("n_slides"), F.col("n_stream")).alias("hint"), F.coalesce(mode["conflict"], F.lit(False)).alias("conflict"))


@query("""WITH w AS (SELECT o_custkey AS k, o_orderkey AS win, o_orderkey % 7 AS cuts, o_orderkey % 11 / 100.0 AS motion FROM orders), v AS (SELECT *, CASE WHEN 1 + (cuts >= 3)::INT - (cuts <= 0.5)::INT - (motion >= 0.05)::INT >= 2 THEN 'slides' ELSE 'stream' END AS suggest FROM w)
SELECT k, win, suggest FROM v WHERE k IN (SELECT k FROM v GROUP BY k HAVING count(DISTINCT suggest) > 1)""")
def window_votes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("win"), (F.col("o_orderkey") % 7).cast("double").alias("cuts"), (F.col("o_orderkey") % 11 / 100.0).alias("motion"))
    return triage.window_verdicts(o, key=["k"], cuts=F.col("cuts"), motion=F.col("motion"), slides=F.lit(1)).select("k", "win", "suggest")


ROLE_SQL = """WITH f AS (SELECT l_orderkey AS vid, l_linenumber AS n, l_partkey AS pk, l_suppkey AS sk, l_partkey % 50 / 100.0 AS fg, l_suppkey % 40 / 40.0 AS mode, l_partkey % 7 / 100.0 AS skin, l_linenumber % 4 * 1.5 AS stroke, l_partkey % 9 / 12.0 AS bar, l_suppkey % 30 / 30.0 AS win, l_partkey % 25 AS bands, l_suppkey % 3 AS run FROM lineitem),
m AS (SELECT vid, median(stroke) FILTER (stroke > 0) AS sm, median(bar) AS bb FROM f GROUP BY vid)
SELECT vid, n, pk, sk, CASE WHEN fg <= 0.004 THEN 'uniform_frame' WHEN bar >= greatest(0.10, bb + 0.30) AND win >= 0.25 THEN 'letterbox' WHEN skin >= 0.05 AND mode <= 0.35 THEN 'face_dominant' WHEN sm > 0 AND stroke >= 2 * sm AND mode >= 0.4 AND fg >= 0.05 THEN 'stroke_scale'
 WHEN fg / 10 <= 0.032 AND bands >= 12 AND run > 0 AND run <= 2 THEN 'ui_dense_small_text' WHEN mode >= 0.45 AND fg >= 0.01 AND bands >= 1 AND skin < 0.05 THEN 'layout_grid' ELSE 'layout_weak' END AS criterion FROM f JOIN m USING (vid)"""


@query(ROLE_SQL)
def page_roles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("vid"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"))
    c = lambda k, n, by: (F.col(k) % n / by).cast("double")
    given = {"fg": c("pk", 50, 100.0), "mode": c("sk", 40, 40.0), "skin": c("pk", 7, 100.0), "stroke": c("n", 4, 1.0) * 1.5, "bar_top": c("pk", 9, 12.0), "bar_window": c("sk", 30, 30.0), "bands": c("pk", 25, 1.0), "app_fg": c("pk", 50, 100.0) / 10, "app_bands": c("pk", 25, 1.0), "app_run": c("sk", 3, 1.0), "std": F.lit(0.5), "content": F.lit(0.9), "border": F.lit(0.5), "edge": F.lit(0.1)}
    names = vision.FEATURES.replace(" double", "").split(", ")
    feat = F.struct(*[given.get(x, F.lit(0.0)).alias(x) for x in names])
    return vision.roles(li.withColumn("feat", feat), key=["vid"], settings={"zoom_stroke_multiple": 2.0}).select("vid", "n", "pk", "sk", F.col("role.criterion").alias("criterion"))


REGIONS = "SELECT o_custkey AS vid, o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'caption_strip' WHEN o_orderkey % 4 = 1 THEN 'handwriting' WHEN o_orderkey % 4 = 2 THEN 'transient_overlay' ELSE 'pip_window' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'insufficient' ELSE 'ok' END AS applicability, o_orderkey % 5 / 10.0 AS a, o_orderkey % 5 / 10.0 + 0.2 AS z FROM {orders}"


@query(_with(r=REGIONS) + "SELECT vid, k, kind FROM r WHERE applicability = 'ok' AND kind IN ('caption_strip', 'pip_window')")
def usable_regions(spark, sf_dir):
    r = _spark(spark, sf_dir, REGIONS).withColumn("box", F.array("a", F.lit(0.0), "z", F.lit(0.5)))
    return vision.usable_masks(r).select("vid", "k", "kind")


@query(_with(r=REGIONS) + "SELECT vid, count(*) AS n, round(least(sum(CASE WHEN kind IN ('caption_strip', 'pip_window') THEN (z - a) * 0.5 ELSE 0 END), 1), 6) AS area FROM r GROUP BY vid")
def region_areas(spark, sf_dir):
    r = _spark(spark, sf_dir, REGIONS).withColumn("box", F.array(F.col("a").cast("double"), F.lit(0.0), F.col("z").cast("double"), F.lit(0.5)))
    return vision.area_stats(r, key=["vid"]).select("vid", "n", F.round("area", 6).alias("area"))


@query("""WITH f AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000 AS b, abs(hour(ts) - lag(hour(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000.0 AS t FROM events), r AS (SELECT user_id, count(*) AS n, avg((b > 0.021)::INT) AS rb, avg((t > 0.021)::INT) AS rt FROM f WHERE b IS NOT NULL GROUP BY user_id)
SELECT user_id, round(rb, 6) AS rate_bottom, round(rt, 6) AS rate_title, CASE WHEN n >= 7 AND rb > 0.15 AND rb > greatest(rt * 3, rt + 0.08) THEN 23 END AS "first" FROM r""")
def legacy_captions(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("h", F.hour("ts"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    both = ev.select("user_id", (F.abs(F.col("value") - F.lag("value").over(w)) / 1000).alias("bottom"), (F.abs(F.col("h") - F.lag("h").over(w)) / 1000.0).alias("title")).where("bottom is not null")
    return vision.legacy_caption(both, key=["user_id"]).select("user_id", F.round("rate_bottom", 6).alias("rate_bottom"), F.round("rate_title", 6).alias("rate_title"), "first")


@query("""WITH o AS (SELECT o_custkey AS vid, o_orderkey AS k, o_totalprice AS score, o_orderkey % 10 / 10.0 AS occ FROM orders) SELECT vid, k, round(score, 4) AS score, round(occ, 4) AS occlusion, k % 2 = 0 AS transient_overlay, CASE WHEN k % 3 = 0 THEN NULL ELSE 'full_page' END AS role FROM o""")
def candidate_documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vid"), F.col("o_orderkey").alias("k"), F.struct(F.lit(1.0).alias("t"), F.lit("f").alias("file"), F.col("o_totalprice").alias("score"), F.lit(3).alias("ocr_chars"), F.lit(0.5).alias("ink"), F.when(F.col("o_orderkey") % 3 != 0, "full_page").alias("role"), F.lit(None).cast("string").alias("role_evidence"), (F.col("o_orderkey") % 10 / 10.0).alias("occlusion"), F.when(F.col("o_orderkey") % 2 == 0, True).alias("transient_overlay")).alias("c"))
    return o.select("vid", "k", pick.candidate_document(F.col("c")).alias("d")).select("vid", "k", "d.score", F.round("d.occlusion", 4).alias("occlusion"), "d.transient_overlay", "d.role")


@query("SELECT c_custkey AS vid, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS v FROM customer")
def first_of_several(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vid"))
    half = c.where("vid % 2 = 0").withColumn("v", F.lit(1))
    return pick.first_available(c.withColumn("v", F.lit(None).cast("int")), (half, "half"), (c.withColumn("v", F.lit(2)), "all"), key=["vid"], column="v").select("vid", "v")


@query("SELECT o_custkey AS vid, o_orderkey AS seg, (o_orderkey % 2 = 0)::INT + o_orderkey % 4 AS flags FROM orders")
def reader_flags(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vid"), F.col("o_orderkey").alias("seg"))
    basis = F.when(F.col("seg") % 2 == 0, "Context").otherwise("screen")
    o = o.withColumns({"corrections": F.array(F.struct(basis.alias("basis"))), "uncertainties": F.array_repeat(F.lit("?"), (F.col("seg") % 4).cast("int"))})
    return o.select("vid", "seg", integrity.reader_flags().alias("flags"))


@query(_with(i=ISSUES) + "SELECT message FROM i WHERE level IN ('error', 'review') AND owner = 'pipeline'")
def issues_of_an_owner(spark, sf_dir):
    return integrity.for_owner(_spark(spark, sf_dir, ISSUES), "pipeline").select("message")


@query(_with(i=ISSUES.replace("o_custkey AS owner_k", "CAST(o_custkey % 9 AS VARCHAR(9)) AS chapter")) + "SELECT message FROM i WHERE chapter IN ('3', '5')")
def issues_in_scope(spark, sf_dir):
    return integrity.scoped(_spark(spark, sf_dir, ISSUES.replace("o_custkey AS owner_k", "CAST(o_custkey % 9 AS VARCHAR(9)) AS chapter")), ["3", "5", "?"]).select("message")


# --- logs, notes, front matter, glossaries ---------------------------------------------------------------------------

LOG = """SELECT o_custkey AS vid, 'frame:' || CAST(o_orderkey AS VARCHAR(20)) || ' pts:1 pts_time:' || CAST(o_orderkey % 5000 AS VARCHAR(20)) || '.25' AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'lavfi.scd.mafd=oops' ELSE 'lavfi.scd.mafd=' || CAST(o_orderkey % 17 AS VARCHAR(20)) || '.5' END AS b,
 CASE WHEN o_orderkey % 4 = 0 THEN 'freeze_start: ' || CAST(o_orderkey AS VARCHAR(20)) WHEN o_orderkey % 4 = 1 THEN 'freeze_end=' || CAST(o_orderkey AS VARCHAR(20)) || '.5' ELSE 'other=1' END AS c, o_orderkey AS k FROM {orders}"""


def _log_lines(spark, sf_dir):
    rows = _spark(spark, sf_dir, LOG)
    return rows.select("vid", F.posexplode(F.array("a", "b", "c")).alias("p", "line"), "k").select("vid", (F.col("k") * 3 + F.col("p")).alias("line_no"), "line")


@query(_with(l=LOG) + "SELECT vid, k % 5000 + 0.25 AS t, CASE WHEN k % 3 <> 0 THEN k % 17 + 0.5 END AS mafd FROM l")
def measurement_rows(spark, sf_dir):
    return markup.measurement_rows(_log_lines(spark, sf_dir), key=["vid"], names=["lavfi.scd.mafd"])


@query(_with(l=LOG) + "SELECT vid, k * 3 + 2 AS line_no, CASE WHEN k % 4 = 0 THEN 'start' ELSE 'end' END AS kind, k + CASE WHEN k % 4 = 0 THEN 0 ELSE 0.5 END AS t FROM l WHERE k % 4 < 2")
def log_events(spark, sf_dir):
    return markup.log_events(_log_lines(spark, sf_dir), key=["vid"], name="freeze")


PROBE = "SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN 'nothing' ELSE '  Duration: 0' || CAST(p_size % 9 AS VARCHAR(9)) || ':' || lpad(CAST(p_partkey % 60 AS VARCHAR(9)), 2, '0') || ':07.50, start_NL Video: h264, ' || CAST(p_size * 20 + 100 AS VARCHAR(9)) || 'x' || CAST(p_size * 10 + 100 AS VARCHAR(9)) || ', 29.97 fps' END AS text, CASE WHEN p_size % 3 = 0 THEN 'https://x/video/BV1abcdefghi?a=1&p=' || CAST(p_size AS VARCHAR(9)) ELSE 'BV1abcdefghi' END AS url FROM {part}"


@query(_with(p=PROBE.replace("{part}", "part")) + ", q AS (SELECT p_partkey AS k, p_size AS s FROM part) SELECT k, CASE WHEN s % 5 <> 0 THEN s % 9 * 3600 + k % 60 * 60 + 7.5 END AS duration, CASE WHEN s % 5 <> 0 THEN s * 20 + 100 END AS width, CASE WHEN s % 5 <> 0 THEN s * 10 + 100 END AS height, CASE WHEN s % 5 <> 0 THEN 29.97 END AS fps, CASE WHEN s % 3 = 0 THEN s ELSE 1 END AS page FROM q")
def media_properties(spark, sf_dir):
    p = spark.sql(PROBE.replace("VARCHAR(9)", "STRING").replace("_NL", "' || chr(10) || '"), part=table(spark, sf_dir, "part"))
    pages = p.select("k", markup.target_of(F.col("url"))["page"].alias("page"))
    return markup.media_properties(p, key=["k"], text="text").join(pages, "k")


CUES = """SELECT conv_id AS vid, '_OPEN"from": ' || CAST(turn * 5 AS VARCHAR(9)) || '.5, "to": ' || CAST(turn * 5 + 4 AS VARCHAR(9)) || ', "content": "' || CASE WHEN length(text) % 4 = 0 THEN '  ' ELSE ' t' || CAST(length(text) AS VARCHAR(9)) || ' ' END || '"_SHUT' AS cue, turn, text FROM {conversations}"""


@query(_with(c=CUES) + "SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY turn, text)::INT AS seq, turn * 5 + 0.5 AS t_from, turn * 5 + 4 AS t_to, 't' || length(text) AS text FROM c WHERE length(text) % 4 <> 0")
def json_cues(spark, sf_dir):
    cues = _spark(spark, sf_dir, CUES)
    cue = F.replace(F.replace("cue", F.lit("_OPEN"), F.lit("{")), F.lit("_SHUT"), F.lit("}"))
    docs = assemble.joined_lines(cues, key=["vid"], order=["turn", "text"], line=cue, separator=",", out="body")
    return markup.json_cues(docs.select("vid", F.concat(F.lit('{"body": ['), "body", F.lit("]}")).alias("doc")), key=["vid"], text="doc").select("vid", "seq", "t_from", "t_to", "text")


NOTE = """SELECT conv_id AS vid, turn, text, '## ' || CASE WHEN length(text) % 5 = 0 THEN 'plain' ELSE '[0' || CAST(turn AS VARCHAR(9)) || ':' || CAST(length(text) % 50 + 10 AS VARCHAR(9)) || '] n' || CAST(length(text) AS VARCHAR(9)) END || '_NL- what: a' || CAST(turn AS VARCHAR(9)) || '_NL* **why**： b_NL' || CASE WHEN length(text) % 3 = 0 THEN '- what：c' ELSE 'no bullet: d' END AS node FROM {conversations}"""


@query(_with(n=NOTE) + """, o AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY turn, text) AS g, length(text) % 5 <> 0 AS good FROM n)
SELECT vid, '0' || turn || ':' || (length(text) % 50 + 10) AS time, 'n' || length(text) AS node, unnest(CASE WHEN length(text) % 3 = 0 THEN ['a' || turn, 'c'] ELSE ['a' || turn] END) AS hook FROM o WHERE good""")
def note_hooks(spark, sf_dir):
    docs = assemble.joined_lines(_spark(spark, sf_dir, NOTE), key=["vid"], order=["turn", "text"], line=F.col("node"), out="md")
    nodes = markup.note_nodes(markup.lines_of(docs, key=["vid"], text="md"), key=["vid"])
    return markup.hooks(nodes, key=["vid"], label="what")


FRONT = "SELECT p_partkey AS k, '---_NLtitle: \"T' || CAST(p_size AS VARCHAR(9)) || '\"_NLtags: [x, \"y\"' || CASE WHEN p_size % 2 = 0 THEN ', z' ELSE '' END || ']_NLmore:_NL  - p_NL  - q' || CAST(p_size AS VARCHAR(9)) || '_NL---_NLbody' AS t FROM {part}"


@query("SELECT p_partkey AS k, 'T' || p_size AS name, CASE WHEN p_size % 2 = 0 THEN 'x,y,z' ELSE 'x,y' END AS labels, 'p,q' || p_size AS rest, '' AS gone FROM part")
def migrated_fronts(spark, sf_dir):
    docs = spark.sql(FRONT.replace("VARCHAR(9)", "STRING").replace("_NL", "' || chr(10) || '"), part=table(spark, sf_dir, "part"))
    out = markup.migrated(markup.front_matter(docs, key=["k"], text="t"), key=["k"], names={"title": "name", "tags": "labels", "more": "rest", "none": "gone"})
    return out.select("k", *[F.array_join(c, ",").alias(c) for c in ("name", "labels", "rest", "gone")])


@query("SELECT c_custkey AS vid, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE 'p' || c_nationkey END AS terms, CASE WHEN c_custkey % 3 <> 0 THEN 'profile' WHEN c_custkey % 2 = 0 THEN 'confirmed' ELSE 'proposed' END AS status, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE 'p' || c_nationkey END AS kept, 'p' || c_nationkey AS proposal, CASE WHEN c_custkey % 3 = 0 THEN 'own,new' END AS reviewed FROM customer")
def glossaries(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vid"), F.array(F.concat(F.lit("p"), F.col("c_nationkey").cast("string"))).alias("terms_use"))
    glossary = c.where("vid % 3 = 0").select("vid", (F.col("vid") % 2 == 0).alias("confirmed"), F.array(F.lit("own"), F.lit("bad")).alias("terms_use"), F.create_map(F.lit("a"), F.lit("b")).alias("terms_avoid"))
    done = terms.reviewed(glossary, drop=["bad"], add=["new", "own"], avoid={"a": "c"})
    good = glossary.withColumn("terms_use", F.array(F.lit("own")))
    text = lambda x: F.array_join(x, ",")
    out = terms.effective_glossary(good, c, key=["vid"]).select("vid", text("terms_use").alias("terms"), "status")
    out = out.join(terms.proposed(good, c, key=["vid"]).select("vid", text("terms_use").alias("kept"), text("proposal").alias("proposal")), "vid")
    return out.join(done.select("vid", text("terms_use").alias("reviewed")), "vid", "left")


@query("""WITH RECURSIVE c AS (SELECT DISTINCT user_id AS u, extract(hour FROM ts)::INT AS r, extract(day FROM ts)::INT % 6 AS c FROM events WHERE value > 60),
x AS (SELECT u, r, c, r AS lr, c AS lc FROM c UNION SELECT c.u, c.r, c.c, x.lr, x.lc FROM x JOIN c ON c.u = x.u AND abs(c.r - x.r) + abs(c.c - x.c) = 1) SELECT u, r, c, arg_min(lr || '-' || lc, (lr, lc)) AS component FROM x GROUP BY u, r, c""")
def grid_components(spark, sf_dir):
    c = table(spark, sf_dir, "events").where("value > 60").select(F.col("user_id").alias("u"), F.hour("ts").alias("r"), (F.dayofmonth("ts") % 6).alias("c")).distinct()
    return folds.grid_components(c, key=["u"], row="r", col="c")


@query("""WITH g AS (SELECT o_custkey AS vid, o_orderpriority AS ord, (o_orderkey % 20)::INT AS id FROM orders), k AS (SELECT DISTINCT vid, ord, id FROM g WHERE id < 15), m AS (SELECT vid, ord, min(id * 10) AS t_start, string_agg(id::VARCHAR, ',' ORDER BY id) AS slides FROM k GROUP BY ALL)
SELECT vid, lpad((row_number() OVER w)::VARCHAR, 2, '0') AS id, t_start, coalesce(lead(t_start) OVER w, 500) AS t_end, slides FROM m WINDOW w AS (PARTITION BY vid ORDER BY t_start, ord)""")
def chapters_of_groups(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("vid"), F.col("o_orderpriority").alias("ord")).agg(F.collect_set((F.col("o_orderkey") % 20).cast("int")).alias("slides"))
    vids = g.select("vid").distinct()
    slides = vids.select("vid", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("id")).withColumn("t_start", F.col("id") * 10)
    return folds.chapters_of_groups(g, slides, vids.withColumn("duration", F.lit(500)), key=["vid"]).withColumn("slides", F.array_join("slides", ","))


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS sec, o_orderkey % 6000 AS t FROM orders), c AS (SELECT o_custkey AS k, l_orderkey * 10 + l_linenumber AS cue, l_partkey * 31 % 6000 AS t, repeat('x', (l_quantity % 12)::INT) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
n AS (SELECT s.k, sec, arg_min(cue, (CASE WHEN length(w) >= 6 THEN 0 ELSE 1 END, c.t, cue)) AS cue FROM s JOIN c ON c.k = s.k AND c.t BETWEEN s.t - 3 AND s.t + 18 GROUP BY s.k, sec), l AS (SELECT s.k, sec, arg_min(cue, (c.t, cue)) AS cue FROM s JOIN c ON c.k = s.k AND c.t >= s.t GROUP BY s.k, sec)
SELECT s.k, s.sec, coalesce(n.cue, l.cue) AS cue FROM s LEFT JOIN n ON n.sec = s.sec LEFT JOIN l ON l.sec = s.sec""")
def anchor_cues(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("sec"), (F.col("o_orderkey") % 6000).cast("double").alias("t"))
    c = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cue"), (F.col("l_partkey") * 31 % 6000).cast("double").alias("ct"), F.repeat(F.lit("x"), (F.col("l_quantity") % 12).cast("int")).alias("w"))
    return temporal.first_anchor(s, c, key=["k"], section_id="sec", section_time="t", cue_id="cue", cue_time="ct", cue_text="w")
