"""Registered queries on texts, terms, pages, conversations and state. See ``driver_queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, texts, times
from ..operators import assemble, folds, integrity, markup, pick, state, temporal, terms, triage
from .driver_queries import DAY_ZERO, DIFFS, EV, events, query, spread, table

#: DuckDB has no look-ahead: n-grams by position there.
GRAMS = """(SELECT list_distinct(list(substr(c, i, 4))) FROM (SELECT {0} AS c) x, LATERAL (SELECT unnest(generate_series(1, length(c) - 3)) AS i) y WHERE length(c) >= 4)"""


def bench_text(spark, sf_dir):
    """Benchmark items with the next item's text."""
    b = table(spark, sf_dir, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next_text"))
    return b.join(nxt, "item_id")


BENCH = "b AS (SELECT a.item_id, a.text, z.text AS next_text FROM benchmark a JOIN benchmark z ON z.item_id = a.item_id + 1)"
COMPACT = "lower(regexp_replace({0}, '[^0-9A-Za-z一-鿿]', '', 'g'))"


@query(f"""WITH {BENCH}, c AS (SELECT item_id, {COMPACT.format('text')} AS x, {COMPACT.format('next_text')} AS y FROM b),
g AS (SELECT item_id, list_distinct([substr(x, i::INT, 4) FOR i IN range(1, greatest(length(x) - 2, 1))]) AS gx, list_distinct([substr(y, i::INT, 4) FOR i IN range(1, greatest(length(y) - 2, 1))]) AS gy FROM c)
SELECT item_id, round(CASE WHEN least(len(gx), len(gy)) > 0 THEN len(list_intersect(gx, gy)) / least(len(gx), len(gy)) ELSE 0 END, 6) AS containment FROM g""")
def gram_containment(spark, sf_dir):
    b = spread(bench_text(spark, sf_dir))
    return b.select("item_id", F.round(texts.gram_containment(texts.grams(F.col("text")), texts.grams(F.col("next_text"))), 6).alias("containment"))


@query(f"""WITH {BENCH}, u AS (SELECT item_id, length(text) AS lx, length(next_text) AS ly, unnest(string_split(text, '')) AS c, 1 AS s FROM b UNION ALL SELECT item_id, length(text), length(next_text), unnest(string_split(next_text, '')), 2 FROM b),
n AS (SELECT item_id, lx, ly, c, count(*) FILTER (s = 1) AS a, count(*) FILTER (s = 2) AS z FROM u GROUP BY ALL)
SELECT item_id, round(sum(least(a, z)) / least(max(lx), max(ly)), 6) AS containment FROM n GROUP BY item_id""")
def character_containment(spark, sf_dir):
    b = bench_text(spark, sf_dir)
    chars = lambda c, s: b.select("item_id", F.length("text").alias("lx"), F.length("next_text").alias("ly"), F.explode(F.split(c, "")).alias("c"), F.lit(s).alias("s"))
    counted = chars("text", 1).unionByName(chars("next_text", 2)).groupBy("item_id", "lx", "ly", "c").agg(F.sum(F.when(F.col("s") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("s") == 2, 1).otherwise(0)).alias("z"))
    return counted.groupBy("item_id").agg(F.round(F.sum(F.least("a", "z")) / F.least(F.max("lx"), F.max("ly")), 6).alias("containment"))


@query("""SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS n_visible, length(regexp_replace(text, '[^0-9A-Za-z一-鿿]', '', 'g')) AS n_compact FROM documents""")
def visible_characters(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", texts.visible_length(F.col("text")).alias("n_visible"), F.length(texts.compact(F.col("text"))).alias("n_compact"))


TERMS = """WITH w AS (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+#.\\-]*[A-Za-z0-9+#]|[A-Za-z]')) AS w FROM documents), s AS (SELECT lang, w, lower(w) AS low, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT lang, low, sum(n) AS count, arg_min(w, (-n, w)) AS term FROM s WHERE low NOT IN ('the', 'and') GROUP BY ALL HAVING sum(n) >= 2),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY count DESC, term) AS k FROM f)
"""


def _terms(spark, sf_dir, top=40):
    return terms.term_counts(spread(table(spark, sf_dir, "documents")), key=["lang"], text="text", stop=["the", "and"], top=top)


@query(TERMS + "SELECT lang, term, count FROM t WHERE k <= 40")
def term_counts(spark, sf_dir):
    return _terms(spark, sf_dir)


@query(TERMS + """, a AS (SELECT lang, term FROM t WHERE k <= 400), c AS (SELECT lang, term AS canonical FROM t WHERE k <= 120)
SELECT a.lang, term, min(canonical) AS canonical FROM a JOIN c ON a.lang = c.lang AND term <> canonical AND levenshtein(lower(term), lower(canonical)) <= 1 AND (length(term) > 2 OR length(canonical) >= 3 OR lower(term) = lower(canonical)) GROUP BY ALL""")
def edit1_variants(spark, sf_dir):
    found = _terms(spark, sf_dir, top=400)
    return terms.edit_variants(found.select("lang", "term"), _terms(spark, sf_dir, top=120).select("lang", F.col("term").alias("canonical")), key=["lang"])


@query("""WITH p AS (SELECT source, lang AS w, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'brief' END AS r FROM documents), o AS (SELECT source, w, r, count(*) AS own FROM p GROUP BY ALL), m AS (SELECT DISTINCT source, right(source, 1) AS fam FROM documents),
t AS (SELECT fam, w, r, sum(own) AS total FROM o JOIN m USING (source) GROUP BY ALL)
SELECT m.source, t.w, t.r, total - coalesce(own, 0) AS count FROM m JOIN t USING (fam) LEFT JOIN o ON o.source = m.source AND o.w = t.w AND o.r = t.r WHERE total - coalesce(own, 0) > 0""")
def sibling_corrections(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pairs = d.select("source", F.col("lang").alias("w"), F.when(F.col("n_chars") > 2000, "long").otherwise("brief").alias("r"))
    members = d.select("source", F.right("source", F.lit(1)).alias("fam")).distinct()
    return terms.sibling_corrections(pairs, members, entity="source", family="fam", wrong="w", right="r")


@query("""SELECT doc_id, (contains(lower(text), 'license')::INT + contains(lower(text), 'copyright')::INT) AS n_slides, (contains(lower(text), 'the')::INT) AS n_stream FROM documents""")
def keyword_leanings(spark, sf_dir):
    return terms.keyword_leanings(spread(table(spark, sf_dir, "documents")), [("license", "slides"), ("copyright", "slides"), ("the", "stream")], key=["doc_id"], text="text")


@query("""SELECT p_partkey, coalesce(length(regexp_replace(p_name, '[\\s\\W_]+', '', 'g')) > 0 AND length(p_name) >= 2 AND p_name <> p_brand AND length(trim(p_brand)) > 0, false) AS usable FROM part""")
def usable_pairs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", terms.usable_pair(F.col("p_name"), F.col("p_brand")).alias("usable"))


@query("""WITH p AS (SELECT p_brand, left(p_type, 4 + p_size % 8) AS w, p_type AS r, p_partkey FROM part), a AS (SELECT p_brand, w, r, count(*) AS count, 'term' AS kind FROM p WHERE length(w) <= 8 GROUP BY ALL),
b AS (SELECT p_brand, w, r, 1 AS count, 'example' AS kind, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM p WHERE length(w) > 8)
SELECT * FROM a UNION ALL SELECT p_brand, w, r, count, kind FROM b WHERE k <= 5""")
def distilled_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.expr("left(p_type, 4 + p_size % 8)").alias("w"), F.col("p_type").alias("r"), "p_partkey")
    return terms.distilled(p, key=["p_brand"], wrong="w", right="r", order="p_partkey")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def counts_by(spark, sf_dir):
    return terms.counts_by(table(spark, sf_dir, "documents"), "lang", key=["source"])


# --- hashes, numbers, times ---------------------------------------------------------------------------------------


def sign_hashes(spark, sf_dir):
    """64 signs of each vector as one 64-bit number (the sign of component i is bit i)."""
    e = table(spark, sf_dir, "embeddings")
    bits = F.aggregate(F.sequence(F.lit(0), F.least(F.size("embedding"), F.lit(64)) - 1), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.when(F.get("embedding", i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return e.select("vec_id", "label", bits.alias("h"))


HASHES = """h AS (SELECT vec_id, label, bit_or(CASE WHEN v <= 0 THEN 0::BIGINT WHEN i = 64 THEN -9223372036854775808 ELSE 1::BIGINT << (i - 1) END)::BIGINT AS h FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE i <= 64 GROUP BY ALL)"""


@query(f"WITH {HASHES} SELECT a.vec_id, bit_count(xor(a.h, b.h)) AS d FROM h a JOIN h b ON b.vec_id = a.vec_id + 1")
def signhash_hamming(spark, sf_dir):
    h = sign_hashes(spark, sf_dir)
    return h.join(h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g")), "vec_id").select("vec_id", numbers.hamming(F.col("h"), F.col("g")).alias("d"))


@query(f"""WITH RECURSIVE {HASHES}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM h),
r AS (SELECT label, 0::BIGINT AS k, []::BIGINT[] AS kept, NULL::BIGINT AS vec_id, false AS twin FROM (SELECT DISTINCT label FROM o)
 UNION ALL SELECT o.label, o.k, CASE WHEN len(list_filter(r.kept, lambda x: bit_count(xor(x, o.h)) <= 22)) > 0 THEN r.kept ELSE list_append(r.kept, o.h) END, o.vec_id, len(list_filter(r.kept, lambda x: bit_count(xor(x, o.h)) <= 22)) > 0 FROM r JOIN o ON o.label = r.label AND o.k = r.k + 1)
SELECT label, vec_id, CASE WHEN twin THEN 'duplicate' ELSE 'kept' END AS verdict FROM r WHERE vec_id IS NOT NULL""")
def greedy_distinct_hashes(spark, sf_dir):
    return folds.greedy_distinct_hashes(sign_hashes(spark, sf_dir), key=["label"], order=["vec_id"], hashed="h", limit=22)


@query("""SELECT a.vec_id, round(list_sum([abs(p[1]::DOUBLE - p[2]::DOUBLE) FOR p IN list_zip(a.embedding, b.embedding)]) / len(a.embedding), 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def mean_abs_diff(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("g")), "vec_id").select("vec_id", F.round(numbers.mean_abs_diff(F.col("embedding"), F.col("g")), 6).alias("d"))


@query("""SELECT event_id, printf('%02d:%02d:%02d', (v // 3600)::INT, ((v // 60) % 60)::INT, (v % 60)::INT) AS hms,
 CASE WHEN v < 3600 THEN printf('%02d:%02d', (v // 60)::INT, (v % 60)::INT) ELSE printf('%d:%02d:%02d', (v // 3600)::INT, ((v // 60) % 60)::INT, (v % 60)::INT) END AS mmss, v AS back
FROM (SELECT event_id, floor(abs(value) * 97)::BIGINT AS v FROM events)""")
def time_formats(spark, sf_dir):
    v = F.abs("value") * 97
    ev = table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return ev.select("event_id", times.hms(F.col("v")).alias("hms"), times.mmss(F.col("v"), pad_hour=False).alias("mmss"), times.seconds_of(times.hms(F.col("v"))).alias("back"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def dates_of_epochs(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", times.date_of(F.floor("t")).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 1024 THEN printf('%d B', floor(o_totalprice)::BIGINT) WHEN o_totalprice < 1048576 THEN printf('%.1f KB', floor(o_totalprice / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(o_totalprice / 1048576 * 10 + 0.5) / 10) END AS size FROM orders")
def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.human_size(F.col("o_totalprice")).alias("size"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round(l_quantity / (l_tax * 100), 6) ELSE 0 END AS ratio FROM lineitem""")
def text_ratios(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(numbers.ratio_of(F.concat(F.col("l_quantity").cast("string"), F.lit("/"), (F.col("l_tax") * 100).cast("string"))), 6).alias("ratio"))


@query("""SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, (10 + l_discount * 500) / 1000)), 6) AS l, round(greatest(0, least(1, (20 + l_tax * 400) / 800)), 6) AS t FROM lineitem""")
def crop_boxes(spark, sf_dir):
    box = numbers.crop_box_to_media(F.array("l_discount", "l_tax", F.lit(0.9), F.lit(0.9)), F.lit("500:400:10:20"), F.lit(1000), F.lit(800))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", F.round(F.col("b")[0], 6).alias("l"), F.round(F.col("b")[1], 6).alias("t"))


# --- pages and Markdown -------------------------------------------------------------------------------------------


@query("""SELECT page_id, regexp_extract(url, '^[^?#]*') || CASE WHEN try_cast(regexp_extract(url, '[?&]page=(\\d+)', 1) AS INT) > 1 THEN '?page=' || try_cast(regexp_extract(url, '[?&]page=(\\d+)', 1) AS INT) ELSE '' END AS url FROM pages""")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", texts.canonical_url(F.col("url"), keep="page").alias("url"))


@query("""SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS n_links, len(regexp_extract_all(html, '<h[1-6]>')) AS n_headings FROM pages""")
def link_refs(spark, sf_dir):
    p = spread(table(spark, sf_dir, "pages"))
    return p.select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))).alias("n_links"), F.size(F.regexp_extract_all("html", F.lit("<h[1-6]>"), F.lit(0))).alias("n_headings"))


@query("""SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS safe, CASE WHEN length(url) > 30 THEN left(url, 29) || '…' ELSE url END AS short FROM pages""")
def escaped_and_clipped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", texts.html_escaped(F.col("url")).alias("safe"), texts.clip(F.col("url"), 30).alias("short"))


#: What a turn adds to its conversation's Markdown document, by (turn + length of its text) modulo 6: {t} and {u} are
#: times, {n} the slide's number in four digits, {m} without zeros, {w} the text without marks.
TURNS = [
    "## [{t}] {role}\n*{t}–{u} ｜ slide {n}*\n{w}\n![x](slides/{n}.jpg)\n> note\n> - item",
    "## [{t}] {role}\n```\n## [00:00:09] in a fence\n![no](slides/9.jpg)\n# deep\n```\n{w}\n> - no\n\n> 1. one\n> note\n> * two\nafter",
    "## [{t}] {role}\n{w}\n![y](pictures/7.gif) ![z](../slides/{m}.png)\n> other\n> - thing\n* {t} - {u} *",
    "## {role} without a time\n\n  *slides: {m}, {n}；{t}~{u}*\n#### deep\n![f](figures/fig_{m}.png) ![g](figures/{m}.png)\n{w}",
    "# {role}\n## [{s}] short form\n*no time, no page*\n~~~\n###### fenced\n{w}\n~~~\n###### six\n> note",
    "##no heading\n#####  five \n## \n##\t[{t}]   tabs  \n![s](a/b/sheets/sheet_{m}.png)![t](sheets/sheet_x.png)\n{w}\n*{u}—{t} slide {m}、{n}*",
]


def markdown(spark, sf_dir):
    """A Markdown document per conversation, irregular on purpose: fences, headings and references that aren't, missing times."""
    c = table(spark, sf_dir, "conversations")
    n = F.lpad((F.col("turn") + 1).cast("string"), 4, "0")
    values = {"t": times.hms(F.col("turn") * 60), "u": times.hms(F.col("turn") * 60 + 59), "s": F.substring(times.hms(F.col("turn") * 60), 4, 5), "n": n, "m": (F.col("turn") + 1).cast("string"), "role": F.col("role"), "w": F.regexp_replace("text", "[#`>*|~\r]", "")}
    body = F.element_at(F.array(*map(F.lit, TURNS)), ((F.col("turn") + F.length("text")) % 6 + 1).cast("int"))
    for name, value in values.items():
        body = F.replace(body, F.lit("{" + name + "}"), value)
    return assemble.joined_lines(c, key=["conv_id"], order=["turn", "role", "text"], line=body, out="md")


def _sql_markdown() -> str:
    hms = "printf('%02d:%02d:%02d', (({0}) // 3600)::INT, (({0}) // 60 % 60)::INT, (({0}) % 60)::INT)"
    t, u = hms.format("turn * 60"), hms.format("turn * 60 + 59")
    body = "[" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for x in TURNS) + "][(turn + length(text)) % 6 + 1]"
    for name, value in {"t": t, "u": u, "s": f"substr({t}, 4, 5)", "n": "lpad((turn + 1)::VARCHAR, 4, '0')", "m": "(turn + 1)::VARCHAR", "role": "role", "w": r"regexp_replace(text, '[#`>*|~\r]', '', 'g')"}.items():
        body = f"replace({body}, '{{{name}}}', {value})"
    return f"md AS (SELECT conv_id, string_agg({body}, chr(10) ORDER BY turn, role, text) AS md FROM conversations GROUP BY conv_id)"


MD = _sql_markdown()
#: Numbered lines, and which of them are in fences.
LINES = MD + r""", ln AS (SELECT conv_id, unnest(string_split(md, chr(10))) AS line, unnest(range(len(string_split(md, chr(10))))) AS i FROM md),
fn AS (SELECT *, mark OR sum(mark::INT) OVER (PARTITION BY conv_id ORDER BY i) % 2 = 1 AS fenced FROM (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS mark FROM ln))"""
#: Seconds of a written time.
SECONDS = "list_reduce(list_prepend(0::BIGINT, [x::BIGINT FOR x IN string_split({0}, ':')]), lambda a, x: a * 60 + x)"


def markdown_lines(spark, sf_dir):
    return markup.lines_of(spread(markdown(spark, sf_dir)), key=["conv_id"], text="md")


@query("WITH " + LINES + r""", h AS (SELECT *, regexp_matches(line, '^##\s+\S') AS head FROM ln), n AS (SELECT *, sum(head::INT) OVER (PARTITION BY conv_id ORDER BY i) AS s FROM h),
g AS (SELECT conv_id, s, min(i) AS head_idx, max(i) + 1 AS end_idx, any_value(regexp_replace(line, '^##\s+', '')) FILTER (head) AS title, arg_min(line, i) FILTER (NOT head AND length(trim(line)) > 0) AS first_line,
  sum(len(list_filter([regexp_extract(line, '!\[[^\]]*\]\((?:[^()\s]*/)?slides/(\d{1,4})\.(?:jpg|png)\)', 1)], lambda x: x <> ''))) AS n_images,
  coalesce(sum(nullif(regexp_extract(line, '!\[[^\]]*\]\((?:[^()\s]*/)?slides/(\d{1,4})\.(?:jpg|png)\)', 1), '')::BIGINT), 0) AS image_sum FROM n WHERE s > 0 GROUP BY conv_id, s),
f AS (SELECT *, CASE WHEN regexp_matches(first_line, '^\s*\*[^*].*\*\s*$') THEN first_line END AS tl FROM g),
p AS (SELECT *, regexp_extract(tl, '(\d{1,2}(?::\d{2}){1,2})\s*[-–—~]\s*(\d{1,2}(?::\d{2}){1,2})', ['a', 'b']) AS r, regexp_extract_all(regexp_extract(tl, '(?i)slides?\s*[:：]?\s*((?:\d{1,4}\s*[,，、]?\s*)+)', 1), '\d+') AS sl FROM f)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY head_idx)::INT AS ord, trim(title) AS title, head_idx::INT AS head_idx, end_idx::INT AS end_idx, CASE WHEN r.a <> '' THEN """ + SECONDS.format("r.a") + r""" END AS t_from,
 CASE WHEN r.a <> '' THEN """ + SECONDS.format("r.b") + r""" END AS t_to, coalesce(array_to_string([x::INT FOR x IN sl], ','), '') AS pages, n_images::INT AS n_images, image_sum::BIGINT AS image_sum FROM p""")
def markdown_sections(spark, sf_dir):
    s = markup.sections(markdown_lines(spark, sf_dir), key=["conv_id"])
    pages = F.aggregate("images", F.lit(0).cast("long"), lambda a, x: a + x["page"])
    return s.select("conv_id", "ord", "title", "head_idx", "end_idx", F.col("raw_time.a").alias("t_from"), F.col("raw_time.b").alias("t_to"), F.array_join("raw_slides", ",").alias("pages"), F.size("images").alias("n_images"), pages.alias("image_sum"))


@query("WITH " + LINES + r""", h AS (SELECT *, regexp_matches(line, '^##\s+\[(\d{1,2}(?::\d{2}){1,2})\]') AS head FROM ln), n AS (SELECT *, sum(head::INT) OVER (PARTITION BY conv_id ORDER BY i) AS s FROM h),
g AS (SELECT conv_id, s, min(i) AS head_no, any_value(line) FILTER (head) AS hl, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT head), '') AS body FROM n WHERE s > 0 GROUP BY conv_id, s)
SELECT conv_id, head_no::INT AS head_no, """ + SECONDS.format(r"regexp_extract(hl, '\[([0-9:]+)\]', 1)") + r""" AS t, trim(regexp_extract(hl, '\]\s*(.*)$', 1)) AS title, sha256(trim(body, ' ')) AS body FROM g""")
def anchored_sections(spark, sf_dir):
    s = markup.anchored_sections(markdown_lines(spark, sf_dir), key=["conv_id"])
    return s.select("conv_id", "head_no", "t", "title", F.sha2("body", 256).alias("body"))


@query("WITH " + LINES + r""", q AS (SELECT *, regexp_matches(line, '^\s*>') AS q FROM ln), b AS (SELECT *, sum(CASE WHEN q = before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM (SELECT *, lag(q) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM q)),
k AS (SELECT conv_id, b, bool_or(contains(line, 'note')) AS has, sum(regexp_matches(line, '^\s*>\s*(?:[-*+]|\d+[.)])\s+\S')::INT) AS items FROM b WHERE q GROUP BY conv_id, b)
SELECT conv_id, coalesce(sum(greatest(items, 1)) FILTER (has), 0)::BIGINT AS annotations FROM md LEFT JOIN k USING (conv_id) GROUP BY conv_id""")
def annotation_counts(spark, sf_dir):
    return markup.annotation_count(markdown_lines(spark, sf_dir), key=["conv_id"], marker="note")


@query("WITH " + MD + r""", m AS (SELECT conv_id, unnest(regexp_extract_all(md, '!\[[^\]\n]*\]\((?:[^()\s]*/)?(?:slides|sheets|figures)/[^()\s/]+\)')) AS r, unnest(range(len(regexp_extract_all(md, '!\[[^\]\n]*\]\((?:[^()\s]*/)?(?:slides|sheets|figures)/[^()\s/]+\)')))) AS ord FROM md),
p AS (SELECT conv_id, ord, regexp_extract(r, '\((.*)\)$', 1) AS target, regexp_extract(r, '(slides|sheets|figures)/([^()\s/]+)\)$', 1) AS kind, regexp_extract(r, '/([^()\s/]+)\)$', 1) AS name FROM m)
SELECT conv_id, ord::INT AS ord, target, kind, CASE WHEN kind = 'slides' AND regexp_matches(name, '^\d+(\.\w+)?$') THEN lpad(regexp_extract(name, '^\d+'), 4, '0') || CASE WHEN contains(name, '.') THEN regexp_extract(name, '\.\w+$') ELSE '.jpg' END ELSE name END AS canonical,
 CASE kind WHEN 'slides' THEN regexp_matches(name, '^\d{1,4}\.(jpg|png)$') WHEN 'sheets' THEN regexp_matches(name, '^sheet_\d+\.(jpg|png)$') ELSE regexp_matches(name, '^fig_\d+\.(jpg|png)$') END AS allowed FROM p""")
def picture_references(spark, sf_dir):
    r = markup.picture_references(spread(markdown(spark, sf_dir)), key=["conv_id"], text="md")
    return r.select("conv_id", "ord", "target", "kind", "canonical", "allowed")


@query("WITH " + LINES + r""", d AS (SELECT conv_id, i, CASE WHEN NOT fenced AND regexp_matches(line, '^#{1,5}\s') THEN '#' || line ELSE line END AS line, fenced FROM fn)
SELECT conv_id, i::INT AS line_no, length(regexp_extract(line, '^#+')) AS level, trim(regexp_replace(line, '^#+\s+', '')) AS title FROM d WHERE NOT fenced AND regexp_matches(line, '^#{1,6}\s+\S')""")
def demoted_headings(spark, sf_dir):
    lines = markup.demoted(markdown_lines(spark, sf_dir), key=["conv_id"])
    return markup.headings(lines, key=["conv_id"]).select("conv_id", "line_no", "level", "title")


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq, turn * 5.0 AS t_from, turn * 5.0 + 2.5 AS t_to FROM conversations""")
def srt_cues(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    stamp = lambda s, ms: F.concat(times.hms(s), F.lit("," + ms))
    cue = F.concat(F.lit("1\n"), stamp(F.col("turn") * 5, "0"), F.lit(" --> "), stamp(F.col("turn") * 5 + 2, "5"), F.lit("\nx"), F.regexp_replace("text", r"\s+", " "), F.lit("\n"))
    srt = assemble.joined_lines(c, key=["conv_id"], order=["turn", "role", "text"], line=cue, out="srt")
    return markup.srt_cues(spread(srt), key=["conv_id"], text="srt").select("conv_id", "seq", "t_from", "t_to")


# --- assembly -----------------------------------------------------------------------------------------------------


@query("""SELECT conv_id, string_agg('[' || printf('%02d:%02d:%02d', (turn * 60 // 3600)::INT, (turn % 60)::INT, 0) || '] ' || text, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id""")
def transcript_md(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("t", F.col("turn") * 60)
    return assemble.transcript(c, key=["conv_id"], order=["turn", "role", "text"], time="t", text="text")


@query("""SELECT o_custkey, count(*) AS count, sha256('orders/1' || chr(10) || string_agg(o_orderkey || '|' || o_orderstatus || '|' || (o_totalprice * 100)::BIGINT, chr(10) ORDER BY o_orderkey)) AS digest FROM orders GROUP BY o_custkey""")
def canonical_digest(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return assemble.canonical_digest(o, key=["o_custkey"], order=["o_orderkey"], fields=[F.col("o_orderkey"), F.col("o_orderstatus"), F.bround(F.col("o_totalprice") * 100).cast("long")], version="orders/1")


@query("""SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey""")
def markdown_tables(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return assemble.markdown_table(n, key=["n_regionkey"], order=["n_nationkey"], columns=[("key", F.col("n_nationkey")), ("name", F.col("n_name"))])


@query("""SELECT n_regionkey, string_agg(k || '. ' || n_name || ' (' || printf('%02d:%02d', n_nationkey, 0) || '–' || printf('%02d:%02d', n_nationkey + 1, 0) || ')', chr(10) ORDER BY n_nationkey) AS text FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) GROUP BY n_regionkey""")
def outlines(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), (F.col("n_nationkey") * 60).alias("t_start"), (F.col("n_nationkey") * 60 + 60).alias("t_end"))
    return assemble.outline(n, key=["n_regionkey"])


@query("""WITH k AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part WHERE p_size > 5)
SELECT p_partkey, n + 1 AS "index", n // 12 + 1 AS sheet, n % 12 // 3 + 1 AS tile_row, n % 3 + 1 AS tile_col FROM k""")
def tile_map(spark, sf_dir):
    return assemble.tile_map(table(spark, sf_dir, "part"), key=["p_brand"], order=["p_partkey"], blank=F.col("p_size") <= 5).select("p_partkey", "index", "sheet", "tile_row", "tile_col")


@query("""WITH p AS (SELECT page_id, strlen(url) AS n FROM pages)
SELECT page_id, n + 5 AS bytes, true AS whole, true AS ordered FROM p""")
def clipboard_offsets(spark, sf_dir):
    """The byte offsets in a clipboard's head, tried out on its own bytes."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", assemble.clipboard_html(F.concat(F.lit("é<b>"), "url"), F.lit("http://ü")).alias("h"))
    at = lambda n: F.regexp_extract("h", rf"{n}:(\d{{10}})", 1).cast("long")
    part = lambda a, b: F.substring(F.col("h").cast("binary"), at(a) + 1, at(b) - at(a)).cast("string")
    whole = (part("StartFragment", "EndFragment") == F.concat(F.lit("é<b>"), "url")) & part("StartHTML", "EndHTML").startswith("<html>") & part("StartHTML", "EndHTML").endswith("</html>")
    ordered = (at("StartHTML") < at("StartFragment")) & (at("EndFragment") < at("EndHTML")) & (at("EndHTML") == F.octet_length("h"))
    return p.select("page_id", (at("EndFragment") - at("StartFragment")).alias("bytes"), whole.alias("whole"), ordered.alias("ordered"))


@query("""SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, '; ' ORDER BY l_linenumber, l_returnflag) AS messages FROM lineitem GROUP BY l_orderkey""")
def joined_messages(spark, sf_dir):
    line = F.concat_ws(":", "l_linenumber", "l_returnflag")
    return assemble.joined_lines(table(spark, sf_dir, "lineitem"), key=["l_orderkey"], order=["l_linenumber", "l_returnflag"], line=line, separator="; ", out="messages")


@query("""SELECT n_nationkey, replace(replace('{{name}} in {{region}}', '{{name}}', n_name), '{{region}}', n_regionkey::VARCHAR) AS text FROM nation""")
def templates(spark, sf_dir):
    values = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", assemble.filled_template(F.lit("{{name}} in {{region}}{{none}}"), values).alias("text"))


# --- folds --------------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k FROM conversations),
r AS (SELECT conv_id, turn, k, size, 1 AS chunk, size AS filled FROM o WHERE k = 1
 UNION ALL SELECT o.conv_id, o.turn, o.k, o.size, CASE WHEN filled + o.size > 1500 AND filled >= 750 THEN chunk + 1 ELSE chunk END, CASE WHEN filled + o.size > 1500 AND filled >= 750 THEN o.size ELSE filled + o.size END FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)
SELECT conv_id, turn, size, chunk FROM r""")
def greedy_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("size", F.length("text"))
    return folds.greedy_chunks(c, key=["conv_id"], order=["turn", "size"], size="size", cap=1500)


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, event_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM ev),
r AS (SELECT user_id, event_id, t, k, t AS last, true AS picked FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.event_id, o.t, o.k, CASE WHEN o.value > 60 AND o.t - last >= 86400 THEN o.t ELSE last END, o.value > 60 AND o.t - last >= 86400 FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, event_id, t FROM r WHERE picked""")
def distance_picks(spark, sf_dir):
    return folds.spaced_picks(events(spark, sf_dir), key=["user_id"], time="t", tie=["event_id"], value="value", threshold=60, apart=86400)


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS size, greatest(length(text), 30) AS w, CASE WHEN turn % 3 = 0 THEN turn * 20 END AS anchor, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS k FROM conversations),
h AS (SELECT *, k = 1 OR (anchor IS NOT NULL AND (before IS NULL OR anchor > before + 1)) AS head FROM (SELECT *, lag(anchor) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM o)),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY conv_id ORDER BY k) AS g FROM h),
p AS (SELECT g.*, sum(w) OVER (PARTITION BY conv_id, g) AS total, k = max(k) OVER (PARTITION BY conv_id, g) AS final, heads FROM g JOIN (SELECT conv_id, list({'k': k, 'a': anchor} ORDER BY k) AS heads FROM g WHERE head GROUP BY conv_id) USING (conv_id)),
s AS (SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS turn, 0::BIGINT AS size, 0::BIGINT AS f, 0::BIGINT AS l, 0::BIGINT AS a, 0::BIGINT AS z FROM (SELECT DISTINCT conv_id FROM o)
 UNION ALL SELECT conv_id, k, turn, size, f, l, a, CASE WHEN final THEN least(greatest(l, a + 1), greatest(l, a)) ELSE least(greatest(a + greatest(1, round_even((l - f) * w / total, 0)::BIGINT), a + 1), greatest(l, a)) END
 FROM (SELECT *, CASE WHEN head THEN f ELSE sz END AS a FROM (SELECT *, CASE WHEN head THEN greatest(least(coalesce(list_filter(heads, lambda x: x.k > k AND x.a > f + 1)[1].a, 600), 600), f + 1) ELSE sl END AS l
  FROM (SELECT p.*, s.l AS sl, s.z AS sz, CASE WHEN NOT head THEN s.f WHEN anchor IS NOT NULL AND anchor >= s.l THEN anchor ELSE s.l END AS f FROM s JOIN p ON p.conv_id = s.conv_id AND p.k = s.k + 1))))
SELECT conv_id, turn, size, a AS range_from, z AS range_to FROM s WHERE k > 0""")
def proportional_ranges(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"), F.when(F.col("turn") % 3 == 0, F.col("turn") * 20).alias("anchor"), F.lit(0).alias("a"), F.lit(600).alias("z"))
    return folds.proportional_ranges(c, key=["conv_id"], order=["turn", "size"], anchor="anchor", weight="size", start="a", end="z")


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, text, turn * 5 AS a, turn * 5 + length(text) % 5 AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (SELECT conv_id, k, turn, text, a, b, a AS first, b AS last, 1 AS p FROM o WHERE k = 1
 UNION ALL SELECT o.conv_id, o.k, o.turn, o.text, o.a, o.b, CASE WHEN o.a - r.last < 1.2 AND o.b - r.first <= 12 THEN r.first ELSE o.a END, o.b, CASE WHEN o.a - r.last < 1.2 AND o.b - r.first <= 12 THEN r.p ELSE r.p + 1 END FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1),
m AS (SELECT conv_id, p, min(a) AS t_start, max(b) AS t_end, min(turn) AS seg_from, max(turn) AS seg_to, string_agg(text, '' ORDER BY k) AS text FROM r GROUP BY conv_id, p),
q AS (SELECT *, sum(CASE WHEN p = 1 OR length(regexp_replace(text, '\\s+', '', 'g')) >= 400 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS id FROM m)
SELECT conv_id, id, min(t_start) AS t_start, max(t_end) AS t_end, min(seg_from) AS seg_from, max(seg_to) AS seg_to, string_agg(text, '' ORDER BY p) AS text, length(regexp_replace(string_agg(text, '' ORDER BY p), '\\s+', '', 'g')) AS chars FROM q GROUP BY conv_id, id""")
def paragraphs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumns({"t0": F.col("turn") * 5.0, "t1": F.col("turn") * 5.0 + F.length("text") % 5})
    return folds.paragraphs(c, key=["conv_id"], order="turn", start="t0", end="t1", text="text", span=12.0, short=400)


@query(f"""WITH RECURSIVE {HASHES}, o AS (SELECT label, vec_id AS id, vec_id * 5.0 AS t_start, vec_id * 5.0 + 5 AS t_end, vec_id % 7 AS score, h, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM h),
r AS (SELECT label, k, 1 AS s, id, t_start, t_end, 10 AS n_frames, score, h, []::BIGINT[] AS merged, '' AS why FROM o WHERE k = 1
 UNION ALL SELECT label, k, CASE WHEN same THEN s ELSE s + 1 END, CASE WHEN same AND NOT better THEN rid ELSE id END, CASE WHEN same THEN least(rs, t_start) ELSE t_start END, CASE WHEN same THEN greatest(re, t_end) ELSE t_end END,
  CASE WHEN same THEN rn + 10 ELSE 10 END, CASE WHEN same AND NOT better THEN rscore ELSE score END, CASE WHEN same AND NOT better THEN rh ELSE h END,
  CASE WHEN NOT same THEN []::BIGINT[] WHEN better THEN list_concat([rid], rm) ELSE list_append(rm, id) END, CASE WHEN same THEN 'hash' ELSE '' END
  FROM (SELECT o.*, r.s, r.id AS rid, r.t_start AS rs, r.t_end AS re, r.n_frames AS rn, r.score AS rscore, r.h AS rh, r.merged AS rm, o.score > r.score AS better,
    bit_count(xor(r.h, o.h)) <= 26 AND greatest(r.t_end, o.t_end) - least(r.t_start, o.t_start) <= 240 AS same FROM r JOIN o ON o.label = r.label AND o.k = r.k + 1))
SELECT label, row_number() OVER (PARTITION BY label ORDER BY s)::INT AS id, id::INT AS source_id, t_start::DOUBLE AS t_start, t_end::DOUBLE AS t_end, n_frames, score::DOUBLE AS score, h AS dhash, array_to_string(merged, ',') AS merged_from, why AS merge_reason
FROM (SELECT *, k = max(k) OVER (PARTITION BY label, s) AS final FROM r) WHERE final""")
def merged_segments(spark, sf_dir):
    h = sign_hashes(spark, sf_dir).select("label", F.col("vec_id").cast("int").alias("id"), (F.col("vec_id") * 5.0).alias("t_start"), (F.col("vec_id") * 5.0 + 5).alias("t_end"), F.lit(10).alias("n_frames"), (F.col("vec_id") % 7).cast("double").alias("score"), F.col("h").alias("dhash"), F.lit("").alias("text"))
    return folds.merge_pages(h, key=["label"], hash_limit=26).drop("text").withColumn("merged_from", F.array_join("merged_from", ","))


@query(f"""WITH {DIFFS}, l AS (SELECT user_id, greatest(quantile_cont(diff, 0.85), 1.2 * avg(diff)) AS q, count(*) AS n FROM df GROUP BY user_id),
c AS (SELECT user_id, i, n, n >= 8 AND diff >= q AS cut, i > 0 AND diff <= 20 AS small FROM df JOIN l USING (user_id)),
b AS (SELECT *, max(cut::INT) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near, sum((NOT small)::INT) OVER (PARTITION BY user_id ORDER BY i) AS isl FROM c),
r AS (SELECT user_id, min(i) - 1 AS first FROM b WHERE small GROUP BY user_id, isl HAVING count(*) >= 2),
w AS (SELECT r.*, near = 1 AS near FROM r JOIN b ON b.user_id = r.user_id AND b.i = r.first),
st AS (SELECT user_id, first FROM (SELECT *, bool_or(near) OVER (PARTITION BY user_id) AS any_near FROM w) WHERE near OR NOT any_near),
e AS (SELECT user_id, first AS a FROM st UNION SELECT user_id, 0 FROM l),
x AS (SELECT user_id, a, coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY a), n) AS b, n FROM e JOIN l USING (user_id)),
y AS (SELECT * FROM x WHERE a = 0 OR b - a >= 3)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY a)::INT AS id, a::INT AS i_start, coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY a), n)::INT AS i_end FROM y""")
def axis_segments(spark, sf_dir):
    from ..operators import sequences

    ev = sequences.with_diffs(events(spark, sf_dir), key=["user_id"], order=["t", "event_id"], value="value")
    ev = ev.withColumn("i", F.row_number().over(sequences._ordered(["user_id"], ["t", "event_id"])) - 1)
    return folds.segment_axis(ev, key=["user_id"], fps=1.0, diff_limit=20.0, stable_sec=2.0, look_back_sec=2.0, multiple=1.2, least_sec=3.0)


# --- state and integrity ------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT o_custkey AS c_custkey, o_orderkey AS f, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS seg, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS bal FROM orders)
SELECT c.c_custkey, coalesce(arg_max(seg, f) FILTER (seg <> ''), any_value(c_mktsegment)) AS c_mktsegment, round(coalesce(arg_max(bal, f) FILTER (bal IS NOT NULL), any_value(c_acctbal)), 4) AS c_acctbal FROM customer c LEFT JOIN p USING (c_custkey) GROUP BY c.c_custkey""")
def patch_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("f"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("c_mktsegment"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("c_acctbal"))
    return state.patched(c, p, key=["c_custkey"], order="f", fields=["c_mktsegment", "c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("SELECT user_id, greatest(coalesce(max(CASE WHEN event_id % 2 = 0 THEN event_id % 90 END), 0), count(*)) + 1 AS next_round, greatest(coalesce(max(CASE WHEN event_id % 2 = 0 THEN event_id % 90 END), 0), count(*)) + 1 > 80 AS escalate FROM events GROUP BY user_id")
def round_counter(spark, sf_dir):
    r = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 90).alias("round"))
    return state.next_round(r, key=["user_id"], most=80)


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'missing' WHEN a.q = b.q THEN 'same' ELSE 'changed' END AS state
FROM (SELECT doc_id + 3 AS doc_id, (n_chars > 1500)::INT::VARCHAR AS q FROM documents) a FULL JOIN (SELECT doc_id, quality::VARCHAR AS q FROM labels) b USING (doc_id)""")
def digest_drift(spark, sf_dir):
    was = table(spark, sf_dir, "documents").select((F.col("doc_id") + 3).alias("doc_id"), (F.col("n_chars") > 1500).cast("int").cast("string").alias("digest"))
    now = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("digest"))
    return state.digest_drift(was, now, key=["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def apply_once(spark, sf_dir):
    return state.once_only(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), stamp=["doc_id"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return integrity.duplicates(table(spark, sf_dir, "lineitem"), key=["l_orderkey"], of=["l_linenumber"])


@query("SELECT o_orderkey, o_custkey + 7 AS c_custkey FROM orders WHERE o_custkey + 7 NOT IN (SELECT c_custkey FROM customer)")
def fk_violations(spark, sf_dir):
    """Orders whose customer, seven further on, isn't there."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 7).alias("c_custkey"))
    return integrity.missing(o, table(spark, sf_dir, "customer"), on=["c_custkey"])


@query("""WITH s AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) / 8.64e10 AS a, max(epoch_us(o_orderdate) / 8.64e10 + 30) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM orders)
SELECT o_custkey, o_orderkey FROM s WHERE a < reached - 1""")
def overlaps(spark, sf_dir):
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 8.64e10
    o = table(spark, sf_dir, "orders").withColumns({"a": day, "z": day + 30})
    return integrity.overlapping(o, key=["o_custkey"], order=["o_orderdate", "o_orderkey"], start="a", end="z", tolerance=1.0).select("o_custkey", "o_orderkey")


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, coalesce(lag(turn + 1 + (conv_id + turn) % 3 // 2) OVER (PARTITION BY conv_id ORDER BY turn), 0) + 1 AS e FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE turn + 1 <> e""")
def not_contiguous(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().withColumns({"no": F.col("turn") + 1, "to": F.col("turn") + 1 + F.floor((F.col("conv_id") + F.col("turn")) % 3 / 2)})
    return integrity.not_contiguous(c, key=["conv_id"], order=["turn"], first="no", last="to").select("conv_id", "turn")


@query("""WITH m AS (SELECT user_id, max(event_id % 50) + 1 AS n FROM events GROUP BY user_id), e AS (SELECT user_id, unnest(generate_series(1, n)) AS k FROM m) SELECT user_id, k FROM e EXCEPT SELECT user_id, event_id % 50 FROM events""")
def unused_numbers(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("k"))
    counts = ev.groupBy("user_id").agg((F.max("k") + 1).alias("n"))
    return integrity.unused_numbers(counts, ev, key=["user_id"], count="n", number="k").select("user_id", "k")


@query("""WITH f AS (SELECT conv_id, min(turn) AS f FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT DISTINCT c.conv_id, c.turn FROM conversations c LEFT JOIN f USING (conv_id) WHERE f IS NULL OR turn < f""")
def uncovered(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return integrity.uncovered_ordinals(c.where("role = 'assistant'"), c.select("conv_id", "turn").distinct(), key=["conv_id"], ordinal="turn").select("conv_id", "turn")


@query("""SELECT doc_id, CASE WHEN z.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'differs' END AS state FROM (SELECT doc_id, lang, 1 AS k FROM documents) a
FULL JOIN (SELECT doc_id + 5 AS doc_id, CASE WHEN n_chars > 900 THEN lang ELSE 'xx' END AS lang, 1 AS k FROM documents) z USING (doc_id) WHERE z.k IS NULL OR a.k IS NULL OR a.lang IS DISTINCT FROM z.lang""")
def full_compare(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    right = d.select((F.col("doc_id") + 5).alias("doc_id"), F.when(F.col("n_chars") > 900, F.col("lang")).otherwise("xx").alias("lang"))
    return integrity.full_compare(d, right, on=["doc_id"], columns=["lang"])


@query("""WITH i AS (SELECT CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warning' ELSE 'review' END AS level, 'lang:' || lang AS owner, doc_id FROM labels JOIN documents USING (doc_id))
SELECT owner, string_agg(lpad(doc_id::VARCHAR, 12, '0'), '; ' ORDER BY doc_id) AS messages, count(*) FILTER (level = 'error') AS n_error, count(*) FILTER (level = 'warning') AS n_warning, count(*) FILTER (level = 'review') AS n_review FROM i GROUP BY owner""")
def routing(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    level = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warning").otherwise("review")
    return assemble.routing(both.select(level.alias("level"), F.concat(F.lit("lang:"), "lang").alias("owner"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("message")))


# --- triage -------------------------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT user_id, count(*) AS n, avg(value) AS m, count(DISTINCT event_type) AS k FROM events GROUP BY user_id), v AS (SELECT user_id, (n > 60)::INT * 2 + (m > 50)::INT AS s, (k > 3)::INT + (m < 45)::INT * 2 AS t FROM u)
SELECT user_id, s AS slides, t AS stream, CASE WHEN s - t >= 2 THEN 'slides' ELSE 'stream' END AS suggest, round(least(0.9, 0.4 + 0.15 * abs(s - t)), 4) AS confidence FROM v""")
def evidence_vote(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.count_distinct("event_type").alias("k"))
    evidence = [(F.col("n") > 60, "slides", 2, "busy"), (F.col("m") > 50, "slides", 1, "high"), (F.col("k") > 3, "stream", 1, "varied"), (F.col("m") < 45, "stream", 2, "low")]
    return triage.vote(u, evidence).select("user_id", "slides", "stream", "suggest", F.round("confidence", 4).alias("confidence"))


@query(f"""WITH {EV}, w AS (SELECT user_id, w, 30.0 * 86400 * w AS a FROM (SELECT DISTINCT user_id FROM events), range(3) r(w))
SELECT w.user_id, w.w AS "window", count(ev.event_id) AS n, round(coalesce(sum(ev.value), 0), 3) AS total FROM w LEFT JOIN ev ON ev.user_id = w.user_id AND ev.t >= {DAY_ZERO * 86400} + a AND ev.t < {DAY_ZERO * 86400} + a + 864000 GROUP BY ALL""")
def per_window(spark, sf_dir):
    ev = events(spark, sf_dir)
    users = ev.select("user_id").distinct()
    windows = users.select("user_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("window")).withColumn("orig_from", F.lit(DAY_ZERO * 86400.0) + F.col("window") * 2592000.0).withColumn("orig_to", F.col("orig_from") + 864000)
    held = temporal.in_windows(ev, windows, key=["user_id"], time="t", start="orig_from", end="orig_to", width=864000.0)
    found = held.groupBy("user_id", "window").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windows.join(found, ["user_id", "window"], "left").select("user_id", "window", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 3).alias("total"))
