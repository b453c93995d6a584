"""Boundary cases by hand, folds against plain models, and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempolith.functions import numbers, texts, times
from tempolith.operators import assemble, folds, integrity, markup, pick, sequences, state, temporal, terms, triage, vision
from tempolith.plans import pipelines
from tempolith.sources import artifacts


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_stable_runs_at_the_threshold(spark):
    df = rows(spark, [("a", i, d) for i, d in enumerate([0.0, 0.01, 0.035, 0.2, 0.01])], "vid string, i int, diff double")
    got = sequences.stable_runs(df, key=["vid"], order=["i"], diff="diff", threshold=0.035, fps=2, min_sec=1.0).collect()
    assert [(r.i_start, r.i_end) for r in got] == [(0, 2)]


def test_hard_cuts_need_eight_rows(spark):
    df = rows(spark, [("a", float(i)) for i in range(7)] + [("b", float(i)) for i in range(8)], "vid string, diff double")
    got = sequences.hard_cuts(df, key=["vid"], diff="diff").where("is_cut").collect()
    assert {r.vid for r in got} == {"b"} and sorted(r["diff"] for r in got) == [6.0, 7.0]


def test_hard_cuts_at_their_bounds(spark):
    """Differences that equal a bound but for the last bits of sums and differences are cuts; so the order of rows tells nothing."""
    at_mean = [0.3, 0.1, 0.1, 0.2, 0.2, 0.2, 0.2, 0.3]  # 1.5 times the mean is 0.3
    low, high = 7.1 - 7.0, 0.1  # one value, the first below the second by its last bits or above
    at_quantile = [0.0] * 17 + [min(low, high), max(low, high), 0.2, 0.2]
    data = [("mean", x) for x in at_mean] + [("quantile", x) for x in at_quantile]
    for turned in (data, data[::-1]):
        got = sequences.hard_cuts(rows(spark, turned, "vid string, diff double"), key=["vid"], diff="diff").where("is_cut").collect()
        assert sorted((r.vid, round(r["diff"], 3)) for r in got) == [("mean", 0.3), ("mean", 0.3), ("quantile", 0.1), ("quantile", 0.1), ("quantile", 0.2), ("quantile", 0.2)]


@pytest.mark.parametrize("end, start, split", [(10.9, 12.2, True), (10.1, 11.9, False)])
def test_pauses_in_whole_seconds(spark, end, start, split):
    df = rows(spark, [("a", 1, 9.0, end, "x" * 40), ("a", 2, start, start + 1, "y" * 40)], "vid string, seq int, t_from double, t_to double, text string")
    assert folds.paragraphs(df, key=["vid"], order="seq", start="t_from", end="t_to", text="text").count() == 1 + split


def test_short_paragraphs_join_the_one_before(spark):
    cues = [("a", 1, 0.0, 1.0, "s" * 5), ("a", 2, 10.0, 11.0, "x" * 29), ("a", 3, 20.0, 21.0, "y" * 30)]
    got = folds.paragraphs(rows(spark, cues, "vid string, seq int, t_from double, t_to double, text string"), key=["vid"], order="seq", start="t_from", end="t_to", text="text").orderBy("id").collect()
    assert [(p.seg_from, p.seg_to) for p in got] == [(1, 2), (3, 3)]


@pytest.mark.parametrize("sizes, chunks", [([1000, 2500, 4000], [1, 1, 2]), ([2000, 5000], [1, 1])])
def test_greedy_chunks(spark, sizes, chunks):
    df = rows(spark, [("a", i, s) for i, s in enumerate(sizes)], "vid string, id int, chars int")
    got = folds.greedy_chunks(df, key=["vid"], order=["id"], size="chars", cap=6000).orderBy("id").collect()
    assert [r.chunk for r in got] == chunks


@pytest.mark.parametrize("old, new, want", [((0, 10), [(0, 5), (5, 10)], 1), ((20, 30), [(0, 5), (40, 50)], 1), ((5, 10), [(0, 5), (10, 12)], 1)])
def test_overlap_ties_and_fallback(spark, old, new, want):
    o = rows(spark, [("a", 7, *map(float, old))], "vid string, id int, t_start double, t_end double")
    n = rows(spark, [("a", k + 1, *map(float, x)) for k, x in enumerate(new)], "vid string, new_id int, t_start double, t_end double")
    got = temporal.best_overlap(o, n, key=["vid"], old_id="id", new_id="new_id", width=4.0).collect()
    assert [r.new_id for r in got] == [want]


def test_nearest_is_inclusive_and_first(spark):
    l = rows(spark, [("a", 1, 10.0), ("a", 2, 20.0), ("b", 3, 1.0)], "vid string, id int, t double")
    r = rows(spark, [("a", 1, 7.0), ("a", 2, 13.0), ("a", 3, 23.0)], "vid string, seq int, c double")
    got = {x.id: x.seq for x in temporal.nearest(l, r, key=["vid"], left_time="t", left_id="id", right_time="c", right_id="seq", within=3.0).collect()}
    assert got == {1: 1, 2: 3, 3: None}


def test_piecewise_map(spark):
    s = rows(spark, [("a", 0, 10.0, 40.0, 0.0, 30.0), ("a", 1, 100.0, 130.0, 30.0, 60.0)], artifacts.SCHEMAS["sample_sections"])
    p = rows(spark, [("a", 30.0), ("a", 29.5), ("a", 70.0), ("a", -1.0)], "vid string, t double")
    got = {r.t: (r.window, r.orig) for r in temporal.piecewise(p, s, key=["vid"], time="t").collect()}
    assert got == {30.0: (1, 100.0), 29.5: (0, 39.5), 70.0: (1, 140.0), -1.0: (0, 10.0)}


def test_window_plan_of_short_entities(spark):
    d = rows(spark, [("a", 20.0), ("b", 100.0)], "vid string, duration double")
    got = temporal.window_plan(d, key=["vid"]).orderBy("vid", "window").collect()
    assert [(r.vid, r.orig_from, r.orig_to) for r in got][:1] == [("a", 0.0, 20.0)]
    b = [(r.orig_from, r.orig_to) for r in got if r.vid == "b"]
    assert all(x[1] <= y[0] for x, y in zip(b, b[1:])) and b[-1][1] <= 100


def test_coverage_and_verdicts(spark):
    s = rows(spark, [("a", 10.0, 40.0, 100.0)], "vid string, a double, z double, d double")
    assert sequences.coverage(s, key=["vid"], start="a", end="z", duration="d").first().max_uncovered == 60.0
    v = rows(spark, [("a", 79.0, 100.0), ("b", 80.0, 100.0), ("c", 121.0, 100.0), ("d", 5.0, None)], "vid string, z double, d double")
    assert [r.verdict for r in sequences.caption_verdict(v, key=["vid"], end="z", duration="d").orderBy("vid").collect()] == ["partial", "accepted", "beyond end", "unmeasured"]


def test_event_pairing(spark):
    ev = rows(spark, [("a", 1, "s", 5.0), ("a", 2, "s", 8.0), ("a", 3, "e", 9.0), ("a", 4, "s", 20.0), ("a", 5, "x", 21.0)], "vid string, n int, kind string, t double").withColumn("d", F.lit(25.0))
    got = sequences.paired_events(ev, key=["vid"], order=["n"], time="t", kind="kind", opening="s", closing="e", duration="d").orderBy("t_from").collect()
    assert [(r.t_from, r.t_to) for r in got] == [(5, 8), (8, 9), (20, 25)]


def test_text_functions(spark):
    lit = F.lit
    r = one(
        spark,
        texts.gram_containment(texts.grams(lit("abc")), texts.grams(lit("abcdef"))).alias("short"),
        texts.within_one_edit(lit("RG"), lit("RAG")).alias("near"),
        texts.within_one_edit(lit("RB"), lit("RAG")).alias("far"),
        texts.time_range_of(lit("*01:02–1:00:03 ｜ slide 0004, 0005*")).alias("range"),
        texts.slide_numbers(lit("*01:02–1:00:03 ｜ slides 0004, 0005*")).alias("slides"),
        texts.unknown_targets(lit("![a](slides/0001.jpg) ![b](x/y.png) ![c](x/y.png)")).alias("unknown"),
        texts.reference_name(lit("slides"), lit("7")).alias("name"),
        texts.clip(lit("abcdef"), 4).alias("clip"),
        texts.table_pairs(lit("| a | b | c |")).alias("pair"),
        texts.without_marks(lit("a_b é-ü!")).alias("bare"),
    )
    assert (r.short, r.near, r.far) == (0.0, True, False)
    assert (r.range.a, r.range.b) == (62, 3603) and r.slides == [4, 5] and r.unknown == ["x/y.png"]
    assert (r.name, r.clip, (r.pair.left, r.pair.right), r.bare) == ("0007.jpg", "abc…", ("a", "b"), "abéü")


def test_times_and_numbers(spark):
    lit = F.lit
    r = one(
        spark,
        times.hms(lit(3599.9)).alias("cut"),
        times.hms_rounded(lit(3599.9)).alias("round"),
        times.hms(lit(-5.0)).alias("neg"),
        times.seconds_of(lit("1:00:03")).alias("s"),
        times.from_parts(lit("0"), lit("1"), lit("2"), lit("5")).alias("ms"),
        times.section_offset(lit("*00:10:00-00:20:00")).alias("off"),
        numbers.hamming(lit(-1).cast("long"), lit(0).cast("long")).alias("ham"),
        numbers.ratio_of(lit("30/0")).alias("r0"),
        numbers.ratio_of(lit("30000/1001")).alias("r1"),
        numbers.rounded3(lit("x")).alias("x"),
        numbers.box_pixels(F.array(lit(0.999), lit(0.0), lit(1.0), lit(0.001)), lit(100), lit(50)).alias("px"),
        numbers.boxes_key(F.array(F.array(lit(0.1), lit(0.2)), F.array(lit(0.3), lit(0.4)))).alias("k1"),
        numbers.boxes_key(F.array(F.array(lit(0.3), lit(0.4)), F.array(lit(0.1000001), lit(0.2)))).alias("k2"),
    )
    assert (r.cut, r.round, r.neg, r.s, r.ms, r.off) == ("00:59:59", "01:00:00", "00:00:00", 3603, 62.5, 600)
    assert r.ham == 64 and r.r0 == 0 and abs(r.r1 - 29.97003) < 1e-4 and r.x == 0 and r.px == [99, 0, 100, 1] and r.k1 == r.k2
    with pytest.raises(Exception, match="not a time"):
        spark.range(1).select(times.strict_seconds_of(lit("1h"))).collect()


def test_anchor_coverage(spark):
    items = rows(spark, [("a", i) for i in (1, 2, 3, 4)], "vid string, id int")
    anchors = lambda *x: rows(spark, [("a", i) for i in x], "vid string, id int")
    assert integrity.uncovered_ordinals(anchors(1, 3), items, key=["vid"], ordinal="id").count() == 0
    assert [r.id for r in integrity.uncovered_ordinals(anchors(2), items, key=["vid"], ordinal="id").collect()] == [1]


def test_annotations(spark):
    md = "> NOTE x\n> - a\n> - b\n> 1. c\n\n> NOTE\n\n> - none"
    lines = markup.lines_of(rows(spark, [("a", md)], "vid string, md string"), key=["vid"], text="md")
    assert markup.annotation_count(lines, key=["vid"], marker="NOTE").first().annotations == 4


def test_rounds_and_patches(spark):
    r = rows(spark, [("o", None), ("o", None)], "owner string, round int")
    assert tuple(state.next_round(r, key=["owner"]).first()) == ("o", 3, True)
    base = rows(spark, [("a", "01", "t", ["x"]), ("a", "02", "u", ["y"])], "vid string, id string, title string, tags array<string>")
    patches = rows(spark, [("a", "01", "p1", "new", []), ("a", "01", "p2", "newer", None), ("a", "02", "p1", "", ["z"]), ("a", "09", "p1", "q", None)], "vid string, id string, f string, title string, tags array<string>")
    got = {r.id: (r.title, r.tags) for r in state.patched(base, patches, key=["vid", "id"], order="f", fields=["title", "tags"]).collect()}
    assert got == {"01": ("newer", ["x"]), "02": ("u", ["z"])}
    assert [r.id for r in state.unknown_patches(base, patches, key=["vid", "id"]).collect()] == ["09"]


def test_votes_need_a_margin(spark):
    df = rows(spark, [("a", 2, 1), ("b", 3, 1)], "vid string, s int, t int")
    evidence = [(F.col("s") >= 2, "slides", 2, "s2"), (F.col("s") >= 3, "slides", 1, "s3"), (F.col("t") >= 1, "stream", 1, "t1")]
    got = {r.vid: (r.suggest, r.reasons) for r in triage.vote(df, evidence).collect()}
    assert got == {"a": ("stream", ["s2", "t1"]), "b": ("slides", ["s2", "s3", "t1"])}


def test_digest_ignores_arrival(spark):
    data = [("a", i, f"x{i}") for i in range(20)]
    digest = lambda d: assemble.canonical_digest(rows(spark, d, "vid string, id int, x string").repartition(3), key=["vid"], order=["id"], fields=[F.col("id"), F.col("x")], version="v").first().digest
    assert digest(data) == digest(random.Random(1).sample(data, 20)) != digest(data[:-1])


def model_ranges(sections, start, end, least=30):
    """A plain model: walk the groups, hand out whole seconds."""
    groups, out, at = [], [], start
    for k, (anchor, _) in enumerate(sections):
        before = sections[k - 1][0] if k else None
        if k == 0 or (anchor is not None and (before is None or anchor > before + 1)):
            groups.append([])
        groups[-1].append(k)
    for g, members in enumerate(groups):
        anchor = sections[members[0]][0]
        low = anchor if anchor is not None and anchor >= at else at
        high = next((sections[m[0]][0] for m in groups[g + 1 :] if sections[m[0]][0] > low + 1), end)
        high = max(min(high, end), low + 1)
        weights = [max(sections[k][1], least) for k in members]
        c = low
        for j, w in enumerate(weights):
            to = high if j == len(weights) - 1 else min(max(c + max(1, round((high - low) * w / sum(weights))), c + 1), max(high, c))
            to = min(max(to, c + 1), max(high, c))
            out.append((c, to))
            c = to
        at = high
    return out


def test_proportional_ranges_against_a_model(spark):
    rnd = random.Random(7)
    data, want = [], {}
    for v in range(25):
        t, sections = 0, []
        for _ in range(rnd.randint(1, 8)):
            t += rnd.choice([0, 0, 5, 60])
            sections.append((rnd.choice([t, t, None]), rnd.randint(0, 200)))
        end = t + rnd.randint(5, 100)
        want[v] = model_ranges(sections, 0, end)
        data += [(v, k, a, w, 0, end) for k, (a, w) in enumerate(sections)]
    got = folds.proportional_ranges(rows(spark, data, "vid int, ord int, anchor int, w int, a int, z int"), key=["vid"], order=["ord"], anchor="anchor", weight="w", start="a", end="z").orderBy("vid", "ord").toPandas()
    for v, spans in want.items():
        mine = got[got.vid == v]
        assert list(zip(mine.range_from, mine.range_to)) == spans
        assert all(a[1] == b[0] or a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_pages_merge_with_the_survivor(spark):
    long = "the quick brown fox jumps over the lazy dog"
    data = [("a", 1, 0.0, 10.0, 5, 1.0, 0, long), ("a", 2, 10.0, 20.0, 5, 2.0, 3, long), ("a", 3, 20.0, 30.0, 5, 0.5, 1 << 40, "quick fox"), ("a", 4, 30.0, 300.0, 5, 0.5, -1, "zzzz yyyy xxxx wwww vvvv"), ("a", 5, 300.0, 310.0, 5, 0.1, 5, "")]
    got = folds.merge_pages(rows(spark, data, "vid string, id int, t_start double, t_end double, n_frames int, score double, dhash long, text string"), key=["vid"]).orderBy("id").collect()
    assert [(r.source_id, r.t_start, r.t_end, r.merged_from, r.merge_reason) for r in got] == [(2, 0.0, 30.0, [1, 3], "hash"), (4, 30.0, 300.0, [], ""), (5, 300.0, 310.0, [], "")]


def test_rules_fire_where_they_should(spark):
    s = artifacts.SCHEMAS
    manifests = rows(spark, [("a", "chapters/1", True, 3, 120.0), ("b", "old", True, 0, 10.0)], "vid string, schema string, video_ok boolean, slide_count int, duration double")
    ch = [("a", "01", "T", ["00:00:00", "00:01:00"], [1, 5], "01.md", ["k"], ["q"], [("w", "r", "", "context")], [], [], "n", [([1, 2], 3, "x")], None), ("a", "02", None, ["00:00:30", "0:40"], [2], "02.md", ["k", "l"], ["q"], [], [], [], "n", [], None)]
    chapters = rows(spark, ch, s["chapters"])
    slides = rows(spark, [("a", 1), ("a", 2), ("a", 3)], "vid string, id int")
    cues = rows(spark, [("a", 1, 10.0), ("a", 2, 100.0)], "vid string, seq int, t_from double")
    files = rows(spark, [("a", "chapters/01.md", "![](../slides/0001.jpg) ![](other/x.png)"), ("a", "slides/0002.jpg", "")], "vid string, path string, text string")
    found = integrity.manifest_rules(manifests, chapters, slides, cues, files)
    codes = {(r.vid, r.code, r.chapter) for r in found.collect()}
    assert {("b", "V-02", None), ("b", "V-04", None), ("a", "V-07", "02"), ("a", "V-08", "02"), ("a", "V-11", "02"), ("a", "V-13", "01"), ("a", "V-15", "01"), ("a", "V-18", "01"), ("a", "V-19", "01"), ("a", "V-20", None), ("a", "V-21", None), ("a", "V-30", "01"), ("a", "V-31", "01"), ("a", "V-22", None)} <= codes
    assert not {c for _, c, _ in codes} & {"V-01", "V-03", "V-06", "V-12", "V-32"}
    _, routed = pipelines.checked([found])
    assert routed.where("owner = 'chapter:01'").first().n_error >= 5
    empty_rounds = rows(spark, [], "owner string, result string, round int, agent string, note string, at string")
    queue = pipelines.fix_queue(found, empty_rounds, rows(spark, [("chapter:01", "w", "t")], "owner string, agent string, at string"))
    assert {r.owner: (r.agent, r.next_round) for r in queue.collect()}["chapter:01"] == ("w", 1)


def test_stream_and_note_rules(spark):
    text, paras, chunks = pipelines.stream(rows(spark, [("a", i, i * 10.0, i * 10.0 + 4, "word " * 12) for i in range(1, 31)], artifacts.SCHEMAS["transcript"]), cap=500)
    assert text.count() == 1 and paras.count() == 30 and chunks.agg(F.sum("chars")).first()[0] == 30 * 48
    anchors = paras.select("vid", F.col("id").alias("ord"), F.col("t_start").alias("t")).where("ord > 1 and ord % 2 = 0").unionByName(rows(spark, [("a", 99, 3)], "vid string, ord int, t int"))
    found = integrity.stream_rules(rows(spark, [("a", 200.0)], "vid string, duration double"), paras, anchors, rows(spark, [("a", 0.7, False)], "vid string, coverage double, partial boolean"), rows(spark, [("a", "short")], "vid string, text string"), rows(spark, [("a", "figures/x")], "vid string, path string"), rows(spark, [], "vid string, path string"))
    assert {r.code for r in found.collect()} == {"V-35", "V-36", "V-37-uncovered", "V-38", "V-39", "V-40", "V-43"}
    md = "# Title\n## Head\n## [00:10] One\n- a: x\n- b: y\n## [00:05] Two\n- c: z\n## End"
    lines = markup.lines_of(rows(spark, [("a", md)], "vid string, md string"), key=["vid"], text="md")
    nodes = markup.note_nodes(lines, key=["vid"])
    assert [(r.time, r.title, r.fields) for r in nodes.orderBy("ord").collect()] == [("00:10", "One", {"a": ["x"], "b": ["y"]}), ("00:05", "Two", {"c": ["z"]})]
    heads = markup.headings(lines, key=["vid"]).select("vid", "title")
    rules = integrity.note_rules(nodes, rows(spark, [("a", md, 1000)], "vid string, text string, lecture_chars int"), heads, labels=["a", "b"], required="a", head="Head", tail="Tail")
    assert {r.code for r in rules.collect()} == {"V-44-tail", "V-45-few", "V-46-order", "V-46-required", "V-46-unknown", "V-47-short"}
    assert markup.hooks(nodes, key=["vid"], label="b").first().hook == "y"


def test_tile_rules(spark):
    frames = rows(spark, [("a", f"f{i}", float(i), f"h{i}", 0) for i in range(20)], "vid string, frame string, t double, sha256 string, window int")
    tiles = assemble.tile_map(frames, key=["vid"], order=["t"])
    sheets = tiles.select("vid", "sheet").distinct()
    assert integrity.tile_rules(tiles, frames, sheets).count() == 0
    broken = tiles.withColumn("sha256", F.when(F.col("index") == 3, "x").otherwise(F.col("sha256"))).where("index <> 7")
    assert {r.code for r in integrity.tile_rules(broken, frames, sheets).collect()} == {"V-50-gap", "V-50-hash"}


def test_captions(spark):
    srt = "1\n00:00:01,5 --> 00:00:02.250\nhello\nworld\n\n2\n00:00:03,000 --> 00:00:04,000\n \n\n"
    got = markup.srt_cues(rows(spark, [("a", srt)], "vid string, s string"), key=["vid"], text="s").collect()
    assert [(r.t_from, r.t_to, r.text, r.seq) for r in got] == [(1.5, 2.25, "hello world", 1)]
    js = '{"body": [{"from": 1, "to": 2, "content": "x"}, {"start": 3, "end": 4, "text": " "}, {"start": 5, "end": 6, "text": "y"}]}'
    got = markup.json_cues(rows(spark, [("a", js)], "vid string, s string"), key=["vid"], text="s").orderBy("seq").collect()
    assert [(r.t_from, r.text) for r in got] == [(1.0, "x"), (5.0, "y")]
    r = one(spark, markup.target_of(F.lit("https://x/video/BV1abcdefghi?p=3")).alias("t"), markup.target_of(F.lit("BV1abcdefghi")).alias("u"))
    assert tuple(r.t) == ("BV1abcdefghi", 3) and r.u.page == 1


def test_measurement_logs(spark):
    log = ["frame:0 pts:0 pts_time:0.5", "lavfi.scd.mafd=1.0", "lavfi.scd.score=2.0", "frame:1 pts:1 pts_time:2.5", "lavfi.scd.mafd=3.0", "lavfi.scd.score=9.0", "freeze_start: 1.0", "freeze_end: 2.0", "silence_start: 3.0"]
    lines = rows(spark, [("a", i, x) for i, x in enumerate(log)], artifacts.SCHEMAS["frame_metrics"])
    buckets, events, ratios = pipelines.measure(lines, rows(spark, [("a", 5.0)], "vid string, duration double"))
    assert [(r.s, r["mean"], r.n) for r in buckets.orderBy("s").collect()] == [(0, 1.0, 1), (1, 0.0, 0), (2, 3.0, 1), (3, 0.0, 0), (4, 0.0, 0), (5, 0.0, 0)]
    assert {(r.kind, r.t_from, r.t_to) for r in events.collect()} == {("freeze", 1.0, 2.0), ("silence", 3.0, 5.0), ("cut", 2.5, 2.5)}
    assert tuple(ratios.first()) == ("a", 1, 0.2, 0.4, 4.0 / 6)
    meta = rows(spark, [("a", "my slides PPT", ["x"], 5.0), ("b", "a talk", ["播客 播客", "PPT"], 5.0)], "vid string, title string, tags array<string>, duration double")
    mode = {r.vid: r for r in pipelines.triaged(meta, ratios.withColumn("motion_mean", F.lit(0.01)), lists=["tags"]).collect()}
    # twelve cuts a minute and a word of pages: two points against none; no measurement: at most a half
    assert (mode["a"].slides, mode["a"].stream, mode["a"].suggest, mode["a"].confidence, mode["a"].reasons) == (2, 0, "slides", 0.7, ["words of pages", "many cuts"])
    assert (mode["b"].n_slides, mode["b"].n_stream, mode["b"].slides, mode["b"].stream, mode["b"].suggest, mode["b"].confidence) == (1, 1, 1, 1, "stream", 0.4)
    moving = pipelines.triaged(meta, ratios.withColumn("motion_mean", F.lit(0.06)), lists=["tags"], settings={"cuts_per_min_high": 12.5}).where("vid = 'a'").first()
    assert (moving.slides, moving.stream, moving.reasons) == (1, 1, ["words of pages", "always moving"])


def test_window_verdicts(spark):
    df = rows(spark, [("a", 0, 5.0, 0.0), ("a", 1, 0.2, 0.0), ("a", 2, None, 0.2), ("b", 0, 1.0, 0.0), ("b", 1, 1.0, 0.0)], "vid string, window int, cuts double, motion double")
    judge = lambda **more: {(r.vid, r.window): r.suggest for r in triage.window_verdicts(df, key=["vid"], cuts=F.col("cuts"), motion=F.col("motion"), **more).collect()}
    assert judge() == {}  # a window has one point for pages at most
    assert judge(slides=F.lit(1)) == {("a", 0): "slides", ("a", 1): "stream", ("a", 2): "stream"}
    assert judge(margin=1) == {("a", 0): "slides", ("a", 1): "stream", ("a", 2): "stream"}


def test_roles_follow_their_rules(spark):
    names = vision.FEATURES.replace(" double", "").split(", ")
    page = dict.fromkeys(names, 0.0) | {"std": 0.2, "fg": 0.1, "mode": 0.6, "edge": 0.02, "stroke": 2.0, "content": 0.5, "bands": 6.0, "app_fg": 0.1, "app_bands": 5.0, "app_run": 4.0, "bar_window": 0.5}
    cases = [
        ({}, "layout_grid", 0.74), ({"white": 0.999}, "uniform_frame", 0.6), ({"fg": 0.001}, "uniform_frame", 0.6), ({"std": 0.01}, "uniform_frame", 0.75),
        ({"bar_left": 0.2, "bar_right": 0.2}, "letterbox", 0.75), ({"bar_left": 0.1, "bar_top": 0.15}, "layout_grid", 0.74), ({"bar_left": 0.2, "bar_right": 0.2, "bar_window": 0.1}, "layout_grid", 0.74),
        ({"skin": 0.1, "mode": 0.3}, "face_dominant", 0.65), ({"skin": 0.1}, "layout_weak", 0.3),
        ({"stroke": 16.0, "content": 0.6, "border": 0.3}, "stroke_scale", 0.65), ({"app_fg": 0.03, "app_bands": 13.0, "app_run": 1.5, "bands": 13.0}, "ui_dense_small_text", 0.65),
        ({"app_fg": 0.03, "app_bands": 13.0, "app_run": 0.0}, "layout_grid", 0.74), ({"mode": 0.4}, "layout_weak", 0.3),
    ]
    data = [("a", k, tuple(float((page | more)[n]) for n in names)) for k, (more, *_) in enumerate(cases)]
    df = rows(spark, data, f"vid string, k int, feat struct<{vision.FEATURES.replace(' double', ': double')}>")
    got = {r.k: (r.role.criterion, r.role.confidence) for r in vision.roles(df, key=["vid"]).collect()}
    assert got == {k: (c, x) for k, (_, c, x) in enumerate(cases)}
    regions = rows(spark, [("caption_strip", "ok", [0.0, 0.8, 1.0, 1.0]), ("handwriting", "ok", [0.0, 0.0, 1.0, 1.0]), ("transient_overlay", "ok", [0.0, 0.0, 0.1, 0.1]), ("pip_window", "insufficient", [0.0, 0.0, 0.1, 0.1])], "kind string, applicability string, box array<double>")
    assert [r.kind for r in vision.usable_masks(regions).collect()] == ["caption_strip"]
    screen = np.ones((180, 320), np.float32)
    for y in range(6, 170, 8):
        screen[y : y + 3, 4:300:13] = 0.2
    fg, bands, run, _ = vision.app_screen(screen)
    assert fg < 0.032 and bands >= 12 and run == 1.0
    rates = rows(spark, [("a", 0.05, 0.0)] * 3 + [("a", 0.0, 0.0)] * 6 + [("b", 0.05, 0.05)] * 9 + [("c", 0.05, 0.0)] * 3, "vid string, bottom double, title double")
    assert {r.vid: (r["first"], r["last"]) for r in vision.legacy_caption(rates, key=["vid"]).collect()} == {"a": (23, 27), "b": (None, None), "c": (None, None)}


def test_nearest_is_linear_in_a_key(spark):
    import time

    n = 30_000
    left = spark.range(n).selectExpr("1 AS k", "id AS l", "id * 2.0 AS t")
    right = spark.range(n).selectExpr("1 AS k", "id AS r", "id * 2.0 + 0.5 AS rt")
    began = time.perf_counter()
    got = temporal.nearest(left, right, key=["k"], left_time="t", left_id="l", right_time="rt", right_id="r").agg(F.sum("distance"), F.count("r")).first()
    assert tuple(got) == (0.5 * n, n) and time.perf_counter() - began < 20


def test_slides_from_frames(spark):
    data = []
    for i in range(60):
        page, head = i // 20, i % 20 == 0
        data.append(("a", i, i / 2, f"f{i}", 0.4 if head and i else 0.001, 0.1, 0.01, (1 << (page * 20)) * ((1 << 18) - 1), ("first of all some words", "an unlike second page", "thirdly yet more to read")[page], "full_page"))
    frames = rows(spark, data, "vid string, i int, t double, file string, diff double, ink double, sharp double, dhash long, text string, role string")
    got = pipelines.slides(frames, rows(spark, [("a", 1, 11.0)], "vid string, seq int, t_from double")).orderBy("id").collect()
    assert [(r.t_start, r.t_end) for r in got] == [(0.0, 10.0), (11.0, 20.0), (20.0, 30.0)] and got[1].raw_t_start == 10.0
    windows = rows(spark, [("a", 0, 0.0, 15.0), ("a", 1, 15.0, 30.0)], "vid string, window int, orig_from double, orig_to double")
    assert [r.t for r in pipelines.key_stills(frames, windows).orderBy("window").collect()] == [10.0, 20.0]
    near = pipelines.frames_at(frames, rows(spark, [("a", 1, 10.2)], "vid string, ask int, t double")).first()
    assert (near.i, near.prev_i, near.next_i) == (20, 19, 21)


def test_terms(spark):
    df = rows(spark, [("a", "Spark spark SPARK spark go Go R the"), ("a", "sparc Spark")], "vid string, text string")
    got = {r.term: r["count"] for r in terms.term_counts(df, key=["vid"], text="text", stop=["the"]).collect()}
    assert got == {"Spark": 5, "Go": 2} or got == {"spark": 5, "Go": 2}
    t = rows(spark, [("RG",), ("RB",), ("sparc",), ("Go",)], "term string")
    c = rows(spark, [("RAG",), ("Spark",), ("Ga",)], "canonical string")
    assert {(r.term, r.canonical) for r in terms.edit_variants(t, c).collect()} == {("RG", "RAG"), ("sparc", "Spark")}
    g = rows(spark, [("a", False, ["x", "y"], {"p": "q"}, {})], artifacts.SCHEMAS["glossary"])
    r = terms.reviewed(g, drop=["x"], add=["z"], avoid={"p": "r"}, confirm=True).first()
    assert (r.terms_use, r.terms_avoid, r.confirmed) == (["y", "z"], {"p": "r"}, True)


def test_vision_on_drawn_frames(spark, tmp_path):
    rng = np.random.default_rng(1)
    page = np.ones((108, 192, 3), np.float32)
    for r in range(20, 90, 12):
        page[r : r + 6, 20:170] = 0.1
    grey = vision.grey_of(page)
    small = vision.resized(grey, *vision.SMALL)
    assert abs(small.mean() - grey.mean()) < 1e-4
    assert vision.ink_ratio(np.ones((27, 48), np.float32)) == 0 and vision.ink_ratio(small) > 0
    half = np.where(np.arange(48) < 36, 0.2, 0.8) + rng.uniform(-0.04, 0.04, (27, 48))
    assert abs(vision.ink_ratio(half.astype(np.float32)) - 0.25) < 0.05
    up, down = vision.difference_hash(grey), vision.difference_hash(grey, rising=False)
    assert up & down == 0
    assert vision.largest_block(np.array([[1, 1, 0], [0, 1, 0], [1, 0, 1]])) == 3
    stack = np.tile(rng.random((8, 14)).astype(np.float32) * 0.01 + 0.5, (60, 1, 1))
    stack[30] = rng.random((8, 14))
    assert vision.transient_corner(stack, votes_least=10**6)["frames"] == [30]
    mark = np.tile((np.indices((8, 14)).sum(0) % 2).astype(np.float32), (60, 1, 1))  # the same mark on pages far apart
    assert vision.transient_corner(mark)["verdict"] == "resident" and vision.transient_corner(mark[:40])["verdict"] == "none"
    data = bytearray((page[:, :, ::-1] * 255).astype(np.uint8).tobytes())
    df = spark.createDataFrame([("a", (108, 192, 3, data))], "vid string, image struct<height: int, width: int, nChannels: int, data: binary>")
    sig = vision.with_signatures(df).first().sig
    assert len(sig.small) == 27 * 48 and sig.dhash == up
    roles = vision.roles(vision.with_features(df), key=["vid"]).first()
    assert roles.role.role == "full_page" and roles.role.criterion == "layout_grid"
    frames = spark.createDataFrame([("a", i, f"f{i}", small.ravel().tolist()) for i in range(30)], "vid string, i int, file string, small array<float>")
    assert pipelines.regions(frames).where("kind = 'transient_overlay'").count() == 0


def test_registry_and_settings():
    r = artifacts.Registry()
    r.register("x")(lambda a: a + 1)
    assert r.run("x", 1) == 2 and r.run("x", 1, existing=5) == 5
    with pytest.raises(KeyError):
        r.run("y")
    assert artifacts.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert artifacts.from_environment("TL", {"TL_FRAMES_FPS": "3", "X": "1"}) == {"frames": {"fps": "3"}}
    assert artifacts.coerced("0", True) is False and artifacts.coerced("3", 2) == 3


def test_streaming_matches_batch(spark, tmp_path):
    from tempolith.plans.driver_queries import events
    from tempolith.streaming import windows

    sf = "/root/testdata/sf0.001"
    src = str(tmp_path / "events")
    spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    query = windows.run_stream(stream).writeStream.outputMode("append").format("memory").queryName("runs").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("runs").count()
    ev = sequences.with_diffs(events(spark, sf), key=["user_id"], order=["t", "event_id"], value="value")
    batch = sequences.stable_runs(ev, key=["user_id"], order=["t", "event_id"], diff="diff", threshold=20, min_rows=3)
    last = ev.groupBy("user_id").agg((F.count("*") - 1).alias("i_end"))
    open_ = batch.join(last, ["user_id", "i_end"], "left_semi").count()  # a stream can't tell that a run has ended
    assert got == batch.count() - open_
    query = windows.bucket_stream(stream, key=["event_type"]).writeStream.outputMode("append").format("memory").queryName("buckets").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("buckets").count() > 0


def test_references_lectures_and_front_matter(spark):
    df = rows(spark, [("a", "![x](s/1.jpg) ![y](s/2.jpg)"), ("b", "none")], "vid string, md string")
    m = rows(spark, [("a", "s/1.jpg", "s/2.jpg"), ("a", "s/2.jpg", "s/1.jpg")], "vid string, old string, new string")
    got = {r.vid: r.md for r in markup.rewritten_references(df, m, key=["vid"], text="md").collect()}
    assert got == {"a": "![x](s/2.jpg) ![y](s/1.jpg)", "b": "none"}
    assert one(spark, markup.reference_path(F.lit("out/chapters"), F.lit("../slides/1.jpg")).alias("p")).p == "out/slides/1.jpg"
    md = "# One [00:01:00]\ntext\n## Two\n*00:02:00–00:03:00*\n### Sub [00:02:30]\n```\n# no [00:09:00]\n```\n# Three"
    lines = markup.lines_of(rows(spark, [("a", md)], "vid string, md string"), key=["vid"], text="md")
    assert [(r.t, r.title) for r in markup.lecture_items(lines, key=["vid"]).orderBy("t").collect()] == [(60, "One"), (150, "Sub")]
    front = markup.front_matter(rows(spark, [("a", "---\ntitle: 'T'\ntags: [x, \"y\"]\nmore:\n  - p\n  - q\n---\nbody")], "vid string, t string"), key=["vid"], text="t")
    got = markup.migrated(front, key=["vid"], names={"title": "name", "tags": "labels", "more": "rest", "none": "gone"}).first()
    assert (got["name"], got["labels"], got["rest"], got["gone"]) == (["T"], ["x", "y"], ["p", "q"], [])
    both = markup.registered(rows(spark, [("a", "x")], "vid string, name string"), rows(spark, [("a", "x"), ("a", "y")], "vid string, name string"), key=["vid"])
    assert both.count() == 2


def test_headings_move_down_outside_fences(spark):
    texts = ["\n # a\n## b\n###### c\n#none ", "```\n# in\n```\n# out", "x\n```py\n# in\n```\n# out\n```\n# open", "", None, "# one line"]
    df = rows(spark, list(enumerate(texts)), "k int, t string").select("k", assemble.demoted_text(F.col("t")).alias("t"))
    assert [r.t for r in df.orderBy("k").collect()] == ["## a\n### b\n###### c\n#none", "```\n# in\n```\n## out", "x\n```py\n# in\n```\n## out\n```\n# open", "", None, "## one line"]


def test_overlaps_of_intervals_of_all_lengths(spark):
    rnd = random.Random(5)
    row = lambda i: (rnd.randrange(3), i, a := float(rnd.randrange(4000)), a + rnd.choice([-5.0, 0.0, 1.0, 10.0, 40.0, 41.0, 160.0, 700.0, 3000.0]))
    old, new = [row(i) for i in range(120)], [row(i) for i in range(120)]
    old += [(7, 500, 1.0, 2.0), (0, 501, 9000.0, 9001.0), (0, 502, 20000.0, None)]
    o, n = spark.createDataFrame(old, "c int, o int, a double, z double"), spark.createDataFrame(new, "c int, n int, a double, z double")
    shared = lambda x, y: min(e for e in (x[3], y[3]) if e is not None) - max(x[2], y[2])
    want = {}
    for x in old:
        mine = [y for y in new if y[0] == x[0]]
        over = [(-shared(x, y), y[1]) for y in mine if shared(x, y) > 0]
        if over:
            want[x[1]] = (min(over)[1], -min(over)[0])
        elif mine:
            want[x[1]] = (min((abs(y[2] - x[2]), y[2], y[1]) for y in mine)[2], 0.0)
    spans = {"old_span": ("a", "z"), "new_span": ("a", "z")}
    both = lambda **k: {r.o: (r.n, r.overlap) for r in temporal.best_overlap(o, n, key=["c"], old_id="o", new_id="n", width=10.0, **spans, **k).collect()}
    assert both() == want and both(fall_back=False) == {k: v for k, v in want.items() if v[1] > 0}
    l, r = o.toDF("c", "o", "l_from", "l_to"), n.toDF("c", "n", "r_from", "r_to")
    pairs = [(p.o, p.n) for p in temporal.overlap_pairs(l, r, key=["c"], width=10.0).collect()]
    assert sorted(pairs) == sorted((x[1], y[1]) for x in old for y in new if x[0] == y[0] and shared(x, y) > 0)
    # lengths up to 64 widths make no more copies than that
    assert temporal._placed(o.where("z - a <= 640"), "a", "z", 10.0).groupBy("o").count().agg(F.max("count")).first()[0] <= len(temporal.LEVELS) + 2


def test_rules_of_a_chapter_share_their_passes(spark):
    from tempolith.plans import rule_queries

    plan = rule_queries.manifest_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") <= 8  # each pass over chapters numbers them anew


def test_every_kind_of_chapter_issue_keeps_its_count(spark):
    chapter = {"vid": 1, "id": "01", "title": None, "range": ["00:00:10", "00:00:05"], "slides": [1], "body": "a.md", "keypoints": [], "questions": [], "coverage_notes": "n",
               "corrections": [("x", "y", None), ("", "y", "e"), ("x", "y", "e")], "stage_merges": [([2], 2), ([1], 3), ([1], 1)]}
    form = "vid int, id string, title string, range array<string>, slides array<int>, body string, keypoints array<string>, questions array<string>, coverage_notes string, corrections array<struct<wrong:string,right:string,evidence:string>>, stage_merges array<struct<slides:array<int>,kept:int>>"
    none = {**chapter, "id": "02", "title": "t", "range": None, "corrections": None, "stage_merges": None, "keypoints": None, "body": "b.md"}
    chapters = spark.createDataFrame([tuple(c.values()) for c in (chapter, none)], form)
    text = "![a](slides/0001.jpg) ![b](odd.gif) ![c](slides/0002.jpg) ![c](slides/0002.jpg) ![d](figures/fig_1.png)"
    files = spark.createDataFrame([(1, "chapters/a.md", text), (1, "slides/0001.jpg", "")], "vid int, path string, text string")
    manifests = spark.createDataFrame([(1, "chapters/1", True, 1, 0.0)], "vid int, schema string, video_ok boolean, slide_count int, duration double")
    slides = spark.createDataFrame([(1, 1)], "vid int, id int")
    cues = spark.createDataFrame([], "vid int, seq int, t_from double")
    found = integrity.manifest_rules(manifests, chapters, slides, cues, files).collect()
    own = sorted((r.chapter, r.code, r.detail) for r in found if r.chapter and r.code not in ("V-08", "V-18"))
    assert own == [
        *[("01", "V-07", c) for c in ("keypoints", "questions", "title")], ("01", "V-09", None), *[("01", "V-13", "slides/0002.jpg")] * 2, ("01", "V-15", "odd.gif"), ("01", "V-16", "figures/fig_1.png"),
        *[("01", "V-30", None)] * 2, *[("01", "V-31", None)] * 2, ("01", "V-32", None),
        *[("02", "V-07", c) for c in ("keypoints", "questions", "range")], ("02", "V-11", None), ("02", "V-32", None),
    ]
    assert all(r.owner == f"chapter:{r.chapter}" for r in found if r.chapter)
    assert {(r.code, r.level) for r in found if r.chapter} >= {("V-32", "warning"), ("V-31", "error")}
