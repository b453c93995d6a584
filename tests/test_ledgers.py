"""Caption formats as table functions, and the repair ledger over several rounds."""

import pytest
from pyspark.sql import functions as F

from tempolith.operators import markup, repairs
from tempolith.sources import artifacts, captions, versions

TEXTS = [
    (1, "1\n00:00:01,5 --> 00:00:02.250\nfirst\n second \n\n2\r\n00:00:03,000 --> 00:00:04,000\r\nthird\r\n"),
    (2, "no times at all\n\nnor here"),
    (3, "00:00:01,000 --> 00:00:02,000\n  \n \n1:02:03,4 --> 1:02:04,456 align:left\nlate"),
    (4, ""),
    (5, None),
]


def test_srt_as_table_function_agrees_with_expressions(spark):
    assert captions.register(spark) == ["json_captions", "srt"]
    df = spark.createDataFrame(TEXTS, "k int, body string").withColumn("other", F.lit("kept"))
    df.createOrReplaceTempView("texts")
    got = spark.sql("SELECT * FROM srt(TABLE(texts), 'body')")
    assert got.columns == ["k", "other", "seq", "t_from", "t_to", "text"]
    rows = sorted((r.k, r.seq, round(r.t_from, 3), round(r.t_to, 3), r.text) for r in got.collect())
    assert rows == sorted((r.k, r.seq, round(r.t_from, 3), round(r.t_to, 3), r.text) for r in markup.srt_cues(df, key=["k"], text="body").collect())
    assert [r[0] for r in rows] == [1, 1, 3] and rows[0][4] == "first second"
    assert spark.sql("SELECT k, count(*) AS n FROM srt(TABLE(SELECT k, body FROM texts WHERE k < 2), 'body') GROUP BY k").collect()[0].n == 2
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM srt(TABLE(texts), 'title')").collect()


def test_json_captions(spark):
    captions.register(spark)
    texts = ['{"body": [{"from": 1, "to": 2.5, "content": " a "}, {"from": 3, "to": 4, "content": " "}]}', '{"segments": [{"start": 0, "end": 1, "text": "b"}]}', '{"body": []}', "[1]", "not json", None, '{"other": 1}']
    spark.createDataFrame(list(enumerate(texts)), "k int, body string").createOrReplaceTempView("jsons")
    got = spark.sql("SELECT * FROM json_captions(TABLE(jsons), 'body')").collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1.0, 2.5, "a"), (1, 1, 0.0, 1.0, "b")]


def test_a_format_of_ones_own(spark):
    formats = artifacts.Registry()

    @formats.register("lyrics")
    def lyrics(text):
        for line in text.splitlines():
            at, _, words = line.partition(" ")
            yield float(at), None, words

    assert captions.register(spark, formats) == ["lyrics"]
    spark.createDataFrame([(7, "1.5 la\n2.5 \n3 la la")], "k int, body string").createOrReplaceTempView("songs")
    assert [tuple(r) for r in spark.sql("SELECT * FROM lyrics(TABLE(songs), 'body') ORDER BY seq").collect()] == [(7, 1, 1.5, None, "la"), (7, 2, 3.0, None, "la la")]


def test_repair_rounds(spark):
    pages = spark.createDataFrame([(1, k, f"p{k}") for k in range(1, 7)], "vid int, id int, frame string")
    rows = [
        (1, 1, "p1", 9.0, 0.0, 0.0), (1, 1, "a", 3.0, 0.01, 0.5), (1, 1, "b", 2.0, 0.005, 0.5), (1, 1, "c", 1.0, 0.001, 0.0),
        (1, 2, "d", 1.0, 0.5, 0.5), (1, 3, "e", 1.0, 0.0, 0.5), (1, 5, "f", None, None, None), (1, 6, "g", 1.0, 0.0, 0.5),
    ]
    candidates = spark.createDataFrame(rows, "vid int, id int, frame string, score double, out_mean double, in_rms double")
    hits = lambda *f: spark.createDataFrame([(1, x) for x in f], "vid int, frame string")
    ledger = versions.VersionedTable(spark, versions.fresh_folder(spark, "repairs"))

    def told(number):
        return {r.id: (r.verdict, r.source, r.n_candidates, r.n_clean, r.n_tried) for r in ledger.read(number).collect()}

    assert repairs.repair_round(ledger, pages, candidates, hits("p1", "p2", "p3", "p4", "p5", "e")) == 1
    assert told(1) == {1: ("applied", "b", 3, 3, 3), 2: ("skipped", None, 1, 1, 1), 3: ("all_occluded", None, 1, 0, 0), 4: ("all_occluded", None, 0, 0, 0), 5: ("skipped", None, 1, 1, 1)}
    # nothing new: a round without rows
    assert repairs.repair_round(ledger, pages, candidates, hits("p1", "p2", "p3", "p4", "p5", "e")) == 2 and told(2) == {}
    # a frame of page 1 is covered now, page 2's isn't, page 6's is
    repairs.repair_round(ledger, pages, candidates, hits("p1", "p3", "p4", "p5", "e", "b", "p6"))
    assert told(3) == {1: ("applied", "a", 3, 2, 2), 2: ("clear", None, None, None, None), 6: ("applied", "g", 1, 1, 1)}
    repairs.repair_round(ledger, pages, candidates, hits("p1", "p2", "p3", "p4", "p5", "e", "b", "p6"))
    assert told(4) == {2: ("skipped", None, 1, 1, 1)}
    now = {r.id: (r.verdict, r["round"]) for r in repairs.in_force(ledger.appended()).collect()}
    assert now == {1: ("applied", 3), 2: ("skipped", 4), 3: ("all_occluded", 1), 4: ("all_occluded", 1), 5: ("skipped", 1), 6: ("applied", 3)}
    assert sum(r.pages for r in repairs.summary(ledger.appended()).collect()) == 9
    tried = repairs.decided(repairs.evidence(pages, candidates, hits("p1")), tries=1).collect()
    assert [(r.verdict, r.source, r.n_tried) for r in tried] == [("applied", "a", 1)]
