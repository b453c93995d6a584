"""Versioned tables: what is in force, what failed or conflicting writers leave, audits, files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tempolith.plans import pipelines
from tempolith.sources import versions


@pytest.fixture
def made(spark):
    return versions.VersionedTable(spark, versions.fresh_folder(spark, "table"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_versions_stay_readable_and_a_failed_write_changes_nothing(spark, made):
    assert made.current() is None and made.versions().count() == 0
    with pytest.raises(ValueError, match="no version at all"):
        made.read()
    rows = spark.range(10)
    assert made.write(rows, "first") == 1
    held = made.read()  # a reader that stays with its version
    with pytest.raises(Exception, match="broken"):
        made.write(rows.select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id")))
    assert made.current() == 1 and ids(made.read()) == list(range(10))
    assert made.write(rows.where("id < 3")) == 2
    assert ids(made.read()) == [0, 1, 2] and ids(held) == ids(made.read(1)) == list(range(10))
    assert made.restore(1) == 3 and ids(made.read()) == list(range(10))
    assert [(r.version, r.rows, r.note) for r in made.versions().orderBy("version").collect()] == [(1, 10, "first"), (2, 3, ""), (3, 10, "restored 1")]
    assert made.vacuum(keep=1) == [1, 2] and ids(made.read()) == list(range(10))
    with pytest.raises(ValueError, match="no version 2"):
        made.read(2)
    assert made.write(rows.where("false")) == 4 and made.read().count() == 0


def test_of_two_writers_of_one_number_one_wins(spark, made):
    first, second = made.stage(spark.range(2)), made.stage(spark.range(5))
    made.publish(first, number=1)
    with pytest.raises(versions.ConflictError):
        made.publish(second, number=1)
    assert ids(made.read()) == [0, 1]
    assert made.publish(second) == 2


def test_a_record_that_a_lost_writer_left_empty_is_no_version(spark, made):
    made.write(spark.range(2))
    files, target = versions._files(spark, f"{made.path}/versions/00000002.json")
    files.create(target, False).close()
    assert made.current() == 1 and made.write(spark.range(4)) == 3 and made.current() == 3


def test_audit_decides(spark, made):
    rules = lambda df: df.where("id > 5").select(F.when(F.col("id") > 7, "abort").otherwise("warning").alias("level"), F.col("id").alias("detail"))
    assert made.audited(spark.range(3), rules)[0] == 1
    version, issues = made.audited(spark.range(10), rules)
    assert version is None and issues.count() == 4 and ids(made.read()) == [0, 1, 2]
    version, issues = made.audited(spark.range(7), rules)
    assert version == 2 and [r.level for r in issues.collect()] == ["warning"] and made.read().count() == 7
    assert made.audited(spark.range(9), rules, stop=["none"])[0] == 3


def test_page_changes(spark):
    row = "vid int, id int, t_start double, sha256 string"
    old = spark.createDataFrame([(1, 1, 0.0, "a"), (1, 2, 5.0, "b"), (2, 1, 0.0, "a"), (3, 1, 0.0, "a"), (4, 1, 0.04, None)], row)
    new = spark.createDataFrame([(1, 1, 0.0, "a"), (1, 2, 5.0, "c"), (2, 1, 1.0, "a"), (4, 1, 0.01, None), (5, 1, 0.0, "a")], row)
    got = versions.page_changes(old, new, key=["vid"], order="id", time="t_start", fields=[F.col("sha256")]).orderBy("vid").collect()
    assert [tuple(r) for r in got] == [(1, 2, 2, False, True), (2, 1, 1, True, True), (3, 1, 0, True, True), (4, 1, 1, False, False), (5, 0, 1, True, True)]
    assert versions.page_changes(old.where("false"), new.where("false"), key=["vid"], order="id", time="t_start", fields=[]).count() == 0


def test_files_against_recorded_digests(spark):
    sha = lambda s: "sha256:" + hashlib.sha256(s.encode()).hexdigest()
    path = versions.fresh_folder(spark, "pages")
    versions.write_pages(spark.createDataFrame([(1, 1, "one"), (1, 2, "é"), (1, 4, "")], "vid int, id int, text string"), path + "/x", key=["vid", "id"], text="text")
    files = versions.file_digests(spark, path + "/x", key=["vid", "id"])
    pages = spark.createDataFrame([(1, 1, sha("one\n")), (1, 2, sha("e\n")), (1, 3, sha("lost\n")), (2, 1, None)], "vid int, id int, recorded string")
    got = {(r.vid, r.id): (r.state, r.bytes) for r in versions.recomputed(pages, files, key=["vid", "id"]).collect()}
    assert got == {(1, 1): ("same", 4), (1, 2): ("changed", 3), (1, 3): ("missing", None), (1, 4): ("unrecorded", 1), (2, 1): ("missing", None)}
    sets = {r.vid: r for r in versions.recomputed_sets(pages, files, key=["vid"], page="id").collect()}
    assert (sets[1].missing, sets[1].changed, sets[1].unrecorded) == ([3], [2], [4]) and sets[1].recorded_id != sets[1].actual_id and sets[2].actual_id is None


def test_identity_of_a_set_of_pages(spark):
    pages = spark.createDataFrame([(1, 1, 0.00049, 2.0, "f1", 1.0), (1, 2, 2.0, 4.0, "f2", 3.0)], "vid int, id int, t_start double, t_end double, frame string, chosen_t double")
    files = spark.createDataFrame([(1, "f1", "a"), (1, "f2", "b")], "vid int, path string, sha256 string")
    (r,) = pipelines.slideset(pages, files).collect()
    assert r["count"] == 2 and r.digest == hashlib.sha256(b"slideset/1\n1|0.000|2.000|f1|1.000|a\n2|2.000|4.000|f2|3.000|b").hexdigest()
