"""Folds and numbers over keys that lie in many ranges: the same as in one task."""

import random

import pandas as pd
import pytest

from tempolith.operators import folds, ranges


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data, t = [], 0.0
    for k in range(900):
        t += rng.choice([0.0, 0.3, 1.0, 1.0, 5.0])
        key = "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None])
        data.append((key, k, t, t + rng.choice([0.5, 1.0]), rng.randrange(1, 400), "word " * rng.randrange(0, 9)))
    return spark.createDataFrame(data, "vid string, seq int, t0 double, t1 double, size int, text string").repartition(5)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_a_hot_key_lies_in_many_ranges(spark, rows):
    dealt = ranges.in_ranges(rows, key=["vid"], order=["seq"], rows_per_range=100)
    hot = dealt.where("vid = 'hot'").groupBy("_range").count().collect()
    assert len(hot) >= 6 and max(r["count"] for r in hot) <= 250
    assert told(ranges.numbered(rows.select("vid", "seq"), key=["vid"], order=["seq"], rows_per_range=100)) == told(
        rows.selectExpr("vid", "seq", "cast(row_number() over (partition by vid order by seq) - 1 as bigint) as i")
    )


@pytest.mark.parametrize("size", [60, 300, 10_000])
def test_folds_carry_their_state(spark, rows, size):
    chunks = dict(key=["vid"], order=["seq"], size="size", cap=1500)
    assert told(folds.greedy_chunks(rows, **chunks, rows_per_range=size)) == told(folds.greedy_chunks(rows, **chunks))
    picks = dict(key=["vid"], time="t0", tie=["seq"], value="size", threshold=150, apart=7.0)
    assert told(folds.spaced_picks(rows, **picks, rows_per_range=size)) == told(folds.spaced_picks(rows, **picks))
    paras = dict(key=["vid"], order="seq", start="t0", end="t1", text="text", gap=3, span=20.0, short=30)
    assert told(folds.paragraphs(rows, **paras, rows_per_range=size)) == told(folds.paragraphs(rows, **paras))


def test_a_state_that_never_settles_is_right_too(spark, rows):
    """A running sum depends on all rows before: as many rounds as ranges."""

    def step(part, total, final):
        sums = part["size"].cumsum() + (total or 0)
        return part[["seq"]].assign(total=sums), int(sums.iloc[-1])

    got = ranges.fold_in_ranges(rows.where("seq < 300"), key=["vid"], order=["seq"], columns=["size"], step=step, schema="seq int, total long", rows_per_range=80)
    want = rows.where("seq < 300").selectExpr("vid", "seq", "sum(size) over (partition by vid order by seq) as total")
    assert told(got.drop("_range")) == told(want)


def test_no_rows(spark, rows):
    none = rows.where("false")
    assert folds.greedy_chunks(none, key=["vid"], order=["seq"], size="size", cap=10, rows_per_range=5).count() == 0
    assert ranges.numbered(none, key=["vid"], order=["seq"]).count() == 0


def test_folds_take_many_keys_at_a_time(spark):
    """Keys are cut out of batches wherever a batch ends, null keys are one key, and no key is an exchange with Python of its own."""
    big = (1 << 60) + 1
    keys = [None, *range(9), big]
    data = [(k, i, None if i == 2 and k == 3 else i + 1) for k in keys for i in range((k or 0) % 7 + 1)]
    df = spark.createDataFrame(data, "k long, i long, n long").repartition(3)
    seen = lambda rows: pd.DataFrame({"i": rows["i"], "upto": rows["n"].fillna(0).cumsum().astype("int64"), "size": len(rows)})
    want = {(k, i, sum(n or 0 for k2, j, n in data if k2 == k and j <= i), sum(k2 == k for k2, _, _ in data)) for k, i, _ in data}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("2", "5", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = folds.fold(df, key=["k"], order=["i"], columns=["n"], step=seen, schema="i long, upto long, size long")
            rows = [tuple(r) for r in got.collect()]
            assert len(rows) == len(data) and set(rows) == want
            assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
        assert folds.fold(df.where("false"), key=["k"], order=["i"], columns=["n"], step=seen, schema="i long, upto long, size long").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
