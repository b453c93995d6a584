"""Runs, readings, votes and windows against plain Python."""

import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempolith.operators import readings, references, windows


def test_longest_common_runs(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab\né𝒳") for _ in range(n))
    rows = [(k, word(rng.randrange(30)), word(rng.randrange(60))) for k in range(300)] + [(900, None, "abab"), (901, "aaaa" * 9, "aaaa" * 20), (902, "", "")]
    got = {r.k: (r.size, r.at_left, r.at_right) for r in readings.longest_common_runs(spark.createDataFrame(rows, "k int, l string, r string"), left="l", right="r", least=4).collect()}
    want = {}
    for k, a, b in rows:
        m = difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).find_longest_match()
        if m.size >= 4:
            want[k] = (m.size, m.a, m.b)
    assert got == want and len(want) > 50


def test_drifting_anchors(spark):
    paras = [(1, 1, "One long beginning, of the first paragraph."), (1, 2, "Second paragraph of quite other words!"), (1, 3, "Third one with some more text in it."), (1, 4, "Fourth"), (1, 5, "The fifth has words as well, it seems."), (2, 1, None)]
    sections = [
        (1, 1, "One long beginning of the first"),  # nothing before
        (1, 2, "One-long beginning of the first paragraph"),
        (1, 3, "xx Second paragraph of quite"),  # begins within the first eight
        (1, 4, "a rather long start and then Third one with some more text"),  # too late in the section
        (1, 5, "One long beginning of the first paragraph"),  # too far back
        (1, 5, "words!"),  # too short
        (2, 2, None),
    ]
    got = readings.drifting_anchors(spark.createDataFrame(sections, "vid int, para int, text string"), spark.createDataFrame(paras, "vid int, id int, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 1), (1, 3, 2)]


def merged(first, second):
    kept = []
    for line in re.split(r"[\n；;。]", "\n".join(x for x in (first, second) if x is not None)):
        line = line.strip()
        if len(line) >= 2 and not any(difflib.SequenceMatcher(None, line, k).ratio() >= 0.8 for k in kept):
            kept.append(line)
    return "；".join(kept)


def test_consensus(spark):
    rng = random.Random(4)
    words = ["reading", "raeding", "readings", "other line", "öther líne", "x", "ab", "ba", "a longer line of text", "a longer line of test", " a longer  line of text "]
    text = lambda: rng.choice([None, ""]) if rng.random() < 0.1 else rng.choice("\n；;。").join(rng.choices(words, k=rng.randrange(1, 9)))
    rows = [(k, text(), text(), k) for k in range(300)]
    rows.append((900, "\n".join(f"line number {k} of a long page" for k in range(150)), "\n".join(f"line number {k} of another page, which is longer" for k in range(150)), 1))
    rows.append((901, "popular " * 40 + "x", "popular " * 40 + "yy", 1))
    got = {r.k: (r.consensus, r.i) for r in readings.consensus(spark.createDataFrame(rows, "k int, a string, b string, i int").repartition(3), readings=["a", "b"]).collect()}
    assert got == {k: (merged(a, b), i) for k, a, b, i in rows}


def test_bound_never_hides_what_is_alike(spark):
    rng = random.Random(6)
    lines = ["".join(rng.choices("abc é", k=rng.randrange(2, 14))) for _ in range(120)]
    told = lambda c: F.struct(F.length(c).alias("size"), readings._letters(F.col(c)).alias("letters"))
    a, b = spark.createDataFrame([(x,) for x in lines], "a string"), spark.createDataFrame([(x,) for x in lines], "b string")
    met = a.join(b, F.length("a") <= F.length("b") + 99).select("a", "b", readings.could_be_alike(told("a"), told("b"), 0.8).alias("may")).collect()
    for r in met:
        m = difflib.SequenceMatcher(None, r.a, r.b)
        assert r.may == (m.real_quick_ratio() >= 0.8 and m.quick_ratio() >= 0.8) or not m.ratio() >= 0.8
    assert 0 < sum(r.may for r in met) < len(met)


@pytest.mark.parametrize("n, usual, least, most", [(90, 2, 20, 512), (90, 2, 20, 10), (30, 8, 20, 512), (5, 8, 20, 512)])
def test_votes(spark, n, usual, least, most):
    rng = np.random.default_rng(n + most)
    v = rng.normal(size=(n, 6)).round(3)
    v[::3, :2] = v[0, :2]
    df = spark.createDataFrame([(None if n == 90 else "k", k, v[k].tolist()) for k in range(n)] + [("short", 0, [1.0]), ("short", 1, None)], "key string, o int, v array<double>").repartition(3)
    got = references.reference_votes(df, key=["key"], order=["o"], vector="v", width=6, part=(0, 2), same=0.3, apart=0.5, usual=usual, least=least, most=most, gap=7, rows_per_range=20).collect()
    step = -(-n // most) if n // usual > most else max(1, n // least) if n // usual < least and n >= least else usual
    refs = np.arange(0, n, step)
    rms = lambda x: np.sqrt(((x[:, None] - x[refs][None]) ** 2).mean(-1))
    far = np.abs(np.arange(n)[:, None] - refs[None]) >= min(7, max(1, n // 4))
    votes = (far & (rms(v) >= 0.5) & (rms(v[:, :2]) <= 0.3)).sum(1)
    assert {r.o: (r.i, r.votes) for r in got if r.key != "short"} == {k: (k, votes[k]) for k in range(n)}
    assert [r.votes for r in got if r.key == "short"] == [0, 0] and (n < 90 or votes.sum() > 0) and len(refs) <= most


def test_windows_are_tested_again_as_one(spark):
    rng = random.Random(8)
    cells, wholes = [], []
    for p in range(40):
        loud = 0.2 if p % 4 == 0 else 0.01
        for vid in ("moves", "rests", "cancels", "large", "few"):
            if vid == "few" and p >= 5:
                continue
            wholes.append((vid, p, loud + p * 1e-5))
            for r in range(4):
                for c in range(5):
                    moving = {"moves": (r, c) in ((1, 1), (1, 2), (2, 2)), "large": r < 3, "few": r == 0}.get(vid, False)
                    x = 0.03 + rng.random() / 100 if moving else 0.0
                    if vid == "cancels" and r == 0 and c < 2:  # each moves at its own half of the times: too little as one
                        x = 0.02 if (p % 2 == c or p % 10 == 0) else 0.0
                    cells.append((vid, p, r, c, x))
    df, w = spark.createDataFrame(cells, "vid string, p int, row int, col int, change double"), spark.createDataFrame(wholes, "vid string, p int, whole double")
    bounds = {"moved": 0.015, "low": 0.0, "high": 0.12}
    got = {r.vid: r for r in windows.moving_windows(df, w, key=["vid"], pair="p", rows=4, cols=5, **bounds).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"moves": "window", "rests": "cells", "cancels": "review", "large": "area", "few": "pairs"}
    assert (got["moves"].n_cells, got["moves"].box, got["moves"].active) == (3, [0.2, 0.25, 0.6, 0.75], 1.0) and 0.9 <= got["moves"].confidence <= 0.95
    assert windows.moving_windows(df.where("false"), w.where("false"), key=["vid"], pair="p", rows=4, cols=5).count() == 0


def test_equal_lines_make_no_pairs(spark):
    text = "\n".join(["the same line"] * 20_000 + ["quite another"] + ["the same line!"] * 20_000)
    df = spark.createDataFrame([(1, text, text)], "id int, first string, second string")
    assert readings.consensus(df, readings=["first", "second"]).first()["consensus"] == "the same line；quite another"
