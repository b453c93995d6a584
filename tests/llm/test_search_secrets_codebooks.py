"""Lexical search, secret scans and codebooks against plain Python over all rows, and odd rows through them."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tempolith.llm import codebooks, search, secrets, store

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASH = ("row", "number", "rank", "score", "ids", "terms", "slots", "findings", "found", "owner", "repository", "digest", "start", "x", "key", "code", "error", "label_error", "position", "part", "entry")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked(docs, items, k=10):
    """The contract, document by document."""
    held = [(i, Counter(LETTERS.findall(lowered(t)))) for i, t in docs]
    held = [(i, tf) for i, tf in held if tf]
    n_docs, total = len(held), sum(sum(tf.values()) for _, tf in held)
    df = Counter(t for _, tf in held for t in tf)
    out = []
    for item, text in items:
        asked = {t for t in LETTERS.findall(lowered(text)) if df[t]}
        scores = []
        for i, tf in held:
            m = 100 - 90 + 90 * sum(tf.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in asked if tf[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def flat(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_search_against_all_rows(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)] + ["Été", "ÉTÉ", "naïve", "A1", "x_y", "don't", "İstanbul", "K"]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 9, 40])))) for k in range(400)]
    docs += [(1000 + k, docs[3][1]) for k in range(150)] + [(2, "w1 w2"), (2, "w1 w2"), (None, "w1 w2"), (5000, None), (5001, ""), (5002, "-- !"), (-4, "w1 w2")]
    docs.append((6000, " ".join(rng.choices(words, k=5000))))
    items = [(k, " ".join(rng.choices(words, k=5))) for k in range(12)] + [(50, "w1 w2"), (50, "w1 w2"), (None, "w3"), (51, None), (52, "??"), (53, "absent"), (54, docs[3][1] + " W1 w1")]
    clash = [F.lit(k).alias(c) for k, c in enumerate(CLASH)]
    shards, documents = search.built(spark.createDataFrame(docs, "doc_id long, text string").select("*", *clash).repartition(3), postings=300, stretch=64)
    assert shards.count() > 3 and documents == 400 + 150 + 3 + 2
    asked = spark.createDataFrame(items, "item_id long, text string").select("*", *clash)
    for size in (search.BLOCK_BYTES, 40):  # all at once, and in many blocks
        got = [tuple(r) for r in search.search(shards, documents, asked, block_bytes=size).collect()]
        assert flat(got) == flat(ranked(docs, items))


def test_search_without_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.withColumn("text", F.lit(None).cast("string")), items)):
        shards, documents = search.built(d)
        assert search.search(shards, documents, i).count() == 0
    assert list(search.stretches(None)) == [] and b"".join(sum(search.stretches("Aé,B" * 99), [])) == "aéb".encode() * 99


def test_a_task_never_holds_all_of_its_shards(spark):
    """Shards lie in row groups of a few rows each, however many a task makes."""
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60_000)), lambda k: F.hash(k, "doc_id").cast("string")), " ")
    docs = spark.range(24).coalesce(1).withColumnRenamed("id", "doc_id").withColumn("text", words)
    shards, documents = search.built(docs, postings=50_000)
    groups = [m.row_group(k).num_rows for f in shards.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file:")).metadata] for k in range(m.num_row_groups)]
    assert documents == sum(groups) == 24 and max(groups) <= 12


def scan(text):
    """Base and wider candidates of one text: kind, start, end, value."""
    out = []
    for kind, (pattern, group, least) in secrets.KINDS.items():
        out += [(kind, m.start(), m.end(), m[group]) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return out


def test_base_patterns_by_the_contract():
    """The narrowed forms find what the stated ones find once failing matches are dropped."""
    rng = random.Random(3)
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    bits = ["AKIA", "AKI", "A", "IA", "0", "f", "ab", "deadbeef", "x", " ", ":", "=", "'", '"', "Token", "PASSWORD", "api_key", "apikey", "-", "\n", "é"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randrange(40)))
        want = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert sorted(want) == sorted(x[:3] for x in scan(text) if x[0] in secrets.BASE)


def test_secrets_by_ownership(spark):
    own, hex_ = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vX7zA9cE1gH3jK5", "0123456789abcdef9876543210fedcba"
    copied = "sk-" + "Zx8Yw6Vu4Ts2Rq0Po9Nm7Lk5"
    rows = [(k, f"s{k % 4}", f"é {k} key {copied} end") for k in range(40)]
    rows += [(100 + k, "s1", f'one {own} and again {own}; password = "hunter2222"') for k in range(30)]
    rows += [(200, "s9", f"hash {hex_} token: {hex_}"), (201, None, f"𝒳 {own[:-1]}Q"), (202, "s9", "secret=changeme99 password: xxxxxxxx"), (203, "s2", None), (203, "s2", ""), (None, "s3", "AKIA" + "Q1W2E3R4T5Y6U7I8"), (204, "s1", "token=token: abcdefgh")]
    rows += [(300, "s5", " ".join(f"token={k:032x}" for k in range(3000)))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    holders = defaultdict(set)
    for i, s, t in rows:
        for *_, v in scan(t):
            holders[v].add(s)
    order = list(secrets.KINDS)

    def verdict(v):
        return "copied" if len(holders[v]) >= 3 else "live" if len(set(v)) >= secrets.VARIED and not re.search(secrets.PLACEHOLDER, v.lower()) else "dull"

    want = Counter()
    for i, _, t in rows:
        found = sorted(((a, order.index(k), k, z, verdict(v)) for k, a, z, v in scan(t) if k in secrets.BASE or verdict(v) == "live"))
        want[(i, ",".join(f"{k}:{a}:{z}:{w}" for a, _, k, z, w in found))] += 1
    got = secrets.with_findings(docs.repartition(3)).collect()
    assert Counter((r.doc_id, ",".join(f"{f.kind}:{f.start}:{f.end}:{f.verdict}" for f in r.findings)) for r in got) == want
    assert all(r["findings_input" if c == "findings" else c] == k for r in got for k, c in enumerate(CLASH))
    by = {r.doc_id: r.findings for r in got}
    assert not by[5] and {f.verdict for f in by[101]} == {"live"} and [f.repositories for f in by[101] if f.kind == "issued"] == [30, 30]
    assert secrets.with_findings(docs.where("false")).count() == 0
    plan = secrets.op12_owned_secrets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def lloyd(vectors, parts, entries, rounds):
    """``vectors``: (id, integers) in the order of ids; returns codes, errors and codebooks."""
    step = len(vectors[0][1]) // parts
    cut = [[v[p * step : (p + 1) * step] for p in range(parts)] for _, v in vectors]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for c in cut:
                mine[near(p, c[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(mine[k]) for x in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[p])]
    hits = [[near(p, c[p]) for p in range(parts)] for c in cut]
    return ["".join(f"{k:02x}" for _, k in h) for h in hits], [sum(d for d, _ in h) for h in hits], books


@pytest.mark.parametrize("scale", [1.0, 3e6, 2e15])
def test_codebooks_against_plain_lloyd(spark, scale):
    rng = random.Random(5)
    hot = [rng.uniform(-1, 1) * scale for _ in range(8)]
    rows = [(k, [rng.choice([-0.5, 0.25, rng.uniform(-1, 1)]) * scale for _ in range(8)], k % 3 or None) for k in range(150)] + [(1000 + k, hot, 7) for k in range(80)]
    bad = [(-1, None, 1), (-2, [1.0, None] + [0.0] * 6, 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] * 8, 1), (-5, [], 1), (-6, [1.0] * 6, 1), (-7, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    got = {r.vec_id: r for r in codebooks.compressed(df.repartition(3), parts=4, entries=10, rounds=3).collect()}
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows]
    codes, errors, books = lloyd(ints, 4, 10, 3)
    by_label = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] += e
    cap = (1 << 63) - 1
    assert got.keys() == {i for i, _ in ints}
    for (i, _, label), code, e in zip(rows, codes, errors, strict=True):
        assert (got[i].code, got[i].error) == (code, min(e, cap))
        assert got[i].label_error == min(by_label[label], cap) or scale > 1e9
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}
    for r in got.values():
        assert all(r[c + "_input" if c in codebooks.RESULTS else c] == k for k, c in enumerate(CLASH))


def test_codebooks_of_few_rows(spark):
    df = spark.createDataFrame([(None, [1.0] * 4, None), (3, [2.0] * 4, None), (3, [1.0] * 4, 2), (3, [1.0] * 4, 2)], "vec_id long, embedding array<float>, label int")
    got = codebooks.compressed(df, parts=2, entries=64, rounds=2).collect()
    assert len(got) == 4 and {r.error for r in got} == {0}
    assert codebooks.compressed(df.where("false")).count() == 0
    assert codebooks.compressed(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0
    assert store.free_name(df, "label") == "label_"
