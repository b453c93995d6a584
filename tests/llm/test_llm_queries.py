"""Every registered query of the subpackage on the smallest tables: against its SQL where it has one, else by its contract."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import pytest

from tempolith.llm import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    return v if v is None or isinstance(v, (str, bool)) else round(float(v), 6)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    rel = con.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in place) for r in rel.fetchall()]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows, key=order) == sorted(want, key=order)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name, key="doc_id"):
    got = catalogue.QUERIES[name](spark, SF).collect()
    assert len({r[key] for r in got}) == len(got)
    return {r[key]: r for r in got}


def test_op1_rows(spark, docs):
    got = rows_of(spark, "op1_histogram_sort")
    assert got.keys() == docs.keys()
    for i, r in got.items():
        raw = (docs[i] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 8


def test_op4_rows(spark, docs):
    from tempolith.llm import licenses

    got = rows_of(spark, "op4_license_rules")
    assert got.keys() == docs.keys()
    for i, r in got.items():
        n, found, _ = licenses.scanner().scan(docs[i])
        labels = {licenses.RULES[d.rule].label for d in found}
        assert r.n_words == n and r.labels == ",".join(sorted(labels)) and set(filter(None, r.base_labels.split(","))) <= labels
        assert r.score == max([licenses.RULES[d.rule].priority for d in found], default=0) / licenses.BASE_PRIORITY and r.n_detections == len(found)


def test_op5_rows(spark, docs):
    got = rows_of(spark, "op5_feistel")
    assert got.keys() == docs.keys() and any(r.n_values for r in got.values())
    for i, r in got.items():
        assert r.n_values == len(r.pseudonyms) and (r.text is None) == (docs[i] is None) and (r.n_values > 0 or r.text == docs[i])
        assert all(p in r.text for p in r.pseudonyms)


def test_op7_rows(spark, docs):
    from tempolith.llm import contamination

    got = rows_of(spark, "op7_qgram_lemma")
    items = {r.item_id: contamination.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        text = contamination.normalised(docs[i])
        assert {k for k, t in items.items() if t and t in text} <= set(r.item_ids) and r.contaminated == (r.n_items > 0) and r.n_items == len(r.item_ids)


def test_op8_op9_rows(spark, docs):
    got = rows_of(spark, "op8_language")
    assert got.keys() == docs.keys() and all(0 <= r.score <= 1 for r in got.values())
    pages = rows_of(spark, "op9_link_graph", "page_id")
    assert len(pages) == spark.read.parquet(f"{SF}/pages.parquet").count() and {r.verdict for r in pages.values()} <= {"allow", "block"}


def test_op2_op10_rows(spark, docs):
    got = rows_of(spark, "op2_prefix_bpe")
    assert all(r.decoded_sha256 == hashlib.sha256((docs[i] or "").encode()).hexdigest() for i, r in got.items())
    records = rows_of(spark, "op10_token_records")
    at = 0
    for i in sorted(records):
        assert records[i].start == at
        at += records[i].n_tokens
