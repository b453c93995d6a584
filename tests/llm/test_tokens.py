"""Byte-level BPE by prefix programming and token records, against the libraries and as round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tempolith.llm import bpe, pieces, records, store

MARKS = ["a", "b", "'", "s", "l", "re", "ve", " ", "  ", "\n", "\t", "é", "ß", "1", "٣", "Ⅷ", "!", "　", "\x85", "\x1c", "日", "😀", "don't", "I'll", "''s", " 's", "x's"]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(MARKS) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["", "'", " ", "'s", "a" * 3000, "ab " * 5000]


@pytest.fixture(scope="module")
def coder():
    return bpe.coder_for(bpe.vocabulary_path())[0]


@pytest.fixture(scope="module")
def library(coder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_pieces_are_those_of_the_pattern():
    import regex

    texts = odd_texts(3000)
    found, counts = pieces.split_pieces(texts)
    want = [regex.findall(P.PATTERN, t) for t in texts]
    assert counts.tolist() == list(map(len, want))
    assert [x.decode() for x in found.to_pylist()] == [x for w in want for x in w]


def test_long_texts_are_cut_where_pieces_begin(monkeypatch):
    text = " ".join(odd_texts(300)) + "word " * 200
    parts = pieces.cut_long(text, 50)
    assert len(parts) > 10 and "".join(parts) == text
    whole = pieces.split_pieces([text])[0].to_pylist()
    assert pieces.split_pieces(parts)[0].to_pylist() == whole


def test_ids_are_those_of_the_library(coder, library):
    texts = odd_texts(3000)
    encoder = pieces.BatchEncoder(coder.encode_pieces, remember=500)
    got = encoder.encode([*texts, None])
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in texts] + [[]]
    assert all(coder.decode(x.tolist()) == t.encode() for x, t in zip(got, texts))


def test_pieces_that_come_back_are_encoded_once():
    asked = []
    encoder = pieces.BatchEncoder(lambda new: asked.extend(new) or [(len(p),) for p in new], remember=60)
    for k in range(10):
        got = encoder.encode([" ".join(["often", *(f"seen{chr(97 + k)}{chr(97 + i)}" for i in range(25))])])
        assert got[0].tolist() == [5, *[7] * 25]
    assert asked.count(b"often") == 1 and len(encoder.known) + len(encoder.older) <= 120


@pytest.mark.parametrize("lacking", [False, True])
def test_ids_of_many_pieces_in_one_sequence_are_those_of_the_library(tmp_path, lacking):
    import json

    from tokenizers import Tokenizer

    path = P.path(records.VOCABULARY)
    if lacking:  # a vocabulary without a byte: the library leaves it out
        held = json.loads(open(path, encoding="utf-8").read())
        held["model"]["merges"] = [m for m in held["model"]["merges"] if "z" not in "".join(m)]
        held["model"]["vocab"] = {k: v for k, v in held["model"]["vocab"].items() if "z" not in k or k in {a["content"] for a in held["added_tokens"]}}
        path = str(tmp_path / "lacking.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(held, f)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = [*odd_texts(1000), "zebra fuzzy z", "<|endoftext|>", "\n \n\n a", "x" * 3000]
    encoder = records.encoder_for(path)
    encoder.remember = 700
    assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    records.encoder_for.cache_clear()


def test_appends_and_edits_stay_exact_and_local(coder, library):
    rnd = random.Random(2)
    for _ in range(60):
        text = "".join(rnd.choice(MARKS) for _ in range(150))
        e = bpe.EditableEncoding(coder, text)
        for _ in range(6):
            i = len(text) if rnd.random() < 0.3 else rnd.randint(0, len(text))
            j, new = min(len(text), i + rnd.randint(0, 5)), "".join(rnd.choice(MARKS) for _ in range(rnd.randint(0, 4)))
            e.edit(i, j, new)
            text = text[:i] + new + text[j:]
            assert e.text == text and e.ids == library.encode_ordinary(text)
    e = bpe.EditableEncoding(coder, "some words of a text " * 500)
    before = e.encoded_bytes
    e.append("more")
    e.edit(10, 12, "xy")
    assert e.encoded_bytes - before < 200


def test_encode_decode_digests(spark, coder, library):
    texts = [*odd_texts(50), None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    for row in bpe.encode_decode_digests(df).collect():
        ids = library.encode_ordinary(texts[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()
    assert bpe.encode_decode_digests(df.where("false")).count() == 0
    both = bpe.with_text(bpe.with_ids(df)).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both)


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_records_round_trip(spark):
    texts = [*odd_texts(80, 4), None, "<|endoftext|> x"]
    df = spark.createDataFrame([(5 * i + 1, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, start string").repartition(3)
    path = store.fresh_path(spark, "test-records")
    index = {r.doc_id: r for r in records.write_dataset(df, path, files=5).collect()}
    start = 0
    for i, ids in enumerate(library_ids(texts)):
        r = index[5 * i + 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    again = {r.doc_id: r.ids for r in records.read_shuffled(spark, path, seed=3).collect()}
    assert [again[5 * i + 1] for i in range(len(texts))] == library_ids(texts)


def test_records_of_an_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c")], "doc_id long, text string")
    got = records.write_dataset(df, store.fresh_path(spark, "test-records")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 3] and [r.start for r in got] == [0, 3, 6]
    assert records.write_dataset(df.where("false"), store.fresh_path(spark, "test-records")).count() == 0


def test_damage_is_found():
    raw = records.frame(7, np.array([1, 2, 70000], np.uint32)) + b"\n"
    doc_id, ids, end = records.parse(raw)
    assert (doc_id, ids.tolist(), end) == (7, [1, 2, 70000], len(raw))
    for at in (0, 9, 14, 20, len(raw) - 3):
        with pytest.raises(ValueError):
            records.parse(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
