import hashlib

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= rows, name
        rows = docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len({t.lower() for t in texts.values()}) == len(texts)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
