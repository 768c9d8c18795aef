from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and 0 < docs.count() <= n, name
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_pipeline_returns_sequences_to_train_on(spark):
    import numpy as np

    docs = spark.createDataFrame([(i, "a few words of text " * (5 + 60 * i)) for i in range(40)] + [(3, "other words")] * 2, "doc_id long, text string")
    rows = corpus_pipeline.best_fit_packing(spark, docs, SF).collect()
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and len(sequences.setdefault(r.sequence_id, [])) == r.offset
        sequences[r.sequence_id] += ids
    assert max(map(len, sequences.values())) <= 4096 and sum(x.count(1) for x in sequences.values()) == 42


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    from . import helpers as H

    docs = H.documents(spark, n=20).union(spark.createDataFrame([(None, "no id here at all", None, None, None), (None, None, None, None, None), (3, "another text of three", "en", "s", 1)], H.SCHEMA)).withColumns({c: F.lit("x") for c in ("th", "cut", "row", "whole", "_text", "kept")})
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = spark.createDataFrame(stage(spark, now, SF).collect(), start.schema)
            assert now.columns == start.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).filter("piece = 0").count() == now.count()
    assert now.count() == 0
