import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from termweave.llm.util import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]
    seen = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, SF), "test")
        seen.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 1:
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    assert seen[0] > seen[1] >= seen[2] >= seen[3] and seen[4] == seen[5]
    for r in docs.limit(20).collect():
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() and r["n_tokens"] == len(r["ids"])


def test_stages_take_odd_rows(spark, edge_docs, empty_docs):
    """What each stage keeps of the odd rows, by id, and that an empty table stays empty."""
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge_docs, SF)
        kept[name] = sorted((r["doc_id"] for r in out.collect()), key=str)
        assert set(edge_docs.columns) <= set(out.columns) and stage(spark, empty_docs, SF).count() == 0, name
    assert not {3, 4, 6} & set(kept["quality classifier"])
    assert kept["line dedup"].count(1) == 0 and kept["line dedup"].count(7) == 1 and kept["line dedup"].count(9) == 1
    assert kept["n-gram Jaccard join"] == sorted([1, 3, 4, 5, 6, 8, 9, None, None], key=str)
    assert set(kept["mixing sources to target weights"]) <= set(kept["BPE encoding and decoding"])
    assert kept["BPE encoding and decoding"] == sorted((r["doc_id"] for r in edge_docs.collect()), key=str)
