import os

import pytest

import corpus_pipeline
from decisa.session import materialize

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_against_brute_force(spark):
    from test_jaccard_join import brute as components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        out[name] = docs.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        if name == "jaccard_join":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert sorted(out[name]["doc_id"]) == sorted({c for _, n, c in components(rows) if n} | {d for d, n, _ in components(rows) if not n})
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = out["jaccard_join"]["text"].map(lambda t: any(b in t for b in bench))
    kept = set(out["decontamination"]["doc_id"])
    assert not kept & set(out["jaccard_join"]["doc_id"][leaked]) and len(kept) >= 0.95 * (~leaked).sum()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    known = [d for d in out["quality_classifier"]["doc_id"] if d in labels.index]
    assert labels[known].mean() > 0.9
    assert len(out["token_output"]) == len(out["mixing"])
    first = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, first.to_numpy().tolist())) == sorted(map(tuple, out["token_output"].to_numpy().tolist()))
