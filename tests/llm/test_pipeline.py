from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from brindle.llm import decontaminate, langid, mixing, sharding
from brindle.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
def test_stages_against_brute_force(spark):
    from test_ops import brute_components, brute_fp, brute_mix, out

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    held = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF), "test")
        held.append(out(docs))
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    start = out(spark.read.parquet(f"{SF}/documents.parquet"))
    model = langid.learned_from(spark.read.parquet(f"{SF}/documents.parquet"))
    labels, scores = model.predict([r["text"] for r in start])
    kept = [r for r, lang, s in zip(start, labels, scores, strict=True) if lang != "und" and s >= langid.LEAST_SCORE]
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    assert ids(kept) == ids(held[0])
    root = brute_components({brute_fp(r["text"]) for r in kept}, 4)
    least: dict = {}
    for r in kept:
        f = root[brute_fp(r["text"])]
        least[f] = min(least.get(f, r["doc_id"]), r["doc_id"])
    assert sorted(least.values()) == ids(held[1])
    index = decontaminate.Index([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert [r["doc_id"] for r in sorted(held[1], key=lambda r: r["doc_id"]) if not index.find([r["text"]])] == ids(held[2])
    keyed = mixing._keyed(spark.createDataFrame(held[2], docs.select("doc_id", "text", "lang", "source", "n_chars").schema), mixing.SEED)
    light = out(keyed.selectExpr("doc_id", "source", "__key as key", "__size as size", "__place as place"))
    _, taken = brute_mix(light, mixing.WEIGHTS, mixing.REPEATS)
    got: Counter = Counter()
    for r in held[3]:
        got[r["doc_id"]] += len(r["text"].encode().split())
    assert got == +taken
    assert Counter(ids(held[4])) == Counter(ids(held[3])) and {r["shard"] for r in held[4]} <= set(range(sharding.SHARDS))
    run = out(corpus_pipeline.run(spark, SF))
    key = lambda rows: sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)
    assert key(run) == key(held[4])
