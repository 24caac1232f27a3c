import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from diffquarry.llm import token_store, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage read and returned."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        to = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(to)
        out[name] = (docs, spark.read.parquet(to))
        docs = out[name][1]
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontaminate", "mix", "tokens"]
    for name, (before, after) in stages.items():
        if name != "tokens":
            assert after.columns == before.columns


def test_each_stage_decides_by_its_operator(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit_on(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in toxicity.score(before, model).filter("score < 0.7").collect()}
    assert {r.doc_id for r in after.collect()} == want

    from .test_near_duplicates import closed, plain_fingerprint

    before, after = stages["simhash"]
    prints = {r.doc_id: plain_fingerprint(r.text) for r in before.collect()}
    fps = sorted(set(prints.values()))
    root = closed(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3])
    least = {}
    for k, f in prints.items():
        least[root[f]] = min(k, least.get(root[f], k))
    assert {r.doc_id for r in after.collect()} == set(least.values())

    from .test_search_scores import hand_contamination

    before, after = stages["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {r[0] for r in hand_contamination([(r.doc_id, r.text) for r in before.collect()], items) if not r[5]}
    assert {str(r.doc_id) for r in after.collect()} == want

    before, after = stages["mix"]
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    had, has = words(before), words(after)
    names = sorted(had)
    from .test_mixing_tokens import water

    target = dict(zip(names, water([had[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2), strict=True))
    most = before.agg(F.max(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert all(abs(has[s] - target[s]) < 0.03 * target[s] + most for s in names)
    assert after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2

    before, after = stages["tokens"]
    enc, texts = token_store.encoder(token_store.vocabulary()), {r.doc_id: r.text for r in before.collect()}
    at = 0
    for r in sorted(after.collect(), key=lambda r: r.start):
        ids = enc.encode(texts[r.doc_id]) + np.array([2], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens


def test_odd_tables_pass_through(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "a " * 60000, "en", "s", 1), (2, "a " * 60000, "en", "s", 1), (3, "b c d", None, "s", 2)]
    for n, part in (("some", rows), ("none", [])):
        spark.createDataFrame(part, schema).write.parquet(str(tmp_path / n / "documents.parquet"))
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / n / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "some")).count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
