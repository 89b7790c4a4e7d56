import re

import corpus_pipeline
from tests.llm.test_neardup import brute
from tests.llm.test_packing import check, tokens
from tests.llm.test_pii import base
from vicinage.llm import quality, toxicity


def test_stages_one_by_one(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{small}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, small).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == columns
        given = {r.doc_id: r.text for r in before.collect()}
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score_documents(spark, before, labels).collect()}
            assert {r.doc_id for r in after.collect()} == {i for i, s in scores.items() if s < 0.5}
        elif name == "quality":
            scores = {r.doc_id: r.score for r in quality.score_documents(spark, before, labels).collect()}
            assert {r.doc_id for r in after.collect()} == {i for i, s in scores.items() if s >= 0.3}
        elif name == "near_duplicates":
            assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in brute(list(given.items()), 5).items() if i == c}
        elif name == "personal_data":
            for r in after.collect():
                assert not base(re.sub(r"\[[A-Z_]+\]", "\n", r.text)) or base(given[r.doc_id])
                assert r.n_chars == len(r.text) and (r.text == given[r.doc_id]) == (not base(given[r.doc_id]) or "[" not in r.text)
        else:
            rows = after.collect()
            check(rows, 2048)
            assert sum(r.length for r in rows) == sum(len(tokens(t)) for t in given.values())
        before = after


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert check(rows, 2048) and set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
