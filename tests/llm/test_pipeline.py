from llm_help import SF, make_docs

import corpus_pipeline as cp


def test_stages_keep_the_columns_and_have_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in cp.STAGES:
        out = cp.materialize(stage(spark, docs, SF), name)
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        sizes.append(out.count())
        docs = out
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[2:] == [sizes[2]] * 4
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe"]


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, SF), name)
    key = lambda rows: sorted((r.doc_id, r.ids_sha256) for r in rows)
    assert key(cp.run(spark, SF).collect()) == key(docs.collect())


def test_empty_and_extra_columns(spark):
    docs = make_docs(spark, ["a b", None, ""]).selectExpr("*", "1 AS kept", "2 AS component_id")
    for d in (docs, docs.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            d = cp.materialize(stage(spark, d, SF), name)
            assert d.columns == docs.columns
