import public_tokenizers as P

import corpus_pipeline as pipeline
from matchspark.llm import packing, toxicity
from tests.llm.common import empty_docs, odd_docs
from tests.llm.test_pair_operators import brute_components, brute_kept
from tests.llm.test_text_operators import check_packing


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = pipeline.language(spark, docs, sf_dir)
    assert named.columns == list(pipeline.COLUMNS)
    assert rows(named) == rows(docs)  # every text here is prose of a known language
    named = pipeline.keep(named, "t")

    clean = pipeline.keep(pipeline.clean(spark, named, sf_dir), "t")
    model = toxicity.train(named, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(named, model).where("score >= 0.5").collect()}
    assert bad and rows(clean) == [(i, t) for i, t in rows(named) if i not in bad]

    unique = pipeline.keep(pipeline.unique(spark, clean, sf_dir), "t")
    groups = brute_components(rows(clean), 5)
    assert rows(unique) == [(i, t) for i, t in rows(clean) if groups[i][1] == i]

    left = pipeline.keep(pipeline.unrepeated(spark, unique, sf_dir), "t")
    want = []
    texts = dict(rows(unique))
    for i, (n, gone, kept) in sorted(brute_kept(rows(unique)).items()):
        if gone == 0 or gone < n:
            want.append((i, texts[i] if gone == 0 else kept))
    assert rows(left) == want and all(r.n_chars == len(r.text) for r in left.collect())

    check_packing(pipeline.packed(spark, left, sf_dir).collect(), rows(left))


def test_run_applies_the_stages(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    assert out.columns[:2] == ["doc_id", "start"] and out.count() > 0


def test_odd_rows_pass_every_stage(spark, sf_dir):
    docs = odd_docs(spark)
    for name, stage in pipeline.STAGES:
        docs = pipeline.keep(stage(spark, docs, sf_dir), f"odd-{name}")
    assert docs.count() > 0
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty_docs(spark), sf_dir).count() == 0
    assert packing.pack(empty_docs(spark), P.path("byte_bpe_50k.json")).count() == 0
