import collections

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as registered
import corpus_pipeline
from quern.llm.jaccard import jaccard_components
from quern.llm.mixing import mix_documents
from quern.llm.quality import score_quality
from quern.llm.substring import dedup_substrings

ROOT = "/root/testdata/sf0.001"


def test_each_stage_keeps_what_it_should(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, ROOT).write.parquet(f"{tmp_path}/{name}")
        seen.append((docs, docs := spark.read.parquet(f"{tmp_path}/{name}")))
        if name != "packing":
            assert docs.columns == columns
    (raw, good), (_, apart), (_, cut), (_, mix), (_, packed) = seen
    assert sorted(good.collect()) == sorted(raw.join(score_quality(raw, spark.read.parquet(f"{ROOT}/labels.parquet")).where("predicted = 1"), "doc_id", "left_semi").collect())
    assert {r.doc_id for r in apart.collect()} == {r.component_id for r in jaccard_components(good, 5, 80, 100).collect()}
    words = {r.doc_id: r for r in dedup_substrings(apart).collect()}
    assert {r.doc_id: len((r.text or "").encode().split()) for r in cut.collect()} == {k: r.n_words - r.n_removed for k, r in words.items()}
    assert all(r.n_chars == len(r.text) for r in cut.collect()) and any(r.n_removed for r in words.values())
    taken = {r.doc_id: r.copies for r in mix_documents(cut).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in mix.collect()) == taken
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mix.collect())
    rows = packed.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert rows[0] == want and rows[1] <= -(-want // 2048) + 1


def test_it_is_registered():
    assert registered.queries()["pipeline"] is corpus_pipeline.run and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "mixture", "packing"]
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in registered.queries() if n.startswith("op")}


def test_run(spark):
    assert corpus_pipeline.run(spark, ROOT).count() > 0


def test_stages_take_odd_rows_and_clashing_columns(spark, tmp_path):
    extra = "_size long, _n int, _k string, _key int, _t1 double, c0 string"
    rows = [(i, f"word{i % 7} and more text of document {i} " * 9, "en", f"s{i % 3}", 9, i, 1, "k", 2, 0.5, None) for i in range(40)]
    rows += [(None, None, None, None, None, 1, 1, "k", 2, 0.5, "x"), (50, "", "en", None, 0, 2, 1, "k", 2, 0.5, "x"), (51, " \n", None, "s1", 2, 3, 1, None, 2, 0.5, "x"), rows[3]]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    for name, docs in (("odd", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        for stage, function in corpus_pipeline.STAGES:  # each on all of them, whatever the one before would keep
            function(spark, docs, ROOT).write.parquet(f"{tmp_path}/{name}-{stage}")
            out = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            kept = out.collect()
            if stage != "packing":
                assert out.columns == docs.columns and all((r._n, r._key, r._t1) == (1, 2, 0.5) for r in kept)
            if name == "none" or stage != "quality":
                assert bool(kept) == (name == "odd")
            if stage == "substrings":
                assert len(kept) == docs.count() and sum(r.text is None for r in kept) == (name == "odd")
