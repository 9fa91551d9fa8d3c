"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

import public_tokenizers
from brute import bpe, components, fits, repeated
from tokenizers import Tokenizer

import corpus_pipeline
from lettertrail.llm import quality_rules

SMALL = "/root/testdata/sf0.001"


def _docs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = _docs(docs)
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "word_bpe":
            assert docs.columns == columns
            seen[name] = before, _docs(docs)

    before, after = seen["quality_rules"]
    good = quality_rules.ledger(spark.read.parquet(f"{SMALL}/documents.parquet")).filter(quality_rules.passes("v1"))
    assert sorted(i for i, _ in after) == sorted(r["row"]["doc_id"] for r in good.collect()) and len(after) < len(before)

    before, after = seen["near_dedup"]
    assert sorted(i for i, _ in after) == sorted(i for i, (_, _, kept) in components(before, 5).items() if kept)

    before, after = seen["substring_dedup"]
    assert sorted(i for i, _ in before) == sorted(i for i, _ in after)
    texts, places = dict(after), repeated(before)
    for i, text in before:
        if places[i]:
            assert len(texts[i].split()) <= len(text.split()) - len(places[i])

    before, after = seen["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaky = {i for i, text in before for item in items if len(set(item.split()) & set(text.split())) > 4 and fits(item, text)}
    assert {i for i, _ in after} == {i for i, _ in before} - leaky

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"]: tuple(r)[1:] for r in docs.collect()} == {i: bpe(tokenizer, text) for i, text in after}


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
