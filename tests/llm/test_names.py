"""Stages on tables whose columns have the operators' own names, and on odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stavegrid.llm import host_rules, jaccard, linededup, packing, sharding, simple8b, substring, tokens

from . import cases

CLASHING = ["_counts", "_kept", "__text_hash", "__numbers", "__doc", "__hash", "__starts", "__had", "own_hash", "kept_id", "kept_hash", "gone_lines", "line_id", "line_hash", "gone_words", "window_id", "window_hash", "its_host", "host_bad", "rules_t", "a.b", "node", "root", "cls", "numbers", "starts", "TEXT_hash"]


def clashing(docs):
    for k, c in enumerate(CLASHING):
        docs = docs.withColumn(c, F.lit(k))
    return docs


def some_documents(spark):
    return cases.awkward_documents(spark).where("doc_id % 3 = 0 or doc_id < 12")


def same_rows(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, stage):
    docs = some_documents(spark)
    plain, odd = stage(spark, docs, ""), stage(spark, clashing(docs), "")
    assert odd.columns == [*docs.columns, *CLASHING]
    same_rows(odd.select(docs.columns), plain)
    assert odd.select([F.col(f"`{c}`") for c in CLASHING]).distinct().collect() == [tuple(range(len(CLASHING)))]
    assert stage(spark, cases.no_documents(spark), "").count() == 0


def test_stages_on_repeated_and_null_rows(spark):
    docs = cases.repeated_documents(spark)
    counts = {name: stage(spark, docs, "").count() for name, stage in corpus_pipeline.STAGES[:-1]}
    # rules: only t has ten words, and it repeats itself; lines: the row (null, t) and row 7 lose theirs; see test_jaccard_edges
    assert counts == {"quality_rules": 0, "line_dedup": 4, "jaccard_join": 4, "substring_dedup": 5}


def test_pipeline_on_no_rows(spark, tmp_path):
    cases.no_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_of_added_columns(spark):
    docs = cases.no_documents(spark).withColumn("_kept", F.lit(1)).withColumn("__KEPT", F.lit(1))
    assert host_rules.judged_names(docs) == ("_counts", "___kept")


def test_dotted_text_and_key(spark):
    docs = some_documents(spark).select(F.col("doc_id").alias("my.id"), F.col("text").alias("my.text"))
    want = some_documents(spark)
    same_rows(jaccard.classes(docs, "my.text", "my.id"), jaccard.classes(want))
    same_rows(linededup.digest(docs, "my.text", "my.id"), linededup.digest(want))
    same_rows(substring.digest(docs, "my.text", "my.id"), substring.digest(want))
    same_rows(sharding.shard_rows(docs, 3, "my.text", "my.id"), sharding.shard_rows(want, 3))
    encoder = lambda: tokens.word_end_encoder(tokens.vocabulary_path("word_bpe_49k.json"))
    same_rows(simple8b.read_ids(simple8b.write_ids(docs, encoder, 2, "my.text", "my.id")), simple8b.read_ids(simple8b.write_ids(want, encoder, 2)))
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    same_rows(packing.pack(docs, path, text="my.text", key="my.id"), packing.pack(want, path))
