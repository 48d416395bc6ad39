"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and is written before the next one reads it.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavegrid.llm import host_rules, jaccard, linededup, packing, substring, tokens
from stavegrid.llm.common import column, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules, of hosts that are not rejected.

    A null or empty text has too few words and goes; a null id or host is one
    like any other; repeated rows are judged one by one, all alike.  No rows
    give no rows.  Other columns stay, whatever their names.
    """
    _, kept = host_rules.judged_names(docs)
    return host_rules.judge(docs).where(column(kept)).select([column(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicate lines go; a document goes when no word is left.

    A null or empty text stays as it is, since it loses nothing.  The first
    line in the order of (doc_id, null last; text hash; line number) stays;
    fully equal rows are one document and keep or lose the same lines.  No rows
    give no rows.  Other columns stay, whatever their names.
    """
    return linededup.deduplicate(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays.

    A null id comes last; among repeated ids the smaller text hash is first;
    fully equal rows stay together.  Texts without words all stay.  No rows
    give no rows.  Other columns stay, whatever their names.
    """
    return jaccard.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that also start earlier go; emptied documents go.

    Earlier: smaller doc_id (null last), then smaller text hash, then earlier
    place; fully equal rows are one document.  A null or empty text stays as it
    is.  No rows give no rows.  Other columns stay, whatever their names.
    """
    return substring.deduplicate(docs, drop_empty=True)


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids.

    A null or empty text is its end id alone; null and repeated ids are rows
    like any other.  No rows give no pieces.
    """
    pieces = packing.pack(docs, tokens.vocabulary_path("byte_bpe_50k.json"), length=2048, end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("curve_packing", curve_packing),
]

#: MinHash banding, byte pairs and Hilbert keys have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
