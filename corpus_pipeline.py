"""The corpus pipeline: five stages, each of which calls one operator of groundplan.llm and acts on what it finds.

Every stage but the last takes and returns the columns of documents. Rows without a doc_id leave at the first stage that joins on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundplan.llm.common import saved, table
from groundplan.llm.decontaminate import contaminated
from groundplan.llm.near_dedup import near_duplicates
from groundplan.llm.piece_codec import encode_pieces
from groundplan.llm.quality import classify
from groundplan.llm.suffix_dedup import repeated_spans_removed


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return docs.join(classify(docs).where("kept").select("doc_id"), "doc_id", "left_semi")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8), the document with the smallest doc_id stays, once."""
    return docs.join(near_duplicates(docs).where("kept").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that came earlier are cut from the texts; every document stays, with what is left of its text."""
    kept = repeated_spans_removed(docs, as_text=True).select("doc_id", F.col("kept").alias("text"))
    return docs.drop("text").join(kept, "doc_id").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id"), "doc_id", "left_anti")


def sentencepiece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text that is left, and the hash of what they decode to: doc_id, n_tokens, ids, decoded_sha256."""
    out = encode_pieces(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_codec", sentencepiece_codec),
]

#: SQL has neither the classifier nor the tokenizer; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
