"""A training corpus from raw documents: classify, deduplicate, redact, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents, extra ones included, whatever their names.

Defined results: null and empty texts are rejected by the quality stage as a rule, as texts of no
words; what it keeps of them is one group of copies and stays without personal data. Repeated rows,
and rows of one id, are one document, of which the near-duplicate stage keeps the smallest text; rows
without an id are kept there, each by itself. A very long text passes every stage whole. A missing
source or language is a category of its own in the mix. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mzframe.llm import byte_bpe, common, near_dedup, pii, queries, raking, weak_labels


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on them, does not reject."""
    return weak_labels.accepted(docs, weak_labels.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return near_dedup.deduplicated(docs, threshold=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, and their new lengths."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents by source, language and form of text. Rows travel packed, so that no column of theirs is taken for one of the mix."""
    packed = docs.select(F.struct("*").alias("document"), "doc_id", "text", "source", "lang")
    return raking.sample(raking.describe(packed), queries.MIX_TARGETS, budget_share=0.9).where("sampled").select("document.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of each text, and of the bytes that they decode to."""
    path, pattern = queries.tokenizer()
    return byte_bpe.encode(docs, byte_bpe.load_ranks(spark, path), pattern, byte_bpe.digests, byte_bpe.DIGESTS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("encoding", encoding),
]
#: SQL can express neither the classifier nor the similarity groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
