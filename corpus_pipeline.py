"""The corpus pipeline: rejected documents go, copies go, repeated passages and secrets are cut, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.llm import near_dup, packing, quality, secrets, substring
from cellgrove.llm.shared import Store, fresh, text_key

VOCABULARY = "word_bpe_49k.json"


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars anew, as the text may have changed."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep.

    Cutoffs are set on the labelled rows of `docs` for each language. Null
    texts have no words and go; repeated rows share a verdict; without labels
    only the base rules hold.
    """
    return quality.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name="pipeline-1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word shingle similarity 0.8 or more: the one of the least id.

    Repeated rows count once; null ids come last. Documents without words are
    never in a group.
    """
    found = near_dup.near_duplicates(docs, size=5, percent=80, name="pipeline-2")
    rid = fresh(docs, "rid")
    kept = found.where("elected").select(F.col("rid").alias(rid))
    rows = docs.withColumn(rid, text_key("doc_id", "text")).join(kept, rid, "left_semi")
    return rows.dropDuplicates([rid]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the words of 35-word windows that occur more than once.

    Texts without such a window stay byte for byte; null texts stay null.
    """
    return _counted(substring.without_repeats(docs, name="pipeline-3"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mark.

    Null texts stay null; repeated rows change alike; an empty table stays empty.
    """
    return _counted(secrets.redacted(docs, name="pipeline-4"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 2048 ids.

    A null text is the end id alone; repeated rows are packed each by itself;
    an empty table gives no sequences.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(VOCABULARY), size=2048, name="pipeline-5")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secret_spans),
    ("best-fit packing", packed_sequences),
]

#: SQL has no tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as a table that the next one reads."""
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
