"""The queries opN_<name>: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellgrove.llm import ann, encoding, near_dup, oracles, packing, prefix_tokens, quality, secrets, substring, suffix_array, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules of the url query, as host, path and whether they allow.
URL_RULES = [
    ("org", "/", True),
    ("example.org", "/es/", False),
    ("example.org", "/en/1", False),
    ("com", "/fr/", True),
    ("com", "/de/", False),
]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules, their cutoffs set on the labelled documents of each language."""
    found = quality.rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), name="op1")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of word_bpe_49k ids in sequences of 2048."""
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), size=2048, name="op2")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 2-word shingles are at least 0.8 alike."""
    found = near_dup.near_duplicates(_table(spark, sf_dir, "documents"), size=2, percent=80, name="op3")
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20, name="op4")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text; sources own documents."""
    return secrets.report(secrets.scan(_table(spark, sf_dir, "documents"), name="op5"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict for every page's url."""
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left without those in 35-word windows that start elsewhere as well."""
    return substring.removal_report(_table(spark, sf_dir, "documents"), name="op7")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left without those in 100-byte strings that start earlier."""
    return suffix_array.removal_report(_table(spark, sf_dir, "documents"), name="op8")


def op9_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word_bpe_49k ids of every text and the text they decode to, as digests."""
    return encoding.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """piece_bpe_32k token counts of every text."""
    return prefix_tokens.token_counts(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), limit=4096)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_minhash": op3_minhash,
    "op4_ann": op4_ann,
    "op5_secrets": op5_secrets,
    "op6_urls": op6_urls,
    "op7_substring": op7_substring,
    "op8_suffix": op8_suffix,
    "op9_encoding": op9_encoding,
    "op10_tokens": op10_tokens,
}
ORACLE_SQL = {
    "op1_quality": oracles.quality_sql(),
    "op3_minhash": oracles.OP3,
    "op5_secrets": oracles.OP5,
    "op6_urls": oracles.OP6,
    "op7_substring": oracles.OP7,
    "op8_suffix": oracles.OP8,
}
