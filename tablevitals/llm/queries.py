"""The registered queries of this subpackage: each applies an operator to its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.llm import attribution, decontamination, divergence, embeddings, infilling
from tablevitals.llm import licenses, minhash, packing, quality, scoring, sharding, toxicity, warc
from tablevitals.llm.common import table, tokenizer_path, tokenizer_pattern
from tablevitals.llm.oracle import ORACLE


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-duplicates of every document, and whether it stands for it."""
    return minhash.linked(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as it reads after a round trip through a WARC archive."""
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices in every document, by family."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op4_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token over a boundary goes to its first line."""
    documents = table(spark, sf_dir, "documents")
    return attribution.token_counts(documents, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern(), "start")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document has a copy of, and where."""
    documents = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return decontamination.matches(documents, table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every document, and whether it passes the fences of its language and source."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows, name = quality.judged(documents.withColumn("doc_id", documents.doc_id.cast("long")))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return rows.select("doc_id", *(f"{name}.{column}" for column in columns))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near-equal bytes."""
    return sharding.sharded(table(spark, sf_dir, "documents"), 40)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document under a bigram model of those not held out."""
    return scoring.scored(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from labelled ones that are not held out."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart in their words, and the words each uses most beyond it."""
    return divergence.audited(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill-in-the-middle form of every document, and the hashes of it and of the text rebuilt from it."""
    rows = infilling.restored(infilling.transformed(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of near-duplicates of every vector, and the component it belongs to."""
    return embeddings.linked(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_warc": op2_warc,
    "op3_license_scan": op3_license_scan,
    "op4_token_attribution": op4_token_attribution,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_packing": op7_packing,
    "op8_virtual_slots": op8_virtual_slots,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_embedding_dedup": op13_embedding_dedup,
}

__all__ = ["ORACLE", "QUERIES"]
