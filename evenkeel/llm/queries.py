"""The registered queries of this subpackage: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import conversation_repair, conversation_trie, crf_language, exact_dedup, harmonic_packing, host_reputation, lattice_scoring, media_columns, minimax_sharding, oracles, pivot_index, prefix_join, quality_classifier, soft_mixing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, from the documents whose remainder isn't 2."""
    return lattice_scoring.score(table(spark, sf_dir, "documents"), lattice_scoring.held_out_by("doc_id", 7, 2), public_tokenizers.path("piece_bpe_32k.model"), class_col="lang")


def op2_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    return minimax_sharding.shard(table(spark, sf_dir, "documents"))


# The rules of the url contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host and bad (quality 0) of the pages that show a labelled document: the number that ends a page's path is its doc_id."""
    shown = pages.select(host_reputation.host_of(F.col("url")).alias("host"), F.regexp_extract(host_reputation.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("long").alias("doc_id"))
    return shown.where("doc_id is not null").join(labels.select("doc_id", (1 - F.col("quality")).alias("bad")), "doc_id").select("host", "bad")


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = host_reputation.judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids in sequences of at most 2048."""
    packed = harmonic_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "size_class")


def op5_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: components of a Jaccard similarity of 0.9 or more on sets of 3-word shingles."""
    return prefix_join.near_documents(table(spark, sf_dir, "documents"), k=3, percent=90)


def page_sites(pages: DataFrame) -> DataFrame:
    """doc_id, host and path (its first segment) of the documents that pages show."""
    url, number = F.col("url"), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$"
    path = host_reputation.path_of(url)
    found = pages.select(F.regexp_extract(path, number, 1).try_cast("long").alias("doc_id"), host_reputation.host_of(url).alias("host"), F.regexp_extract(F.regexp_replace(path, number, "/"), "^(/[^/]*)", 1).alias("path"))
    return found.where("doc_id is not null")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's posterior quality, from the labels of documents whose remainder isn't 2."""
    apart = lattice_scoring.held_out_by("doc_id", 5, 2)
    labels = table(spark, sf_dir, "labels").where(~apart)
    found = quality_classifier.score(table(spark, sf_dir, "documents"), labels, sites=page_sites(table(spark, sf_dir, "pages")))
    return found.withColumn("held_out", apart)


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors: links at a cosine of 0.95 or more, and components."""
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as an image and read back."""
    return media_columns.text_image_digests(table(spark, sf_dir, "documents"))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rate in a mix with equal tokens of each language."""
    docs = table(spark, sf_dir, "documents")
    found = soft_mixing.mix(docs, docs)
    return found.select("doc_id", "tokens", "domain", "posterior", "rate")


def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, from the labelled documents whose remainder isn't 2."""
    docs = table(spark, sf_dir, "documents").withColumn("apart", lattice_scoring.held_out_by("doc_id", 4, 2))
    model = crf_language.fit(docs.where(~F.col("apart")))
    found = crf_language.label(docs.withColumn("doc_id", F.struct("doc_id", "apart")), model)
    return found.select("doc_id.doc_id", F.col("doc_id.apart").alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op11_integer_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after the damage of the contract, repaired."""
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_exact_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: of equal texts the one with the largest doc_id stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op13_lcp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the rebuilt conversations."""
    return conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.paths(table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_subword_lattice": op1_subword_lattice,
    "op2_minimax_sharding": op2_minimax_sharding,
    "op3_host_reputation": op3_host_reputation,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_grouped_prefix_join": op5_grouped_prefix_join,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_pivot_index": op7_pivot_index,
    "op8_media_columns": op8_media_columns,
    "op9_soft_mixing": op9_soft_mixing,
    "op10_crf_language": op10_crf_language,
    "op11_integer_repair": op11_integer_repair,
    "op12_exact_runs": op12_exact_runs,
    "op13_lcp_forest": op13_lcp_forest,
}

ORACLES: dict[str, str] = oracles.ORACLES
