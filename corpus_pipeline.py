"""A training corpus in five stages, each written as Parquet and read again as the next one's documents.

1. quality: documents that the site-aware classifier rejects go.
2. language: documents without a recognisable language, or with too mixed words to tell, go.
3. duplicates: of each component of near copies (five-word shingles, similarity 0.8) one row with the least doc_id stays.
4. mixing: documents of languages that fall short are repeated, as often as their fitted rates say.
5. packing: token ids in sequences of at most 2048.

Stages 1 to 4 return the columns of their input. A row keeps its columns by meeting its decision on a number of its own,
written with the row before anything is decided (language carries the whole row instead);
the columns that a decision needs on the way have names that no column of the input begins with, so they can't clash.
So rows with a null or repeated doc_id are each judged by their own text; a null doc_id is the last that stays of copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import crf_language, harmonic_packing, prefix_join, quality_classifier, queries, soft_mixing
from evenkeel.llm.common import cut, release, written

#: Mean probability that a text's words have its language; clean texts of one language are far above, texts of two halves near 0.5.
LEAST_LANGUAGE_SCORE = 0.6
#: Share of recognised words over the language's usual one; random letters and unlearned languages are far below.
LEAST_LANGUAGE_EVIDENCE = 0.5
#: Language totals follow the corpus's own to this power, and none shrinks.
TEMPER = 0.7


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of docs with a written number, and the number's name, with which no column of docs begins."""
    name = "row"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    return cut(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _only(numbered: DataFrame, row: str, kept: DataFrame) -> DataFrame:
    """The rows of numbered whose number is in kept (one column), without the number."""
    kept = kept.toDF(f"{row}_kept")
    return numbered.join(kept, F.col(row) == F.col(f"{row}_kept"), "left_semi").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("__id"), "quality")
    ids = rows.select(F.col(row).alias("__row"), "doc_id")
    known = ids.join(labels, F.col("doc_id") == F.col("__id")).select("__row", "quality")
    sites = queries.page_sites(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("doc_id", "__id")
    sites = ids.join(sites, F.col("doc_id") == F.col("__id")).select(F.col("__row").alias("doc_id"), "host", "path")
    found = quality_classifier.score(rows, known, id_col=row, label_id_col="__row", sites=sites)
    return _only(rows, row, found.where("accepted").select("doc_id"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the whole row goes along as the id, so nothing has to meet again
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "text")
    found = crf_language.label(whole, crf_language.fit(docs), id_col="__row", evidence=True)
    kept = found.where((F.col("lang_pred") != crf_language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE) & (F.col("evidence") >= LEAST_LANGUAGE_EVIDENCE))
    return kept.select(*(F.col("doc_id").getField(c).alias(c) for c in docs.columns))


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _numbered(docs)
    found = prefix_join.near_documents(rows, id_col=row, k=5, percent=80).select(F.col("doc_id").alias("__found"), "component_id")
    named = rows.select(F.col(row).alias("__row"), F.col("doc_id").alias("__id")).join(found, F.col("__row") == F.col("__found"))
    least = named.groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__row")).alias("__least"))
    return _only(rows, row, least.select("__least.__row"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _numbered(docs)
    rates = soft_mixing.mix(rows, rows, id_col=row, temper=TEMPER, grow=True)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    repeats = F.greatest(F.lit(1), F.floor(F.col("rate") + chance)).cast("int")
    times = rates.select(F.col("doc_id").alias(f"{row}_id"), repeats.alias(f"{row}_times"))
    met = rows.join(times, F.col(row) == F.col(f"{row}_id"))
    return met.withColumn(f"{row}_nth", F.explode(F.sequence(F.lit(1), F.col(f"{row}_times")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = harmonic_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "size_class")


STAGES = [("quality", quality), ("language", language), ("duplicates", duplicates), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        # what the stage wrote on its way, and its input, are needed no more
        release(spark, mark, keep=docs)
    return docs
