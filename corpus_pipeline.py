"""A corpus pipeline in five stages over ``documents``.

Toxicity, language identification, near-duplicate removal, mixing to target weights, and piece
encoding. Every stage takes what its predecessor kept; all but the last return the columns of
the table they were given. Stages are written as Parquet to the shared folder and read again.

Defined results: rows with NULL keys or texts go through toxicity; language identification
removes texts without a letter, NULL and empty ones among them. Of equal rows one stays. An
empty table goes through all stages empty. Extra columns are carried to the mixing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bag_minhash, budget_mixing, cross_parsing, piece_codec, toxic_sentences
from folioscope.llm.shared import remainder, shared_table

SHARE, EPOCHS, SEED = 80, 2, 7


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as the key of its text: a decision then needs no join back."""
    return docs.select(F.struct("*").alias("key"), "text")


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rates under its threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("key"), "toxic")
    model = toxic_sentences.train(docs.select(F.col("doc_id").alias("key"), "text"), labels.where(remainder("key", 3) != 1))
    return toxic_sentences.scored(_rows(docs), model).where(F.col("score") < toxic_sentences.THRESHOLD).select("key.*")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in line with a language that was learned, ties between such languages too."""
    known = docs.select(F.col("doc_id").alias("key"), "text", "lang").where(remainder("key", 3) != 1)
    found = cross_parsing.predicted(_rows(docs), cross_parsing.train(known))
    return found.where((F.col("lang_pred") != cross_parsing.UNKNOWN) & F.col("in_line")).select("key.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least id."""
    return bag_minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to the target weights; a document read in two epochs comes twice, a part counts as whole."""
    taken = budget_mixing.mixed_rows(docs, F.expr(budget_mixing.DOMAIN_SQL), budget_mixing.WEIGHTS, SHARE, EPOCHS, SEED)
    times = (F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int")
    return taken.withColumn("time", F.explode(F.sequence(F.lit(1), times))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the exact piece ids of every document, and of what they decode to."""
    return piece_codec.digests(docs)


STAGES = [
    ("toxicity", keep_harmless),
    ("language", keep_known_language),
    ("near duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("pieces", encode),
]

# Learned models and signatures have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir))
    return docs
