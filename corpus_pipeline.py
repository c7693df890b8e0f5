"""From raw documents to packed training windows: five stages over the operators of ``tidegrid.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and
reread as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import minhash_forest, mixing, packing, substring_dedup, toxicity
from tidegrid.llm.queries import tokenizer_path
from tidegrid.staging import stage


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, trained on the labels, rejects go; all others stay as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(docs, labels).where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id; one row of it."""
    found = minhash_forest.near_duplicates(docs, percent=80).where("kept")
    found = found.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_th"))
    kept = docs.join(found, same).drop("_th")
    # rows that share an id are one document; a null id is no id, those rows differ by text
    first = kept.withColumn("_key", F.when(F.col("_id").isNull(), F.xxhash64("text")))
    return first.dropDuplicates(["_id", "_key"]).select(docs.columns)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out of the texts."""
    cut = substring_dedup.remove_repeats(docs)
    kept = cut.select("row.*", F.col("cut.clean").alias("_clean"), F.col("cut.n_removed").alias("_removed"))
    size = F.when(F.col("_removed") > 0, F.length("_clean").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", size).withColumn("text", F.col("_clean")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that is taken twice is two rows."""
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", clean_language),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", substring),
    ("mixing", mixture),
    ("packing", pack),
]

#: Models and a tokenizer take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
