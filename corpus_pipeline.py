"""From raw documents to a training mix, stage by stage, each over all rows of the one before.

Texts that the classifier rejects go; of each group of near copies one stays; documents
that hold benchmark passages go; personal data is replaced by its kind; the last stage
says how often the mix takes each document, and leaves out those it does not take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.llm.common import bucket_of, free_name, stage
from meterstone.llm.compression_quality import fit_quality, quality_score
from meterstone.llm.context_pii import mask_pii
from meterstone.llm.decontaminate import contaminated, decontaminate
from meterstone.llm.mixing import take
from meterstone.llm.partenum_join import Join, keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what is as likely good as bad, or likelier."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, bucket_of(F.col("id"), 3) != 1)
    score = free_name(docs, "score")
    return quality_score(docs, model, to=score).where(F.col(score) >= 0.5).drop(score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked ones, that of least id.

    Near copies link at 0.8 of their runs of five words.
    """
    return keep_one(docs, join=Join(shingle=5, part=80, whole=100))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents; what holds a hit or two in much else stays whole."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = free_name(docs, "hits")
    found = decontaminate(docs, benchmark, to=hits)
    return found.where(~contaminated(F.col(hits))).drop(hits)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind, and count the characters anew."""
    masked = mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the copies it takes of each."""
    return take(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
]

#: A trained classifier is not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
