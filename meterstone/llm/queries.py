"""The registered queries of this package: name -> (Spark query, SQL oracle or None)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.llm import oracles, oracles_added
from meterstone.llm.brown_lm import score_texts
from meterstone.llm.common import bucket_of, documents
from meterstone.llm.compression_quality import fit_quality, quality_score
from meterstone.llm.cross_parse_language import fit_language, language
from meterstone.llm.context_pii import BASE, find_pii
from meterstone.llm.decontaminate import contaminated, decontaminate, n_hit
from meterstone.llm.hard_negatives import hard_negatives
from meterstone.llm.html_layout import visible_text
from meterstone.llm.merkle_manifest import fold, leaf_of, lower_ascii, manifest, proof
from meterstone.llm.mixing import mix
from meterstone.llm.partenum_join import jaccard_join
from meterstone.llm.shuffle_shards import shuffle_shards
from meterstone.llm.substring_dedup import repeats
from meterstone.llm.weak_rules import judge


def held_out(buckets: int, left_out: int) -> Column:
    return F.coalesce(bucket_of(F.col("doc_id"), buckets) == left_out, F.lit(False))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))


def op2_brown_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), bucket_of(F.col("id"), 7) != 2)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir)).drop("spans")


def op4_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return visible_text(pages).select("page_id", "page.title", "page.text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def op6_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])

    def number_of(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(number_of, BASE)
    return find_pii(documents(spark, sf_dir)).select(
        "doc_id",
        *counts,
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(
        documents(spark, sf_dir).select("doc_id", "text"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
    )
    hits = F.col("hits")
    return found.select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        n_hit(hits).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", hits["items"]), 256).alias("items_sha256"),
        contaminated(hits).alias("contaminated"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "votes",
        "posterior",
        "base_failed",
        "kept",
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_quality(
        docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), bucket_of(F.col("id"), 3) != 1
    )
    return quality_score(docs, model).select(
        "doc_id",
        held_out(3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = fit_language(docs, bucket_of(F.col("id"), 4) != 2)
    return language(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(4, 2).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower_ascii(F.col("text")))
    other = F.when(tampered.isNotNull(), leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), tampered))
    proven = manifest(documents(spark, sf_dir), other=other)
    folded = fold(F.coalesce("other", "leaf"), F.col("path"))
    return proven.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    sized = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return shuffle_shards(sized, 24).withColumn("grown_shard", F.lit(None).cast("int"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vec_id, label = F.col("vec_id"), F.col("label")
    turned = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(vectors, vec_id % 50 == 0, turned).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


QUERIES = {
    "op1_jaccard_join": (op1_jaccard_join, oracles.JACCARD_JOIN),
    "op2_brown_scoring": (op2_brown_scoring, None),
    "op3_substring_dedup": (op3_substring_dedup, oracles.SUBSTRING_DEDUP),
    "op4_html_layout": (op4_html_layout, None),
    "op8_quality_rules": (op8_quality_rules, None),
    "op9_quality_classifier": (op9_quality_classifier, None),
    "op10_language": (op10_language, None),
    "op5_mixing": (op5_mixing, None),
    "op6_context_pii": (op6_context_pii, None),
    "op7_decontamination": (op7_decontamination, oracles.DECONTAMINATION),
    "op11_merkle_manifest": (op11_merkle_manifest, oracles_added.MERKLE_MANIFEST),
    "op12_shuffle_shards": (op12_shuffle_shards, None),
    "op13_hard_negatives": (op13_hard_negatives, oracles_added.HARD_NEGATIVES),
}
