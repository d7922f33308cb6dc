"""One query per operator, over the tables of a folder."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm import sql
from pressroom.llm.audit import filter_audit
from pressroom.llm.decontaminate import contamination
from pressroom.llm.exact import exact_groups
from pressroom.llm.html_main import extract_main
from pressroom.llm.langid import FOLDS, HELD_OUT, predict_languages
from pressroom.llm.licenses import licence_names, license_scan
from pressroom.llm.line_dedup import clean_lines
from pressroom.llm.lm import held_out, likelihoods
from pressroom.llm.mixing import mixed_documents
from pressroom.llm.near import near_groups
from pressroom.llm.negatives import hard_negatives, integer_vectors
from pressroom.llm.quality import GOOD, quality_scores
from pressroom.llm.rows import crc_fold, documents
from pressroom.llm.token_counts import token_counts


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    ids = F.array_sort(F.transform(F.coalesce("items", F.array()), lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(documents(spark, folder), digest=True).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("full_hash")).alias("text_sha256")
    )


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return quality_scores(documents(spark, folder), labels).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return extract_main(pages).withColumn("n_chars", F.length("text").cast("bigint"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_documents(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(documents(spark, folder), percent=85, width=3)


def op8_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return likelihoods(docs, docs.filter(~held_out())).withColumn("held_out", held_out())


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    held = F.coalesce(crc_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return predict_languages(documents(spark, folder)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan(documents(spark, folder))
    return found.select("doc_id", "n_sentences", F.size("matches").cast("bigint").alias("n_matches"), licence_names().alias("licenses"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = F.sha2(F.coalesce("kept", F.lit("")), 256)
    return clean_lines(documents(spark, folder)).select("doc.doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    given = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (given + 1) % 10).otherwise(given)
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        "vec_id", label.alias("label"), integer_vectors(F.col("embedding")).alias("v"), (F.col("vec_id") % 50 == 0).alias("anchor")
    )
    return hard_negatives(vectors)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_html_text": op5_html_text,
    "op6_mixing": op6_mixing,
    "op7_near_dedup": op7_near_dedup,
    "op8_language_model": op8_language_model,
    "op9_language_id": op9_language_id,
    "op10_licenses": op10_licenses,
    "op11_filter_audit": op11_filter_audit,
    "op12_line_dedup": op12_line_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": sql.OP1,
        "op2_exact_dedup": sql.OP2,
        "op6_mixing": sql.OP6,
        "op7_near_dedup": sql.OP7,
        "op11_filter_audit": sql.OP11,
        "op12_line_dedup": sql.OP12,
        "op13_hard_negatives": sql.OP13,
    }
