"""Registered queries of the training-data operators, with the SQL that checks them where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import bpe, checks, decontaminate, languages, licenses, lloyd, mixing, near, pii, quality, secrets, urls, warc, whiten
from marginalia.llm.shipping import ship

Runner = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.quality(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.drop("rejected_by")


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_counts(table(spark, folder, "documents"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages").select("page_id", "url"))


def op5_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    derived = warc.derivatives(warc.responses(table(spark, folder, "pages")), keep=["page_id"])
    return derived.drop("block")


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(table(spark, folder, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licenses(table(spark, folder, "documents"))


def op11_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return lloyd.clusters(table(spark, folder, "embeddings"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten.whitened(table(spark, folder, "embeddings"))


def op13_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.languages(table(spark, folder, "documents"))


QUERIES: dict[str, Runner] = {
    "op1_quality": op1_quality,
    "op2_personal_data": op2_personal_data,
    "op3_token_counts": op3_token_counts,
    "op4_url_filter": op4_url_filter,
    "op5_derivatives": op5_derivatives,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_mixing": op7_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_secrets": op9_secrets,
    "op10_licenses": op10_licenses,
    "op11_clusters": op11_clusters,
    "op12_whitening": op12_whitening,
    "op13_languages": op13_languages,
}
SQL: dict[str, str] = {
    "op1_quality": checks.QUALITY,
    "op4_url_filter": checks.URLS,
    "op5_derivatives": checks.DERIVATIVES,
    "op7_mixing": checks.MIXING,
    "op9_secrets": checks.SECRETS,
}
