"""Queries of the training-data operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
import public_tokenizers
from tickloom.llm import bpe, decontaminate, fixity, jaccard, langid, lexical, lm, rans, resample, secrets, topk, urlrules, walks
from tickloom.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op1_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op2_query(table(spark, sf_dir, "documents"))


def op3_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.op3_query(table(spark, sf_dir, "pages"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op4_query(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op5_query(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op6_query(table(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return lm.scored(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return rans.op9_query(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.op10_query(table(spark, sf_dir, "pages"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.op11_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.op12_query(table(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.op13_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontaminate": op1_decontaminate, "op2_topk": op2_topk, "op3_fixity": op3_fixity, "op4_langid": op4_langid, "op5_secrets": op5_secrets, "op6_jaccard": op6_jaccard, "op7_lm": op7_lm, "op8_bpe": op8_bpe, "op9_rans": op9_rans, "op10_urlrules": op10_urlrules, "op11_resample": op11_resample, "op12_fingerprints": op12_fingerprints, "op13_lexical": op13_lexical, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.op1_sql(), "op2_topk": topk.op2_sql(), "op3_fixity": fixity.op3_sql(), "op5_secrets": secrets.op5_sql(), "op6_jaccard": jaccard.op6_sql(), "op10_urlrules": urlrules.op10_sql(), "op11_resample": resample.op11_sql(), "op13_lexical": lexical.op13_sql()}
