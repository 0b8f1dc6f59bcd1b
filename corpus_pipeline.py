"""A training-data pipeline over ``documents``: language, near duplicates, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and reread as the next stage's docs. All
but the last keep the columns of ``documents``, whatever they are called. The last gives token ids with their digests.

Defined results: a null, empty or letterless text is rejected by the first stage; very long texts are treated whole; of rows equal in
id and text one stays; an empty table gives empty stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontaminate, jaccard, langid, secrets
from tickloom.llm.common import free_names, quoted, table, written

#: A text whose best language has less than this share of the belief is rejected.
LEAST_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, null texts, and texts whose language is in doubt. Learns from rows that are not held out."""
    model = langid.fit(docs.where(~langid.held_out()))
    lang, score = free_names(docs, "lang", "score")
    judged = langid.identify(docs, model, lang, score)
    return judged.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*quoted(docs))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join stays: that with the smallest id."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more lie in windows of benchmark items; the others stay as they are."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret's span; n_chars follows the text where it changed."""
    (before,) = free_names(docs, "before")
    after = secrets.redacted(docs.withColumn(before, F.length("text")))
    changed = F.length("text") != F.col(before)
    n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars"))
    return after.select(*[n_chars.cast(kind).alias(name) if name == "n_chars" else column for (name, kind), column in zip(docs.dtypes, quoted(docs), strict=True)])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: SQL expresses neither the language model nor the encoding; tests hold each stage against its operator, which has a brute-force test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each written and reread, over ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
