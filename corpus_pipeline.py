"""A corpus pipeline over ``documents``: language, near-duplicates, PII, source mix, packing.

Each stage works on all that its predecessor kept, and is written as Parquet and read again in between. All
stages but the last return the columns of ``documents``:

    language  documents that no trained language fits go: no letter, or a posterior share under one half;
              ``lang`` becomes the predicted language
    dedup     one document of each group of near-duplicates stays (its smallest doc_id)
    pii       texts are pseudonymised; ``n_chars`` is brought up to date
    mix       documents are repeated or dropped as the source mix takes them
    pack      pieces of token sequences with their places

Defined results, for every stage: an empty table gives an empty result; columns beyond those of ``documents`` pass
through, whatever their names; whole texts count, however long. Null and empty texts have no language, so they go
in ``language``; a stage that meets them all the same keeps them in ``dedup`` (a null text links with nothing), leaves
them as they are in ``pii``, takes none of them in ``mix`` (size 0) and packs the end id alone in ``pack``. A null doc_id
is a document of its own in every stage; a null lang or source is no obstacle (a null source is a source of its own).
Ties: equally likely languages go to the first by name, of equal texts the smallest doc_id stays. Rows that repeat
a whole document are copies in ``dedup``: one stays. Rows that share a doc_id but not the text are one document
there (see ``neardups``): all of them stay or go. In the other stages each row counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import language, mixing, neardups, packing, pseudonyms
from pathloom.llm.common import checkpoint_dir, free_names, remove

LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, score = free_names(docs.columns, "_lang", "_score")
    scored = language.identify(docs, language.train(docs), keep=(lang, score))
    kept = scored.where((F.col(lang) != language.UNKNOWN) & (F.col(score) >= LEAST_SHARE))
    return kept.withColumn("lang", F.col(lang)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardups.without_near_duplicates(docs)


def pseudonymise_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(docs, pseudonyms.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resampled(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs)


STAGES = [
    ("language", identify_language),
    ("dedup", drop_near_duplicates),
    ("pii", pseudonymise_pii),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL can't express these stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again.

    A stage's folder is removed when the next one is written; the last one's input stays, as the result is lazy.
    """
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if old:
            remove(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
