"""A training corpus from ``documents`` in five stages, each written as Parquet before the next one reads it.

1. Language identification: texts in which no language can be told (no letter, empty, null) go.
2. Near-duplicates: one document of each class stays.
3. Decontamination: documents that hold a passage of ``benchmark`` go.
4. Secrets: every secret is replaced by a mark; ``n_chars`` follows. No document goes.
5. Mixing: every document is taken as often as the weights of the sources ask, as one row for each copy.

Every stage works on all rows that the one before it kept and returns their columns. Rows of an empty table, null
texts, repeated rows and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, langid, mixing, neardup, secrets
from lodestone.llm.common import complete, cut, free, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a language, under a model of their own labelled texts that are not held out."""
    lang, score = free(docs, "lang", "score")
    found = langid.predict(docs, "text", langid.train_on_documents(docs), lang, score, None)
    return found.where(F.col(lang) != langid.UNKNOWN).select(*[found[f"`{c}`"] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_masks", secret_masks),
    ("source_mix", source_mix),
]

#: SQL can express neither the language model nor the sampling: the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The mix, after all stages.

    With a ``folder``, each stage's table stays there under the stage's name, and a run that finds it complete goes on from it. Without one,
    the tables are in the shared folder and go when the driver exits.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        if folder is None:
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
            continue
        path = f"{folder.rstrip('/')}/{k}-{name}"
        if not complete(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
