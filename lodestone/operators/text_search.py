"""The inverted index as a table, and the vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import LEAST, STOP_WORDS, WORD, stem


def index(df: DataFrame, key: str, *props: str) -> DataFrame:
    """(word, key, prop, n): stems of the indexed words of text properties, with their counts. Null texts have none.

    Each row's words are counted where the row is read. Only where keys repeat are counts shuffled, to add up those of rows with one key.
    """
    from lodestone.session import ship  # not imported in the executors

    ship(df.sparkSession)
    parts = None
    for p in props:
        rows = df.select(F.col(key).alias("key"), F.regexp_extract_all(F.lower(F.col(p)), F.lit(WORD), F.lit(0)).alias("ws"))
        schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("key", rows.schema["key"].dataType), T.StructField("n", T.LongType())])
        one = rows.mapInArrow(_count, schema).select("word", "key", F.lit(p).alias("prop"), "n")
        parts = one if parts is None else parts.unionByName(one)
    if df.groupBy(key).count().where("count > 1").isEmpty():
        return parts
    return parts.groupBy("word", "key", "prop").agg(F.sum("n").alias("n"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, words) to (stem, key, n). Each word is stemmed once in a batch."""
    for batch in batches:
        keys, lists = batch.columns
        kind, seen = lists.type.value_type, lists.flatten().dictionary_encode()
        numbers: dict[str, int] = {}
        of = [numbers.setdefault(stem(w), len(numbers)) if len(w) >= LEAST and w not in STOP_WORDS else -1 for w in seen.dictionary.to_numpy(zero_copy_only=False).tolist()]
        code = np.array(of, dtype=np.int64)[seen.indices.to_numpy()]
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())[code >= 0]
        cell, n = np.unique(row * len(numbers) + code[code >= 0], return_counts=True)
        row, code = np.divmod(cell, max(1, len(numbers)))
        yield pa.RecordBatch.from_arrays([pa.array(list(numbers), kind).take(pa.array(code)), keys.take(pa.array(row)), pa.array(n, pa.int64())], names=["word", "key", "n"])


def vocabulary(df: DataFrame, prefix: str, *props: str) -> DataFrame:
    """(word): the distinct words of text properties that begin with ``prefix``, in order."""
    words = F.array_distinct(F.concat(*[F.coalesce(F.regexp_extract_all(F.lower(F.col(p)), F.lit(WORD), F.lit(0)), F.array().cast("array<string>")) for p in props]))
    return df.select(F.explode(words).alias("word")).where(F.col("word").startswith(prefix.lower())).distinct().orderBy("word")
