"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to ``order`` under escape method C, frozen after training: a symbol
seen after the longest known context costs -log2(n / (total + distinct)); an unseen one costs the escape
-log2(distinct / (total + distinct)) and is coded by the next shorter context, down to 1/256 for every byte.
A text's code length under a language is the sum over all its bytes, so the least code length is the likeliest language.

Each tree is flattened for scoring: a dense table maps the last ``order`` bytes, as classes, to the longest
context of the language, and a cost table has the exact code length of each next byte there. Scoring a block of texts is two
array look-ups for each byte and language. No context is left out, so the model grows with the distinct contexts of the training texts,
which ``max_train_docs`` bounds for each language (some 10 MB a language).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import free, ship, table

UNKNOWN = "und"


@dataclass
class Tree:
    """The context tree of one language."""

    classes: np.ndarray  #: byte -> class; class 0 holds all bytes never seen in training
    context: np.ndarray  #: classes of the last bytes -> where the row of the longest context begins in ``cost``
    cost: np.ndarray  #: [row, class] float32, bits


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]
    order: int


def _tree(grams: np.ndarray, n: np.ndarray, order: int) -> Tree:
    """``grams``: distinct (order + 1)-grams of bytes, the last byte lowest (texts start after ``order`` zero bytes); ``n``: how often each occurs."""
    grams, n = grams.astype(np.uint64), n.astype(np.float64)
    low = np.uint64(255)
    used = np.unique(np.concatenate([(grams >> np.uint64(8 * k)) & low for k in range(order + 1)] + [np.zeros(1, np.uint64)])).astype(np.int64)
    classes = np.zeros(256, dtype=np.int64)
    classes[used] = np.arange(1, len(used) + 1)
    a = len(used) + 1
    context = np.zeros((a,) * order, dtype=np.int64)
    costs, rows, last, last_cost = [], 0, None, np.full((1, a), 8.0)
    for k in range(order + 1):  # shorter contexts first; a longer one overwrites its suffixes
        part = grams & np.uint64((1 << (8 * (k + 1))) - 1)
        part, at = np.unique(part, return_inverse=True)
        count = np.bincount(at, n)
        ctx, row = np.unique(part >> np.uint64(8), return_inverse=True)
        seen, distinct = np.bincount(row, count), np.bincount(row)
        shorter = np.zeros(len(ctx), dtype=np.int64) if last is None else np.searchsorted(last, ctx & np.uint64((1 << (8 * (k - 1))) - 1))
        cost = last_cost[shorter] - np.log2(distinct / (seen + distinct))[:, None]
        cost[row, classes[(part & low).astype(np.int64)]] = -np.log2(count / (seen + distinct)[row])
        where = [classes[((ctx >> np.uint64(8 * j)) & low).astype(np.int64)] for j in range(k - 1, -1, -1)]
        if k:
            np.moveaxis(context, range(order - k, order), range(k))[tuple(where)] = ((rows + np.arange(len(ctx))) * a).reshape(-1, *[1] * (order - k))
        costs.append(cost.astype(np.float32))
        rows, last, last_cost = rows + len(ctx), ctx, cost
    return Tree(classes, context.reshape(-1).astype(np.int32 if rows * a < 1 << 31 else np.int64), np.concatenate(costs).reshape(-1))


def _fit(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Model:
    langs = sorted(counts)
    return Model(langs, [_tree(*counts[x], order) for x in langs], order)


def code_lengths(model: Model, texts: list[bytes], size: int = 500_000) -> np.ndarray:
    """Bits of each text under each language; texts are taken together up to about ``size`` bytes, longer ones alone."""
    order, pad = model.order, b"\0" * model.order
    out = np.zeros((len(texts), len(model.langs)))
    start = 0
    while start < len(texts):
        end, n = start, 0
        while end < len(texts) and (end == start or n + len(texts[end]) < size):
            n += len(texts[end])
            end += 1
        joined = np.frombuffer(b"".join(pad + t for t in texts[start:end]), dtype=np.uint8)
        lens = np.array([len(t) for t in texts[start:end]])
        at = np.cumsum(np.concatenate([[0], lens[:-1] + order]))
        for j, tree in enumerate(model.trees):
            cls, a = tree.classes[joined], int(round(len(tree.context) ** (1 / order)))
            key = np.zeros(len(cls) - order, dtype=np.int64)
            for k in range(order):
                key *= a
                key += cls[k : k + len(key)]
            bits = np.zeros(len(key) + 1)
            np.cumsum(tree.cost[tree.context[key] + cls[order:]], dtype=np.float64, out=bits[1:])
            out[start:end, j] = bits[at + lens] - bits[at]
        start = end
    return out


def train(docs: DataFrame, text: str, lang: str, by: str, order: int = 3, max_train_docs: int = 1000) -> Model | None:
    """A model from at most about ``max_train_docs`` texts of each language; None if no text has a language.

    The sample is the documents of each language with the lowest hashes of ``by``: a share of them that
    the language's count sets, so no group is ever gathered or sorted. Rows with a null in text or language teach nothing, however long
    texts are they are read whole, and repeated rows are in the sample together. Columns that are not named are not read.
    """
    ship(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.col(by).cast("string").alias("b"))
    n = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not n:
        return None
    share = F.create_map(*[x for lang_, k in n.items() for x in (F.lit(lang_), F.lit(float(min(1.0, max_train_docs / k))))])
    u = F.pmod(F.xxhash64(F.lit(17), "b", F.length("t")), F.lit(1 << 30)) / (1 << 30)
    some = rows.where(u < share[F.col("l")]).select("l", "t")

    def grams(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            for name, part in block.groupby("l"):
                data = np.frombuffer(b"".join(b"\0" * order + t.encode() for t in part["t"]), dtype=np.uint8).astype(np.uint64)
                key = np.zeros(max(0, len(data) - order), dtype=np.uint64)
                for k in range(order + 1):
                    key = (key << np.uint64(8)) | data[k : k + len(key)]
                key = key[(key & np.uint64(255)) != 0]  # the padding itself is not coded
                value, count = np.unique(key, return_counts=True)
                yield pd.DataFrame({"l": name, "g": value.astype(np.int64), "n": count.astype(np.int64)})

    found = some.mapInPandas(grams, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()
    counts = {name: (part["g"].to_numpy(), part["n"].to_numpy()) for name, part in found.groupby("l")}
    return _fit(counts, order) if counts else None


def predict(docs: DataFrame, text: str, model: Model | None, pred: str = "lang_pred", score: str = "score", rate: str | None = "bits_per_byte") -> DataFrame:
    """``docs`` with the likeliest language of every whole text, its posterior, and its bits per byte (null for ``und``).

    A null, empty or letterless text is ``und`` with score 0, and so is every text if there is no model. Equal code lengths
    go to the language first by code point. However long texts are they are read whole. Rows are independent, so repeated rows get equal results
    and an empty table gives an empty one. Columns of ``docs`` named as the three results are replaced, all others pass through.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # see above for its size
    cols = [c for c in docs.columns if c not in (pred, score, rate)]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for part in parts:
            n = len(part)
            lang, best, bpb = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.full(n, np.nan)
            ok = [i for i, t in enumerate(part) if t is not None and _has_letter(t)] if m else []
            for at in range(0, len(ok), 1024):
                some = ok[at : at + 1024]
                raw = [part.iloc[i].encode() for i in some]
                bits = code_lengths(m, raw)
                low = bits.min(axis=1)
                post = 1 / np.exp2(np.minimum(0, low[:, None] - bits)).sum(axis=1)
                for i, j, p, b, r in zip(some, bits.argmin(axis=1), post, low, raw, strict=True):
                    lang[i], best[i], bpb[i] = m.langs[j], p, b / len(r)
            yield pd.DataFrame({"l": lang, "s": best, "r": bpb})

    udf = F.pandas_udf(run, "l string, s double, r double")
    (name,) = free(docs, "p")
    out = docs.withColumn(name, udf(F.col(text).cast("string")))
    made = [F.col(f"{name}.l").alias(pred), F.col(f"{name}.s").alias(score)] + ([F.col(f"{name}.r").alias(rate)] if rate else [])
    return out.select(*[out[f"`{c}`"] for c in cols], *made)


def _has_letter(t: str) -> bool:
    return any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t)) or any(unicodedata.category(c)[0] == "L" for c in t if ord(c) > 127)


def _held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def train_on_documents(docs: DataFrame) -> Model | None:
    return train(docs.where(~_held_out()), "text", "lang", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_on_documents(docs)
    rows = docs.select("doc_id", _held_out().alias("held_out"), "text")
    return predict(rows, "text", model).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
