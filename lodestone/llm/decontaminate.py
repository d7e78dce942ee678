"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask selects some of several neighbouring words and ignores the others, so a hash of the selected words survives a
substitution at an ignored place. Hashes of all benchmark windows meet those of all document windows in a join; each hit puts an
item and a document on a diagonal, along which the words around it are compared one by one. A
document is contaminated where some window of the diagonal has enough equal words. The masks are complete: wherever the words of a
window that are equal are enough, some mask selects equal words only at some place inside it, so every such window has a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, free, table

#: Places of the words that count. Each 16 words of which 3 differ have a hit, and so have 15 of which 2 differ.
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 7, 9, 10, 11))
#: For items of SPAN to 14 words, of which 2 may differ: each 11 words of which 2 differ have a hit.
SHORT_MASKS = ((0, 1, 3, 5, 6), (0, 1, 2, 8, 9))
#: Items of so many words may have words that differ.
SPAN = 11
#: A hit is verified by a window of this many words with at least this many equal ones.
WINDOW, NEED = 16, 13
#: Items of fewer words than SPAN are looked for whole; of fewer than this they are evidence only where they are all of a document.
LEAST_WORDS = 5
#: Benchmark seeds (about 100 bytes each in a hash table) that may be broadcast; more are joined by a shuffle.
BROADCAST_SEEDS = 300_000


def _words(c: Column) -> Column:
    """Hashes of the words, in order: maximal runs of letters and digits in lower case."""
    words = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed_sql(words: str, at: str, mask: tuple[int, ...], m: int) -> str:
    return f"xxhash64({m}, {', '.join(f'{words}[{at} + {k}]' for k in mask)})"


def _windows(span: int, seed: str, whole: bool) -> str:
    """SQL for the array of (i, seed) of all windows of the document's words; ``whole``: of the one that is all of it."""
    return f"IF(size(dw) {'<>' if whole else '<'} {span}, array(), transform(sequence(0, size(dw) - {span}), i -> named_struct('i', i, 'seed', {seed})))"


def _seed(words: str, at: str, mask: tuple[int, ...], m: int) -> Column:
    return F.expr(_seed_sql(words, at, mask, m))


def benchmark_seeds(bench: DataFrame, item_id: str, text: str) -> tuple[DataFrame, list[tuple[int, tuple[int, ...]]]]:
    """(seed, mask, j, item, words) of every distinct item, and the masks used, with their numbers.

    Equal items are one item under the least id; ``mask`` is the mask's number, or minus the length of a short item.
    """
    items = bench.select(F.col(item_id).alias("item"), _words(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("words"))
    items = cut(items.where(F.size("words") > 0).groupBy("words").agg(F.min("item").alias("item")), "items")
    lengths = {r[0] for r in items.where(F.size("words") < WINDOW - 1).select(F.size("words")).distinct().collect()}  # at most WINDOW - 1 - LEAST_WORDS values
    kinds, parts = list(enumerate(MASKS)), []
    if any(n >= SPAN for n in lengths):
        kinds += enumerate(SHORT_MASKS, len(MASKS))
    kinds += [(-n, tuple(range(n))) for n in sorted(lengths) if n < SPAN]
    for m, mask in kinds:
        span = mask[-1] + 1
        if m < 0:
            fit = F.size("words") == span
        elif m < len(MASKS):
            fit = F.size("words") >= WINDOW - 1
        else:
            fit = F.size("words").between(SPAN, WINDOW - 2)
        places = items.where(fit).withColumn("j", F.explode(F.expr(f"sequence(0, size(words) - {span})")))
        parts.append(places.select(_seed("words", "j", mask, m).alias("seed"), F.lit(m).alias("mask"), "j", "item", "words"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut(out, "seeds"), kinds


def overlaps(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, doc_id, item, matched, words): documents that hold a verified part of an item, once for each such pair.

    ``key`` tells texts apart, so rows with null or repeated ids are decided by their own text.
    ``matched`` is the largest number of equal words on one diagonal, ``words`` the item's length. Null texts are
    empty; empty tables, and items without words, give no rows. Equal items count as the one with the least id. Repeated rows give a row
    each, however long texts are they are read whole, and other columns are not read.
    """
    seeds, masks = benchmark_seeds(bench, item_id, item_text)
    n_seeds = seeds.count()
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(content).alias("key"), content.alias("t"))
    # Each row gives (place, seed) pairs made inside its array of words, so that no copy of the words goes with a pair.
    kinds = [_windows(mask[-1] + 1, _seed_sql("dw", "i", mask, m), -LEAST_WORDS < m < 0) for m, mask in masks]
    probe = rows.select("key", _words(F.col("t")).alias("dw")).select("key", F.explode(F.expr(f"concat({', '.join(kinds)})")).alias("w")).select("key", "w.i", "w.seed")
    seeds = F.broadcast(seeds) if n_seeds <= BROADCAST_SEEDS else seeds
    hits = cut(probe.join(seeds, "seed").select("key", (F.col("i") - F.col("j")).alias("diag"), "item", "words").distinct(), "hits")
    keys = cut(hits.select(F.col("key").alias("k")).distinct(), "keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_SEEDS else keys
    found = rows.join(keys, F.col("key") == F.col("k"), "left_semi")
    there = found.groupBy("key").agg(F.first("t").alias("t")).select(F.col("key").alias("k"), _words(F.col("t")).alias("dw"))
    hits = hits.join(there, F.col("key") == F.col("k"))
    # Only the document's words beside the item are compared.
    hits = hits.select("key", "item", "words", "diag", F.expr("slice(dw, greatest(diag, 0) + 1, least(size(words) + diag, size(dw)) - greatest(diag, 0))").alias("there"), F.expr("slice(words, greatest(-diag, 0) + 1, size(words))").alias("here"))
    hits = hits.select("key", "item", F.size("words").alias("words"), F.expr("transform(there, (w, k) -> IF(w = here[k], 1, 0))").alias("eq"))
    hits = hits.withColumn("win", F.least(F.lit(WINDOW), F.col("words")))
    best = F.expr("""aggregate(sequence(0, size(eq) - 1), named_struct('now', 0, 'most', 0),
        (a, k) -> named_struct('now', a.now + eq[k] - IF(k >= win, eq[k - win], 0), 'most', greatest(a.most, a.now + eq[k] - IF(k >= win, eq[k - win], 0))), a -> a.most)""")
    need = F.when(F.col("words") < SPAN, F.col("words")).otherwise(F.ceil(F.col("win") * (NEED / WINDOW)))
    hits = hits.where(best >= need)
    good = cut(hits.groupBy("key", "item").agg(F.max(F.expr("aggregate(eq, 0, (a, x) -> a + x)")).alias("matched"), F.max("words").alias("words")), "leaks")
    good = good.withColumnRenamed("key", "k")
    good = F.broadcast(good) if good.count() <= BROADCAST_SEEDS else good
    return rows.select("doc_id", "key").join(good, F.col("key") == F.col("k")).select("doc_id", "key", "item", "matched", "words")


def decontaminate(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts overlap no item, with all their columns; a null or empty text stays.

    Repeated rows go or stay together, however long texts are they are read whole, and empty tables give what is left: all of ``docs``.
    """
    key, key2 = free(docs, "key", "bad")
    bad = cut(overlaps(docs, bench, doc_id, text, item_id, item_text).select(F.col("key").alias(key2)).distinct(), "leaks")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_SEEDS else bad
    row = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    row = row.join(bad, F.col(key) == F.col(key2), "left_anti")
    return row.select(*[row[f"`{c}`"] for c in docs.columns])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and item."""
    got = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.groupBy("doc_id", F.col("item").alias("item_id")).agg(F.max("matched").cast("long").alias("n_matched"), F.max("words").cast("long").alias("n_words"))
