"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

1. A shingle of five words weighs its count in the text times 1 + ln(N / df) / (2 ln N), df over all documents: the
   factor is bounded, since an unbounded one lets the few words by which the copies in a large group differ outweigh all they share.
2. Each text gets ``BANDS * ROWS`` consistent weighted samples; two texts agree in one with the
   probability of their weighted Jaccard similarity. Texts that agree in all rows of a band are candidates. The samples, and nothing
   else, take df from ``DF_CELLS`` hashed cells, a table of one size at any corpus size: candidates need no exact weights.
   Comparisons count df exactly, over all documents.
3. In each bucket every text is compared with the bucket's leader, so the comparisons are as many as the members. The leader is the
   text with the most company in all its buckets, which in a group of copies is one close to the original.
   Where members of a bucket still belong to different classes, further members lead, eight times as many in each round, until every pair
   of a bucket lies in one class, has been compared, or can't be similar: a text shares with others at most its shingles that some
   other open text has as well. Pairs inside a class are never made.
4. Links join classes where the weighted Jaccard similarity of the whole texts, by exact document frequencies, is at least ``threshold``. As a
   weight is between 1 and 1 + IDF_SHARE for each count, the similarity of the counts alone bounds it from both sides; document frequencies are
   only counted, over all documents, for the texts of pairs that these bounds leave open and for those of buckets that need further leaders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import components, cut, cut_counted, free, ship, table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
DF_CELLS = 1 << 18
#: Texts that are compared with a leader in one place.
PAIRS = 2048
#: Leaders that may be broadcast (some 300 bytes each); more are joined by a shuffle, in which large buckets can be split.
BROADCAST_FRONT = 20_000
#: Keys of texts or buckets that may be broadcast (about 50 bytes each in a hash table; the driver holds several such tables); more are joined by a shuffle.
BROADCAST_KEYS = 300_000
_M = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int64(0x5EED)  #: the one bucket of texts without words
#: A shingle that every text has weighs 1, one that a single text has weighs 1 + IDF_SHARE.
IDF_SHARE = 0.5
#: Cells in which the shingles of open texts are marked (a bit each).
OPEN_CELLS = 1 << 24
#: Bits of the filter of shingles whose frequency is counted, for each of them; its bits at most, which each Python worker holds (64 megabytes); its 64-bit numbers in a page.
FILTER_BITS, FILTER_MOST, FILTER_PAGE = 16, 1 << 29, 4096
_BASE = 0x100000001B3  #: odd, so it has an inverse modulo 2**64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> the code point in lower case if it is part of a word, else 0."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c == "_" or c.isalnum():
            out[i] = ord(c.lower()[0])
    return out


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in order, words of each text). A word is a run of letters, digits and underscores.

    All characters are taken together: a word's hash is a difference of running sums, moved to where the word begins.
    """
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(lens + 1) - lens - 1
    codes = _letters()[np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    word = np.zeros(len(codes) + 2, dtype=np.int8)
    word[1:-1] = codes != 0
    edge = np.diff(word)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(1 << max(20, int(len(codes)).bit_length()))
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    h = _mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return h, np.diff(np.append(np.searchsorted(first, start), len(first)))


def all_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of every shingle, in no order. A text of fewer than five words is one shingle."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not texts:
        return none
    flat, n = word_hashes(texts)
    start = np.cumsum(n) - n
    owner, values = [], []
    if len(flat) >= SHINGLE:
        s = np.zeros(len(flat) - SHINGLE + 1, dtype=np.uint64)
        for k in range(SHINGLE):
            s = s * _M + flat[k : k + len(s)]
        who = np.repeat(np.arange(len(texts)), n)
        inside = who[: len(s)] == who[SHINGLE - 1 :]
        owner.append(who[: len(s)][inside])
        values.append(_mix(s[inside]))
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        s = np.uint64(n[i])
        with np.errstate(over="ignore"):
            for h in flat[start[i] : start[i] + n[i]]:
                s = s * _M + h
        owner.append(np.array([i]))
        values.append(_mix(np.array([s], dtype=np.uint64)))
    return (np.concatenate(owner), np.concatenate(values)) if owner else none


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), sorted by text and hash."""
    return _grouped(*all_shingles(texts))


def _grouped(o: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of text and shingle in order, and how often each occurs."""
    order = np.argsort(v)
    by = o[order]
    order = order[np.argsort(by.astype(np.uint16) if len(o) and o.max() < 1 << 16 else by, kind="stable")]  # 16 bits are sorted by counting
    o, v = o[order], v[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    return o[at], v[at], np.diff(np.append(at, len(o)))


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - int(math.log2(DF_CELLS)))).astype(np.int64)


@lru_cache(1)
def _draws() -> tuple[np.ndarray, np.ndarray]:
    """65,536 quantiles of Gamma(2, 1) and their logarithms."""
    u = (np.arange(65536) + 0.5) / 65536
    x = np.maximum(-np.log1p(-u), 1e-6) + 0.5
    for _ in range(60):
        x = np.maximum(x - (1 - np.exp(-x) * (1 + x) - u) / np.maximum(x * np.exp(-x), 1e-12), x / 4)
    return x.astype(np.float32), np.log(x).astype(np.float32)


def samples(owner: np.ndarray, s: np.ndarray, weight: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """[text, k] samples as 32-bit values; texts that own no shingle get zeros."""
    out = np.zeros((n_texts, k), dtype=np.uint32)
    if not len(s):
        return out
    gamma, log_gamma = _draws()
    has, first = np.unique(owner, return_index=True)
    lnw = np.log(weight).astype(np.float32)
    rng = np.random.Generator(np.random.PCG64(20240229))
    odd = rng.integers(0, 1 << 63, size=(k, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.uint64(0xFFFF)
    for j in range(k):
        x = s * odd[j, 0]
        x ^= x >> np.uint64(32)
        x *= odd[j, 1]
        r = gamma[(x >> np.uint64(48)).astype(np.int64)]
        lnc = log_gamma[((x >> np.uint64(32)) & low).astype(np.int64)]
        beta = ((x >> np.uint64(16)) & low).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(lnw / r + beta)
        a = lnc - r * (t - beta + np.float32(1))
        bits = a.view(np.int32)
        bits = bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))
        mark = (s + t.astype(np.int64).astype(np.uint64) * _M) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
        packed = (bits.astype(np.int64) << np.int64(32)) | mark.astype(np.int64)
        out[has, j] = (np.minimum.reduceat(packed, first) & np.int64(0xFFFFFFFF)).astype(np.uint32)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """[text, band] keys from samples."""
    n, k = sig.shape
    parts = sig.reshape(n, k // ROWS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, k // ROWS + 1, dtype=np.uint64), (n, k // ROWS)).copy()
    for r in range(ROWS):
        key = _mix(key * _M + parts[:, :, r])
    return key.astype(np.int64)


def _pieces(texts: list[str], chars: int = 250_000) -> Iterator[tuple[int, list[str]]]:
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) < chars):
            size += len(texts[end])
            end += 1
        yield start, texts[start:end]
        start = end


def cell_idf(texts: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """idf of every cell, from all rows, and their number: counts are summed in each task, then across tasks."""

    def count(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, rows = np.zeros(DF_CELLS, dtype=np.int64), 0
        for block in blocks:
            rows += len(block)
            for _, part in _pieces(block.iloc[:, 0].tolist()):
                owner, s = all_shingles(part)
                own = np.sort(owner * DF_CELLS + _cells(s))
                own = own[np.diff(own, prepend=-1) > 0]  # a document counts once in a cell
                cells += np.bincount(own % DF_CELLS, minlength=DF_CELLS)
        at = np.flatnonzero(cells)
        yield pd.DataFrame({"cell": np.append(at, -1), "n": np.append(cells[at], rows)})

    got = texts.select(text).mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = int(got.loc[got["cell"] == -1, "n"].sum())
    df = np.zeros(DF_CELLS)
    got = got[got["cell"] >= 0]
    df[got["cell"].to_numpy()] = got["n"].to_numpy()
    return (1 + IDF_SHARE * np.log(max(n, 1) / np.maximum(df, 1)) / math.log(n + 1.5)).astype(np.float32), n


def _open_cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - int(math.log2(OPEN_CELLS)))).astype(np.int64)


def _marked(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which of the cells are set in ``bits``, 64 cells a number."""
    return ((bits[cells >> 6] >> (cells & 63)) & 1).astype(bool)


def filter_words(n: int) -> int:
    """64-bit numbers in a filter of ``n`` shingles, a power of two."""
    return max(FILTER_PAGE, 1 << math.ceil(math.log2(max(1, min(n * FILTER_BITS, FILTER_MOST) / 64))))


def _spots(s: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of a filter in which each shingle is marked, and its three bits there."""
    one, low = np.uint64(1), np.uint64(63)
    bits = one << (s & low) | one << (s >> np.uint64(6) & low) | one << (s >> np.uint64(12) & low)
    return (s >> np.uint64(65 - n_words.bit_length())).astype(np.int64), bits.view(np.int64)


def _merged(w: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, and all bits of each."""
    order = np.argsort(w)
    w, bits = w[order], bits[order]
    at = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
    return w[at], np.bitwise_or.reduceat(bits, at) if len(at) else bits


def _gathered(arrays: Iterator[np.ndarray], most: int = 2_000_000) -> Iterator[np.ndarray]:
    """The arrays joined, up to some two million values at a time."""
    parts, size = [], 0
    for a in arrays:
        parts.append(a)
        size += len(a)
        if size > most:
            yield np.concatenate(parts)
            parts, size = [], 0
    if size:
        yield np.concatenate(parts)


def counted(texts: DataFrame) -> DataFrame:
    """(key, total, s, w) of ``texts`` (key, t): the shingles in order (as unsigned numbers), how often each occurs, and the sum of that."""

    def own(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            keys = block["key"].to_numpy()
            for start, part in _pieces(block["t"].tolist()):
                owner, s, c = shingles(part)
                ends = np.cumsum(np.bincount(owner, minlength=len(part)))[:-1]
                got_s, got_c = np.split(s.view(np.int64), ends), np.split(c.astype(np.float32), ends)
                yield pd.DataFrame({"key": keys[start : start + len(part)], "total": np.bincount(owner, c, minlength=len(part)), "s": pd.Series(got_s, dtype=object), "w": pd.Series(got_c, dtype=object)})

    return texts.mapInPandas(own, "key long, total double, s array<long>, w array<float>")


def occurrences(each: DataFrame, rows: DataFrame) -> DataFrame:
    """(s, df): in how many rows of ``rows`` (t) the shingles of ``each``, which counted() made, are; several lines for a shingle add up.

    A filter of the shingles of ``each`` tells which are counted. It grows with ``each``, so the others that it lets through stay a small part.
    """
    n_words = filter_words(each.agg(F.sum(F.size("s"))).first()[0] or 0)

    def mark(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for s in _gathered(np.asarray(s, dtype=np.int64).view(np.uint64) for block in blocks for s in block["s"]):
            w, bits = _merged(*_spots(np.unique(s), n_words))
            yield pd.DataFrame({"page": (w // FILTER_PAGE).astype(np.int32), "w": (w % FILTER_PAGE).astype(np.int32), "bits": bits})

    def merge(page: pd.DataFrame) -> pd.DataFrame:
        words = np.zeros(FILTER_PAGE, dtype=np.int64)
        w, bits = _merged(page["w"].to_numpy(dtype=np.int64), page["bits"].to_numpy(dtype=np.int64))
        words[w] = bits
        return pd.DataFrame({"page": page["page"].iloc[:1], "bits": [words.tobytes()]})

    marked = each.where("size(s) > 0").select("s").mapInPandas(mark, "page int, w int, bits long").groupBy("page").applyInPandas(merge, "page int, bits binary")
    words = np.zeros(n_words, dtype=np.int64)
    for page, bits in marked.toPandas().itertuples(index=False):
        words[page * FILTER_PAGE : (page + 1) * FILTER_PAGE] = np.frombuffer(bits, dtype=np.int64)
    held = each.sparkSession.sparkContext.broadcast(words)

    def count(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def some(part: list[str]) -> np.ndarray:
            owner, s = all_shingles(part)
            w, bits = _spots(s, n_words)
            here = held.value[w] & bits == bits
            return _grouped(owner[here], s[here])[1]  # a document counts once for a shingle

        for s in _gathered(some(part) for block in blocks for _, part in _pieces(block["t"].tolist())):
            value, df = np.unique(s, return_counts=True)
            yield pd.DataFrame({"s": value.view(np.int64), "df": df})

    return rows.select("t").mapInPandas(count, "s long, df long")


def weights(each: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(key, total, s, w) of ``each``, which counted() made: the same with each count times the shingle's weight.

    df is exact over the ``n`` rows of ``rows`` (t). A shingle of one row adds to the total alone, as no other text shares it. Shingles
    that are not in ``each`` make more to count, no other count.
    """
    df = occurrences(each, rows).groupBy("s").agg(F.sum("df").alias("df")).where("df > 1")
    flat = each.select("key", F.explode_outer(F.arrays_zip("s", "w")).alias("x")).select("key", F.col("x.s").alias("s"), F.col("x.w").alias("c"))
    weight = (F.col("c") * (1 + IDF_SHARE * F.log(n / F.coalesce("df", F.lit(1))) / math.log(n + 1.5))).cast("float")
    x = F.array_sort(F.filter(F.collect_list(F.struct((F.col("s").bitwiseXOR(F.lit(-(1 << 63)))).alias("o"), F.when(F.col("df").isNotNull(), weight).alias("w"))), lambda e: e["w"].isNotNull()))
    out = flat.join(df, "s", "left").groupBy("key").agg(F.coalesce(F.sum(weight.cast("double")), F.lit(0.0)).alias("total"), x.alias("x"))
    return out.select("key", "total", F.transform("x.o", lambda o: o.bitwiseXOR(F.lit(-(1 << 63)))).alias("s"), F.col("x.w").alias("w"))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray, float], b: tuple[np.ndarray, np.ndarray, float]) -> float:
    """Of two texts as (sorted shingles, their weights, weight of all shingles); two texts without shingles are alike."""
    if not a[2] and not b[2]:
        return 1.0
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), dtype=bool)
    both = float(np.minimum(a[1][at[same]], b[1][same]).sum(dtype=np.float64))
    return both / (a[2] + b[2] - both)


def _compare(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, j): the ``pairs`` (a, b) whose similarity j is ``least`` or more; texts: (key, total, s, w).

    Each a goes once to each part of ``PAIRS`` of its b, before them, so its shingles are not copied for each pair and no a is
    more than a part in one task.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64(F.lit(9), "b"), "parts").alias("part"))
    of = lambda k: texts.select(F.col("key").alias(k), "total", "s", "w")
    lead = parts.join(of("a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "total", "s", "w")
    rows = lead.unionByName(dealt.join(of("b"), "b").select("a", "part", "b", "total", "s", "w"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for block in blocks:
            found = []
            for k, (a, total, s, w) in enumerate(zip(block["a"].tolist(), block["total"].tolist(), block["s"], block["w"], strict=True)):
                own = np.asarray(s, dtype=np.int64).view(np.uint64), np.asarray(w, dtype=np.float32), total
                b = block["b"].iat[k]
                if b is None:
                    now = own[0].copy(), own[1].copy(), total
                elif (j := weighted_jaccard(now, own)) >= least:
                    found.append((a, b, j))
            yield pd.DataFrame(found, columns=["a", "b", "j"])

    found = rows.select("a", F.col("b").cast("string").alias("b"), "total", "s", "w").mapInPandas(run, "a long, b string, j double")
    return found.select("a", F.col("b").cast("long").alias("b"), "j")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """(doc_id, key, class_id, comp), a row for each row of ``docs``; ``class_id`` is the least id of its class, ``comp`` the class's key.

    ``key`` is the 64-bit hash of the text. Equal texts are one text. A null text counts as empty; all texts without words are
    one class. A class whose ids are all null has a null id. Of texts with equal company the one with the greater key leads; which one leads
    changes no class. However long texts are they are read whole; an empty table gives an empty table; other columns are not read.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(_text(text)).alias("key"), _text(text).alias("t"))
    by_cell, n_rows = cell_idf(rows, "t")
    idf = spark.sparkContext.broadcast(by_cell)  # one megabyte
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sketch(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            got = []
            for _, part in _pieces(block["t"].tolist()):
                owner, s, n = shingles(part)
                keys = band_keys(samples(owner, s, n * idf.value[_cells(s)], len(part), bands * ROWS))
                has = np.bincount(owner, minlength=len(part)) > 0
                got += [k if h else np.array([_NONE]) for k, h in zip(keys, has, strict=True)]
            yield pd.DataFrame({"doc_id": block["doc_id"], "key": block["key"], "bands": pd.Series(got, index=block.index, dtype=object)})

    sk = cut(rows.mapInPandas(sketch, f"doc_id {kind}, key long, bands array<long>"), "sketch")
    one = sk.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    one = cut(one, "texts")
    member = one.select("key", F.explode("bands").alias("band"))
    crowd = _small(member.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    member = member.join(crowd, "band").groupBy("key").agg(F.sum("n").alias("company"), F.collect_list(F.struct("band", "n")).alias("in"))
    member = cut(member.select("key", "company", F.explode("in").alias("x")).select("x.band", "key", "x.n", "company"), "buckets")
    lead = _small(member.groupBy("band").agg(F.max_by("key", F.struct("company", "key")).alias("lead")))
    member = cut(member.join(lead, "band"), "buckets")
    pairs = cut(member.where("key <> lead").select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
    keys = member.select(F.col("key").alias("k")).distinct()
    small = _small(keys)
    texts = cut(rows.join(small, F.col("key") == F.col("k"), "left_semi").groupBy("key").agg(F.first("t").alias("t")), "candidates")
    texts = cut(counted(texts), "shingles")
    # Similarities of counts from which the weighted one is at least the threshold, and below which it is not, whatever the weights are.
    sure, least = (r := 1 + IDF_SHARE) * threshold / (1 - threshold + r * threshold) + 1e-9, threshold / (threshold + (1 - threshold) * r) - 1e-9

    def weighed(keys: DataFrame) -> DataFrame:
        """The weights of the texts of these keys."""
        return cut(weights(cut(texts.join(_small(keys), "key", "left_semi"), "some"), rows, n_rows), "weights")

    judged = cut(_compare(pairs, texts, least), "judged")
    links, doubt = judged.where(F.col("j") >= sure).select("a", "b"), judged.where(F.col("j") < sure).select("a", "b")
    if not doubt.isEmpty():
        ends = doubt.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        links = links.unionByName(cut(_compare(doubt, weighed(ends), threshold).select("a", "b"), "links"))
    comp = components(links)
    (left, n_left), leaders = _open(member.where("n > 2 AND key <> lead").select("band", "key", "company"), comp), 4
    if n_left:
        left = left.join(_shares(left.select("key").distinct(), texts), "key").where(f"shared >= {least} * weight").drop("weight", "shared")
        left, n_left = _open(left.select("band", "key", "company"), comp)
    if n_left:
        texts = weighed(left.select("key").distinct())
        left = left.join(_shares(left.select("key").distinct(), texts), "key").where(f"shared >= {threshold} * weight")
        left, n_left = cut_counted(left.join(one.select("key", "bands"), "key"), "open")
    while n_left:
        # A partner of y is lighter than what y's shared part allows: so few of a bucket may be left that there is no pair.
        fits = f"least(shared, ashared) >= {threshold} * (weight + aweight - least(shared, ashared))"
        # Only the first ``leaders`` of a bucket are numbered, after each task has kept as many of its own; no bucket is put in order as a whole.
        place = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("company"), "key"))
        front = left.select("band", "key", "company", "weight", "shared", "comp", "bands").withColumn("r", place).where(F.col("r") <= leaders).drop("r")
        front, n_front = cut_counted(front.select("band", *[F.col(c).alias(f"a{c}") for c in ("key", "company", "weight", "shared", "comp", "bands")]), "front")
        small = F.broadcast(front) if n_front <= BROADCAST_FRONT else front
        # A pair is made under the member that comes first, in the first of the buckets that both are in, and so once.
        later = "(acompany > company OR acompany = company AND akey < key)"
        more = left.join(small, "band").where(f"{later} AND comp <> acomp AND {fits} AND band = array_intersect(bands, abands)[0]").select(F.col("akey").alias("a"), F.col("key").alias("b"))
        found, n_found = cut_counted(_compare(cut(more, "pairs"), texts, threshold).select("a", "b"), "links")
        if n_found:
            comp = _joined(comp, found)
        rest = left.join(front.select("band", F.col("akey").alias("key")), ["band", "key"], "left_anti").select("band", "key", "company", "weight", "shared", "bands")
        (left, n_left), leaders = _open(rest, comp), leaders * 8
    # A text that is its own class has its key for a component.
    named = one.select("key", "rep").join(comp.select(F.col("id").alias("key"), "comp"), "key", "left").select("key", "rep", F.coalesce("comp", "key").alias("comp"))
    # Only texts that belong with others have to look up the class; the rest are their own.
    joint = named.join(comp.select("comp").distinct(), "comp", "left_semi").groupBy("comp").agg(F.min("rep").alias("class_id"))
    named = cut(named.join(joint, "comp", "left").select(F.col("key").alias("k"), F.coalesce("class_id", "rep").alias("class_id"), "comp"), "classes")
    return sk.select("doc_id", "key").join(named, F.col("key") == F.col("k")).select("doc_id", "key", "class_id", "comp")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` after further links: only classes that links join are worked on."""
    of = lambda side: comp.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = components(named)
    moved = comp.join(more.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return cut(moved.unionByName(more.select("id", "comp").join(comp.select("id"), "id", "left_anti")), "comp")


def _open(members: DataFrame, comp: DataFrame) -> tuple[DataFrame, int]:
    """The members of buckets in which texts of different classes are left, with ``comp``, and their number."""
    now = members.join(comp.select(F.col("id").alias("key"), "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    mixed = _small(now.groupBy("band").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("band"))
    return cut_counted(now.join(mixed, "band"), "open")


def _small(df: DataFrame) -> DataFrame:
    """``df``, an aggregation of a table, broadcast if it has few rows, so that large buckets stay where they are. It is counted and worked out again."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _shares(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, weight, shared) of texts: ``shared`` is the weight of the shingles that at least two of them have, at least.

    Occurrences are counted in OPEN_CELLS hashed cells, as bits; cells that two shingles share only make ``shared`` larger.
    """
    spark = texts.sparkSession
    own = cut(texts.join(keys, "key", "left_semi").select("key", "total", "s", "w"), "own")

    def count(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(OPEN_CELLS, dtype=bool), np.zeros(OPEN_CELLS, dtype=bool)
        for block in blocks:
            for at in range(0, len(block), 256):
                s = np.concatenate([np.asarray(s, dtype=np.int64) for s in block["s"].iloc[at : at + 256]])
                c, n = np.unique(_open_cells(s.view(np.uint64)), return_counts=True)
                twice[c[(n > 1) | once[c]]] = True
                once[c] = True
        for name, flags in ((1, once), (2, twice)):  # 64 cells are a number
            words = np.packbits(flags, bitorder="little").view(np.int64)
            at = np.flatnonzero(words)
            yield pd.DataFrame({"w": at.astype(np.int32), "kind": name, "bits": words[at]})

    found = own.select("s").mapInPandas(count, "w int, kind int, bits long")
    # A cell is shared if one task saw it twice or two tasks saw it.
    both = F.expr("aggregate(collect_list(IF(kind = 1, bits, NULL)), named_struct('o', 0L, 't', 0L), (a, x) -> named_struct('o', a.o | x, 't', a.t | (a.o & x)), a -> a.t)")
    shared = found.groupBy("w").agg(both.alias("t"), F.coalesce(F.bit_or(F.expr("IF(kind = 2, bits, NULL)")), F.lit(0).cast("long")).alias("u")).select("w", F.expr("t | u").alias("bits")).where("bits <> 0").toPandas()
    flags = np.zeros(OPEN_CELLS // 64, dtype=np.int64)
    flags[shared["w"].to_numpy(dtype=np.int64)] = shared["bits"].to_numpy(dtype=np.int64)
    held = spark.sparkContext.broadcast(flags)  # OPEN_CELLS bits: two megabytes

    def weigh(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            weight, shared_ = [], []
            for total, s, w in zip(block["total"], block["s"], block["w"], strict=True):
                w = np.asarray(w, dtype=np.float64)
                weight.append(total)
                shared_.append(float(w[_marked(held.value, _open_cells(np.asarray(s, dtype=np.int64).view(np.uint64)))].sum()))
            yield pd.DataFrame({"key": block["key"], "weight": weight, "shared": shared_})

    return own.mapInPandas(weigh, "key long, weight double, shared double")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of ``docs`` for each class, with its own columns: one with the class's id and, of those, with the least key; any if ids are null.

    Classes are told apart by their texts, so rows of different classes stay also where they have one id. Of equal rows one stays.
    """
    name, key2, key = free(docs, "class", "k", "key")
    got = cut(classes(docs, doc_id, text, **how), "kept")
    pick = got.where("doc_id <=> class_id").groupBy("comp").agg(F.min(F.struct("key", "doc_id")).alias("p"))
    pick = _small(pick.select(F.col("p.doc_id").alias(name), F.col("p.key").alias(key2)))
    row = docs.withColumn(key, F.xxhash64(_text(text)))
    row = row.join(pick, (F.col(key) == F.col(key2)) & F.col(doc_id).eqNullSafe(F.col(name)), "left_semi")
    return row.dropDuplicates([doc_id, key]).select(*[f"`{c}`" for c in docs.columns])


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and whether it is the one of its class that stays."""
    got = classes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("stays"))
