"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

Within each Arrow block the distinct pre-tokens form a small table whose piece counts come from the
tokenizer, once each (a bounded table of earlier counts carries over to later blocks of the task). It is
joined to the (document, pre-token, frequency) table of the block and summed; token ids never exist.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ship, table

#: Where the plain path is known to equal the library: printable ASCII, Latin-1 and Latin Extended-A.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ]*")
#: The pre-tokenizer's pattern with \p{L} and \p{N} written out for the plain range (lower case).
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ſ0-9²³¹¼½¾]+")


class PieceCounter:
    """Counts tokens as the library does for a ``.json`` tokenizer with a pre-tokenizer."""

    def __init__(self, path: str, max_entries: int = 300_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.max_entries = max_entries
        self.plain: dict[str, int] = {}
        self.mapped: dict[str, int] = {}

    def _general(self, text: str) -> Counter:
        norm = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        return Counter(p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm))

    def frequencies(self, text: str) -> tuple[Counter, Counter, int]:
        """Pre-token frequencies of one text: plain ones, library-mapped ones, special tokens."""
        plain, mapped, special = Counter(), Counter(), 0
        parts = [text]
        if self.split and any(s in text for s in self.special):
            special = len(self.split.findall(text))
            parts = self.split.split(text)
        for part in parts:
            if _PLAIN.fullmatch(part):
                plain.update(_WORD.findall(part.lower()))
            elif part:
                mapped.update(self._general(part))
        return plain, mapped, special

    def count(self, texts: list[str]) -> list[int]:
        docs = [self.frequencies(t) for t in texts]
        for cache in (self.plain, self.mapped):
            if len(cache) > self.max_entries:
                cache.clear()
        new = list({w for d in docs for w in d[0] if w not in self.plain})
        if new:
            for i in range(0, len(new), 2000):
                some = new[i : i + 2000]
                ids = self.tok.encode(" ".join(some), add_special_tokens=False).word_ids
                self.plain.update(zip(some, np.bincount(np.array(ids, dtype=np.int64), minlength=len(some)).tolist(), strict=True))
        for w in {w for d in docs for w in d[1] if w not in self.mapped}:
            self.mapped[w] = len(self.tok.model.tokenize(w))
        plain, mapped = self.plain, self.mapped
        return [sum(n * plain[w] for w, n in p.items()) + sum(n * mapped[w] for w, n in m.items()) + s for p, m, s in docs]


_COUNTERS: dict[str, PieceCounter] = {}


def _counter(path: str) -> PieceCounter:
    """One per Python worker, so that later tasks start from the pieces already counted."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, text: str, path: str | Callable[[], str], out: str = "n_tokens", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, UTF-8 bytes and token count of every whole text (null counts as empty: 0 tokens).

    ``path`` is the vocabulary file, or a function that finds it on the executor. Repeated rows stay,
    rows are independent, and other columns of ``docs`` are not read. However long texts are they are counted whole; an empty table
    gives an empty table.
    """
    ship(docs.sparkSession)
    rows = docs.select(*keys, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keys)])
    rows = rows.withColumn("n_bytes", F.octet_length("__text").cast("long"))

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(path() if callable(path) else path)
        for block in blocks:
            res = block[[*keys, "n_bytes"]].copy()
            res[out] = pd.Series(counter.count(block["__text"].tolist()), index=block.index, dtype="int64")
            yield res

    return rows.mapInPandas(run, f"{kinds}, n_bytes long, {out} long")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"), "text", vocabulary)
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)
