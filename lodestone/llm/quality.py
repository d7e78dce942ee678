"""Quality by ordinal cumulative-link regression on graded ratings.

One weight for each hashed feature of a text gives a score s; ordered thresholds t1 < t2 < ... turn it into
P(grade > k) = 1 / (1 + exp(t_k - s)). All grades share the weights, so a rating of any grade teaches all of them. The
expected grade is the sum of these tail probabilities, and selection asks for one of them.

Features are a text's distinct words, its distinct word shapes, and marks of its form (shares of capitals, of
signs, of repeated words), each hashed to ``CELLS`` weights.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import free, ship, table

CELLS = 1 << 18
#: The model is fitted to at most about this many rated texts, those with the lowest hashes of their ids.
MAX_TRAIN_ROWS = 8000
_WORD = re.compile(r"\w+|[^\w\s]+")


class _Cells(dict):
    """feature -> cell; bounded (some 20 MB), long features are not kept."""

    def __missing__(self, f: str) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        c = xxhash.xxh64_intdigest(f) & (CELLS - 1)
        if len(f) < 64:
            self[f] = c
        return c


_CELLS = _Cells()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(cells, values) of a whole text; an empty text has the bias alone."""
    words = Counter(_WORD.findall(text))
    n = sum(words.values())
    low = {w.lower() for w in words}
    cells = list(map(_CELLS.__getitem__, low))
    vals = [1.0] * len(cells)
    form: dict[str, float] = {"#bias": 1.0}
    if n:
        signs = sum(k for w, k in words.items() if not (w[0].isalnum() or w[0] == "_"))
        upper = sum(k for w, k in words.items() if len(w) > 1 and w.isupper())
        short = sum(k for w, k in words.items() if len(w) <= 2)
        for name, x in (("signs", signs / n), ("upper", upper / n), ("distinct", len(low) / n), ("top", max(words.values()) / n), ("short", short / n), ("lines", text.count("\n") / n)):
            form[f"#{name}={int(min(x, 1) * 10)}"] = 1.0
            form[f"#{name}"] = min(x, 1.0)
        form[f"#len={int(np.log2(n))}"] = 1.0
    for f, x in form.items():
        cells.append(_CELLS[f])
        vals.append(4.0 * x)
    return np.array(cells, dtype=np.int64), np.array(vals, dtype=np.float32)


@dataclass
class Model:
    w: np.ndarray
    thresholds: np.ndarray  #: ascending, one fewer than the grades

    def tails(self, texts: list[str]) -> np.ndarray:
        """[text, k]: P(grade > k)."""
        s = np.array([float(self.w[c] @ v) for c, v in map(features, texts)]) if texts else np.zeros(0)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - s[:, None], -50, 50)))


def loss_gradient(w: np.ndarray, theta: np.ndarray, owner: np.ndarray, cells: np.ndarray, vals: np.ndarray, grade: np.ndarray, weight: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The penalised log-likelihood of the grades and its gradient by the feature weights and by ``theta``, the first threshold and the logarithms of the steps to the next ones.

    Row ``owner[i]`` has the feature ``cells[i]`` with the value ``vals[i]``; ``weight`` is what each row counts.
    """
    f = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    n, n_grades = len(grade), len(theta) + 1
    s = np.bincount(owner, w[cells] * vals, minlength=n)
    th = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
    edge = np.concatenate([[-np.inf], th, [np.inf]])
    hi, lo = f(edge[grade + 1] - s), f(edge[grade] - s)
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi), lo * (1 - lo)
    gth = np.bincount(grade + 1, weight * dhi / p, minlength=n_grades + 1) - np.bincount(grade, weight * dlo / p, minlength=n_grades + 1)
    back = np.cumsum(gth[1:-1][::-1])[::-1]
    gs = weight * (dlo - dhi) / p
    loss = float((weight * np.log(p)).sum() - l2 / 2 * (w**2).sum())
    return loss, np.bincount(cells, gs[owner] * vals, minlength=len(w)) - l2 * w, np.concatenate([[back[0]], back[1:] * np.exp(theta[1:])])


def fit(rows: list[np.ndarray], vals: list[np.ndarray], grade: np.ndarray, n_grades: int, epochs: int = 200, l2: float = 1e-4, rare: float = 3e-3, screen: float = 4.5) -> Model:
    """Penalised maximum likelihood by accelerated gradient steps over all rows; grades weigh alike. The same on every run."""
    n = len(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    used, cells = np.unique(np.concatenate(rows), return_inverse=True)
    vals_ = np.concatenate(vals).astype(np.float64)
    # Only features that tell grades apart beyond chance take part: at some cut, the share of rows above it that have
    # the feature differs from the share below by ``screen`` standard errors.
    live = np.zeros(len(used))
    has = np.bincount(cells, minlength=len(used))
    for k in range(n_grades - 1):
        up = grade > k
        n1, n0 = up.sum(), n - up.sum()
        if n1 and n0:
            above = np.bincount(cells, up[owner], minlength=len(used))
            share = has / n
            z = np.abs(above / n1 - (has - above) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
            live[(z >= screen) & (has >= 5)] = 1
    live[np.isin(used, [_CELLS[f] for f in ("#bias", "#signs", "#upper", "#distinct", "#top", "#short", "#lines")])] = 1
    on = live[cells] > 0
    owner, vals_, cells = owner[on], vals_[on], cells[on]
    weight = 1.0 / np.maximum(np.bincount(grade, minlength=n_grades), 1)[grade]
    weight /= weight.sum()
    # Every feature is scaled by its own curvature, but rare ones less, so that they move less than they seem to tell.
    scale = 1 / np.sqrt(np.bincount(cells, weight[owner] * vals_**2, minlength=len(used)) + rare)
    vals_ = vals_ * scale[cells]
    gradient = lambda w, theta: loss_gradient(w, theta, owner, cells, vals_, grade, weight, l2)[1:]

    # Step size: the curvature is at most that of the weighted squares of the rows, found by the power method.
    x = np.ones(len(used)) / np.sqrt(len(used))
    for _ in range(12):
        y = np.bincount(cells, (weight * np.bincount(owner, x[cells] * vals_, minlength=n))[owner] * vals_, minlength=len(used))
        top = np.linalg.norm(y)
        x = y / max(top, 1e-12)
    rate = 1.0 / (0.5 * top + l2 + 1e-9)
    w, theta = np.zeros(len(used)), np.concatenate([[-1.0], np.zeros(n_grades - 2)])
    w1, t1 = w, theta
    for step in range(1, epochs + 1):
        k = (step - 1) / (step + 2)
        yw, yt = w + k * (w - w1), theta + k * (theta - t1)
        gw, gt = gradient(yw, yt)
        w1, t1 = w, theta
        w, theta = yw + rate * gw, yt + min(4 * rate, 1.0) * gt
    full = np.zeros(CELLS)
    full[used] = w * scale * live
    return Model(full, theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))]))


def train(rated: DataFrame, text: str, grade: str, by: str, n_grades: int, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """A model from (text, grade) rows; rows with a null in either teach nothing. Without any row, all tails are even.

    Rows with equal ``by`` are in the sample together; however long texts are they are read whole; other columns are not read.
    """
    ship(rated.sparkSession)
    rows = rated.where(F.col(text).isNotNull() & F.col(grade).isNotNull()).select(F.col(text).alias("t"), F.col(grade).cast("int").alias("g"), F.xxhash64(F.lit(5), F.col(by).cast("string")).alias("h"))
    n = rows.count()
    u = F.pmod("h", F.lit(1 << 30)) / (1 << 30)
    if n > max_rows:
        rows = rows.where(u < max_rows / n)

    def hashed(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks:
            got = [features(t) for t in b["t"]]
            yield pd.DataFrame({"h": b["h"], "g": b["g"], "c": [c.astype(np.int32) for c, _ in got], "v": [v for _, v in got]})

    got = rows.mapInPandas(hashed, "h long, g int, c array<int>, v array<float>").toPandas()
    if not len(got):
        return Model(np.zeros(CELLS), np.zeros(n_grades - 1))
    got = got.assign(n=got["c"].map(len)).sort_values(["h", "g", "n"])
    return fit([np.asarray(c, dtype=np.int64) for c in got["c"]], [np.asarray(v, dtype=np.float32) for v in got["v"]], got["g"].to_numpy().clip(0, n_grades - 1), n_grades)


def grade(docs: DataFrame, text: str, model: Model, at_least: int = 1, least_tail: float = 0.5, expected: str = "expected_grade", tail: str = "tail", keep: str = "keep") -> DataFrame:
    """``docs`` with ``expected`` (the expected grade), ``tail`` (the probability of ``at_least`` or better) and ``keep``.

    A null text counts as empty and is graded like any other; however long texts are they are read whole; a tail equal to ``least_tail``
    is kept. Repeated rows are graded alike and an empty table gives an empty one. Columns of ``docs`` named as the three results are
    replaced, all others pass through.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # CELLS weights
    cols = [c for c in docs.columns if c not in (expected, tail, keep)]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            p = held.value.tails(["" if t is None else t for t in part])
            yield pd.DataFrame({"e": p.sum(axis=1), "p": p[:, at_least - 1]})

    udf = F.pandas_udf(run, "e double, p double")
    (name,) = free(docs, "q")
    rows = docs.withColumn(name, udf(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return rows.select(*[rows[f"`{c}`"] for c in cols], F.col(f"{name}.e").alias(expected), F.col(f"{name}.p").alias(tail), (F.col(f"{name}.p") >= least_tail).alias(keep))


def ratings(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Graded texts: 0 for toxic ones, 1 for others of low quality, 2 for others of high quality; of several labels of an id the lowest counts."""
    g = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    one = labels.groupBy("doc_id").agg(F.min(g).alias("grade"))  # a document teaches once, by its lowest rating
    return docs.select("doc_id", "text").join(one, "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; ``keep`` asks for a grade above that of toxic texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(ratings(docs, table(spark, sf_dir, "labels")), "text", "grade", "doc_id", 3)
    return grade(docs, "text", model).select("doc_id", "expected_grade", F.col("tail").alias("p_not_toxic"), "keep")
