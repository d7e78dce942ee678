"""Vectors and matrices: array expressions where Spark has them, numpy in Arrow batches for what needs elimination."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR, MATRIX = T.ArrayType(T.DoubleType()), T.ArrayType(T.ArrayType(T.DoubleType()))


def rank_of(kind: T.DataType) -> int:
    """0 for a number, 1 for a vector, 2 for a matrix, -1 for anything else."""
    if isinstance(kind, T.NumericType):
        return 0
    if isinstance(kind, T.ArrayType):
        inner = rank_of(kind.elementType)
        return inner + 1 if 0 <= inner < 2 else -1
    return -1


def elementwise(op: str, a: str, b: str, rank: int) -> str:
    """``a op b`` for two vectors or two matrices of equal shape."""
    if rank == 1:
        return f"zip_with({a}, {b}, (x, y) -> x {op} y)"
    return f"zip_with({a}, {b}, (r, q) -> zip_with(r, q, (x, y) -> x {op} y))"


def scaled(op: str, a: str, b: str, rank: int) -> str:
    """Each element of ``a`` with the number ``b``."""
    if rank == 1:
        return f"transform({a}, x -> x {op} {b})"
    return f"transform({a}, r -> transform(r, x -> x {op} {b}))"


def transpose(a: str) -> str:
    return f"transform(sequence(1, size({a}[0])), j -> transform({a}, r -> element_at(r, j)))"


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x * y AS DOUBLE)), 0D, (s, x) -> s + x)"


def multiply(a: str, ra: int, b: str, rb: int) -> str:
    """Matrix products; a vector on the left is a row, on the right a column."""
    cell = lambda r, j: f"aggregate(sequence(1, size({r})), 0D, (s, k) -> s + CAST(element_at({r}, k) AS DOUBLE) * element_at(element_at({b}, k), {j}))"
    if ra == 1 and rb == 1:
        return dot(a, b)
    if ra == 2 and rb == 1:
        return f"transform({a}, r -> {dot('r', b)})"
    if ra == 1:
        return f"transform(sequence(1, size({b}[0])), j -> {cell(a, 'j')})"
    return f"transform({a}, r -> transform(sequence(1, size({b}[0])), j -> {cell('r', 'j')}))"


def norm(a: str, p: str | None) -> str:
    """The p-norm of a vector, 2 by default; infinite p is the largest absolute value."""
    if p is None or p in ("2", "2.0"):
        return f"sqrt(aggregate({a}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x))"
    return f"IF({p} = double('Infinity'), array_max(transform({a}, x -> abs(CAST(x AS DOUBLE)))), pow(aggregate({a}, 0D, (s, x) -> s + pow(abs(x), {p})), 1 / {p}))"


def trace(a: str) -> str:
    return f"aggregate(sequence(1, size({a})), 0D, (s, i) -> s + element_at(element_at({a}, i), i))"


def _each(f: Callable[[np.ndarray], object]) -> Callable[[pd.Series], pd.Series]:
    def run(part: pd.Series) -> pd.Series:
        out = []
        for m in part:
            try:
                out.append(None if m is None else f(np.array([list(r) for r in m], dtype=float)))
            except (np.linalg.LinAlgError, ValueError):
                out.append(None)  # singular, or not square
        return pd.Series(out, index=part.index, dtype=object)

    return run


def _inverse(m: np.ndarray) -> list[list[float]] | None:
    if np.linalg.matrix_rank(m) < len(m):
        return None
    return np.linalg.inv(m).tolist()


def _solve(ms: pd.Series, bs: pd.Series) -> pd.Series:
    """X with X * b = m; None where b is singular or the shapes do not fit."""
    out = []
    for m, b in zip(ms, bs, strict=True):
        try:
            x = None if m is None or b is None else np.linalg.solve(np.array([list(r) for r in b], dtype=float).T, np.array([list(r) for r in m], dtype=float).T).T
            out.append(None if x is None else x.tolist())
        except (np.linalg.LinAlgError, ValueError):
            out.append(None)
    return pd.Series(out, index=ms.index, dtype=object)


def register(spark: SparkSession) -> None:
    """The functions that need elimination, by name, for SQL text."""
    spark.udf.register("ls_det", F.pandas_udf(_wrap1(_each(lambda m: float(np.linalg.det(m)))), "double"))
    spark.udf.register("ls_inv", F.pandas_udf(_wrap1(_each(_inverse)), "array<array<double>>"))
    spark.udf.register("ls_rank", F.pandas_udf(_wrap1(_each(lambda m: int(np.linalg.matrix_rank(m)))), "int"))
    spark.udf.register("ls_solve", F.pandas_udf(_wrap2(_solve), "array<array<double>>"))


def _wrap1(f):
    def run(a: pd.Series) -> pd.Series:
        return f(a)

    return run


def _wrap2(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return f(a, b)

    return run
