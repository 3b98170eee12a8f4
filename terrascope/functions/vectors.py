"""Dense vector columns.

Element-wise work uses built-in higher-order functions. Products against a small
fixed matrix run as Arrow batches: one dense multiplication per batch instead of
one interpreted lambda call per element.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# A matrix shipped with the task closure stays below this many values (16 MiB).
MAX_BROADCAST_VALUES = 2_097_152


def norm2(vector: Column) -> Column:
    """Squared Euclidean norm."""
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_normalize(vector: Column) -> Column:
    length = F.greatest(F.sqrt(norm2(vector)), F.lit(1e-12))
    return F.transform(vector, lambda x: x.cast("double") / length)


def limit_norm(vector: Column, maximum: float) -> Column:
    scale = F.least(F.lit(1.0), F.lit(float(maximum)) / F.greatest(F.sqrt(norm2(vector)), F.lit(1e-12)))
    return F.transform(vector, lambda x: x.cast("double") * scale)


def _as_matrix(batch: pa.Array, width: int | None = None) -> np.ndarray:
    if batch.null_count:
        raise ValueError("vector column holds nulls; filter them first")
    rows = len(batch)
    values = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if rows == 0:
        return values.reshape(0, width or 0)
    if width is None:
        width = values.size // rows
    offsets = batch.value_lengths().to_numpy(zero_copy_only=False)
    if values.size != rows * width or (offsets != width).any():
        raise ValueError(f"vectors must all have {width} values")
    return values.reshape(rows, width)


def _as_lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def _checked(matrix: np.ndarray) -> np.ndarray:
    matrix = np.asarray(matrix, dtype=np.float64)
    if matrix.size > MAX_BROADCAST_VALUES:
        raise ValueError(f"matrix of {matrix.size} values is too large to ship with a task")
    return matrix


def times_matrix(vector: Column, matrix: np.ndarray) -> Column:
    """``vector @ matrix`` for a matrix of shape (width, outputs)."""
    matrix = _checked(matrix)

    @F.arrow_udf(ArrayType(DoubleType()))
    def product(batch: pa.Array) -> pa.Array:
        return _as_lists(_as_matrix(batch, matrix.shape[0]) @ matrix)

    return product(vector)


def affine_reconstruct(vector: Column, mean: np.ndarray, basis: np.ndarray) -> Column:
    """normalise(mean + ((x - mean) B) B^T) for a basis of shape (width, k)."""
    basis, mean = _checked(basis), _checked(mean).reshape(1, -1)

    @F.arrow_udf(ArrayType(DoubleType()))
    def rebuild(batch: pa.Array) -> pa.Array:
        x = _as_matrix(batch, basis.shape[0])
        y = mean + ((x - mean) @ basis) @ basis.T
        return _as_lists(y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12))

    return rebuild(vector)


def row_dot(first: Column, second: Column) -> Column:
    """Dot product of two vector columns, row by row."""

    @F.arrow_udf(DoubleType())
    def dots(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.einsum("ij,ij->i", _as_matrix(a), _as_matrix(b)))

    return dots(first, second)


def weighted_mean_abs_gap(first: Column, second: Column) -> Column:
    """Mean absolute difference of two vector columns, row by row."""
    return F.aggregate(
        F.zip_with(first, second, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x
    ) / F.size(first)


# --- small score arrays (one entry per class) ---------------------------------

def top_first(scores: Column) -> Column:
    """Zero-based position of the maximum, lowest position on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_last(scores: Column) -> Column:
    """Zero-based position of the maximum, highest position on a tie."""
    return (F.size(scores) - F.array_position(F.reverse(scores), F.array_max(scores))).cast("int")


def runner_up(scores: Column) -> Column:
    """Second largest value counting duplicates; null with fewer than two."""
    return F.get(F.sort_array(scores, asc=False), F.lit(1))


def pick(values: list[int], position: Column) -> Column:
    """Value of a short literal list at a zero-based position."""
    return F.get(F.array(*[F.lit(int(v)) for v in values]), position)


def log_softmax_at(logits: Column, position: Column) -> Column:
    """log softmax of one entry, shifted by the maximum."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.get(logits, position) - top - F.log(total)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.transform(logits, lambda x: F.exp(x - top) / total)
