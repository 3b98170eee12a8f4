"""Rigid transforms and pinhole projection as SQL expression texts.

Texts keep plan building cheap: one parse per column instead of one call per
arithmetic sign. Catalyst removes the repeated subexpressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = list[list[str]]
Vector = list[str]

ROTATION = ("qw", "qx", "qy", "qz")
TRANSLATION = ("tx", "ty", "tz")
POSE = ROTATION + TRANSLATION


@dataclass(frozen=True)
class Intrinsics:
    width: int
    height: int
    fx: float
    fy: float
    cx: float
    cy: float
    max_depth: float = 80.0
    min_depth: float = 0.01


def columns(texts: Sequence[str], names: Sequence[str]) -> list[Column]:
    return [F.expr(text).alias(name) for text, name in zip(texts, names)]


def with_rotation(poses: DataFrame, prefix: str = "") -> DataFrame:
    """Poses as 3x3 matrices: nine columns ``m00`` to ``m22`` replace the quaternion.

    Done on the pose table, before it meets points, so a frame's rotation is worked
    out once and a point costs nine products.
    """
    norm = "sqrt(" + " + ".join(f"{prefix}{c} * {prefix}{c}" for c in ROTATION) + ")"
    rest = [c for c in poses.columns if c not in {f"{prefix}{n}" for n in ROTATION}]
    unit = poses.selectExpr(*rest, *[f"{prefix}{c} / {norm} as _{c[1]}" for c in ROTATION])
    w, x, y, z = "_w", "_x", "_y", "_z"
    cells = [
        [f"1 - 2 * ({y} * {y} + {z} * {z})", f"2 * ({x} * {y} - {z} * {w})", f"2 * ({x} * {z} + {y} * {w})"],
        [f"2 * ({x} * {y} + {z} * {w})", f"1 - 2 * ({x} * {x} + {z} * {z})", f"2 * ({y} * {z} - {x} * {w})"],
        [f"2 * ({x} * {z} - {y} * {w})", f"2 * ({y} * {z} + {x} * {w})", f"1 - 2 * ({x} * {x} + {y} * {y})"],
    ]
    named = [f"{text} as {name}" for row, names in zip(cells, pose_matrix(prefix)) for text, name in zip(row, names)]
    return unit.selectExpr(*rest, *named)


def pose_matrix(prefix: str = "") -> Matrix:
    return [[f"{prefix}m{r}{c}" for c in range(3)] for r in range(3)]


def pose_translation(prefix: str = "") -> Vector:
    return [f"{prefix}{name}" for name in TRANSLATION]


def rotate(matrix: Matrix, vector: Sequence[str]) -> Vector:
    return ["(" + " + ".join(f"{m} * {v}" for m, v in zip(row, vector)) + ")" for row in matrix]


def transpose(matrix: Matrix) -> Matrix:
    return [[matrix[r][c] for r in range(3)] for c in range(3)]


def to_camera(matrix: Matrix, translation: Sequence[str], point: Sequence[str]) -> Vector:
    """World point into the camera whose camera-to-world pose is given."""
    return rotate(transpose(matrix), [f"({p} - {t})" for p, t in zip(point, translation)])


def to_world(matrix: Matrix, translation: Sequence[str], point: Sequence[str]) -> Vector:
    return [f"({r} + {t})" for r, t in zip(rotate(matrix, point), translation)]


def with_slerp(df: DataFrame, first: Sequence[str], second: Sequence[str], amount: str) -> DataFrame:
    """Add ``_s0`` to ``_s3``: shortest-arc interpolation of two quaternions.

    Nearly parallel pairs use a normalised lerp. Each step is a projection of its
    own, which keeps the generated code small.
    """
    length = lambda v: "sqrt(" + " + ".join(f"{c} * {c}" for c in v) + ")"
    keep = df.columns
    unit = df.selectExpr(
        *keep,
        f"{amount} as _amount",
        *[f"{c} / {length(first)} as _p{i}" for i, c in enumerate(first)],
        *[f"{c} / {length(second)} as _q{i}" for i, c in enumerate(second)],
    )
    dotted = unit.selectExpr("*", " + ".join(f"_p{i} * _q{i}" for i in range(4)) + " as _raw").selectExpr(
        "*", "abs(_raw) as _dot", "acos(least(abs(_raw), 1D)) as _angle", "abs(_raw) > 0.9995D as _near"
    )
    weighed = dotted.selectExpr(
        "*",
        "case when _near then 1D - _amount else sin((1D - _amount) * _angle) / nullif(sin(_angle), 0D) end as _wp",
        "if(_raw < 0, -1D, 1D) * case when _near then _amount else sin(_amount * _angle) / nullif(sin(_angle), 0D) end as _wq",
        # Length of the lerp of two unit vectors.
        "if(_near, sqrt(pow(1D - _amount, 2) + pow(_amount, 2) + 2 * (1D - _amount) * _amount * _dot), 1D) as _len",
    )
    return weighed.selectExpr(*keep, *[f"(_wp * _p{i} + _wq * _q{i}) / _len as _s{i}" for i in range(4)])
