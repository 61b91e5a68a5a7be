"""Expressions over detector arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Fixed small numbers that keep denominators from zero.
EPS = 1e-9


def as_doubles(a: str | Column) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("array<double>")


def lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x / by)


def linf(a: Column) -> Column:
    """Divided by the maximum, so the peak is 1."""
    return scaled(a, F.array_max(a))


def peak(a: Column) -> Column:
    """Position of the maximum, from 0; the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def cosine_rows(a: Column, b: Column) -> Column:
    """Cosine with the guard added to the product of the norms."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(EPS))


def cosine_guarded(a: Column, b: Column) -> Column:
    """Cosine with the guard inside each norm's root."""
    return dot(a, b) / (F.sqrt(dot(a, a) + F.lit(EPS)) * F.sqrt(dot(b, b) + F.lit(EPS)))


def dot_literal(a: Column, values) -> Column:
    """Dot product with constants as a balanced sum of products: stays inside generated code."""
    terms = [F.get(a, F.lit(i)) * F.lit(float(v)) for i, v in enumerate(np.asarray(values, dtype=float))]
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def rounded(c: Column, digits: int = 6) -> Column:
    """For results: rounded, and never minus zero."""
    return F.round(c, digits) + F.lit(0.0)
