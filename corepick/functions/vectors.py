"""Column expressions on vectors (``array<double>``) and on class probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once however often it is used: inside a lambda Spark computes it per element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def l2_normalize(v: Column) -> Column:
    """Divided by the norm; a zero vector stays zero."""
    return _with(norm(v), lambda n: F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


def sq_l2_unit(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of unit vectors."""
    return 2 * (1 - dot(a, b))


def sq_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def edge_weight(distance: Column, similarity_weights: bool = True) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2)) if similarity_weights else F.lit(1.0)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    raised = _with(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp((x - top) / temperature)))
    shares = lambda r: _with(F.aggregate(r, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(r, lambda x: x / total))
    return _with(raised, shares)


def l2_error(probs: Column, label: Column) -> Column:
    """Distance of the probabilities to the one-hot label."""
    off = F.transform(probs, lambda p, i: F.pow(p - F.when(i == label, 1.0).otherwise(0.0), 2))
    return F.sqrt(F.aggregate(off, F.lit(0.0), lambda s, x: s + x))


def confidence(probs: Column, label: Column) -> Column:
    return F.get(probs, label)


def margin(probs: Column, label: Column) -> Column:
    return F.get(probs, label) - F.array_max(F.filter(probs, lambda _, i: i != label))


def correct(logits: Column, label: Column) -> Column:
    """Whether the first of the largest logits is the label's."""
    return F.array_position(logits, F.array_max(logits)) - 1 == label
