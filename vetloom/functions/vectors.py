"""Array arithmetic for logits, probabilities and embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def array_sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


def softmax(col: Column) -> Column:
    """Class probabilities, shifted by the largest logit."""
    exps = let(F.array_max(col), lambda top: F.transform(col, lambda x: F.exp(x - top)))
    return let(exps, lambda es: let(array_sum(es), lambda t: F.transform(es, lambda e: e / t)))


def sigmoid(col: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-col))


def logits_to_probs(col: Column) -> Column:
    """One logit: sigmoid. Two or more: softmax."""
    return F.when(F.size(col) == 1, F.transform(col, sigmoid)).otherwise(softmax(col))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), n)
