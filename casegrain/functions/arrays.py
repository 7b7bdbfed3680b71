"""Array-math expressions on logits / vectors (JVM-side higher-order functions).

Every helper binds its input once with ``let`` so that max, sum and the
element-wise pass all read the same evaluated array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegrain.functions.text import col_of, let


def as_doubles(c) -> Column:
    return col_of(c).cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def log_softmax(z, temperature: float = 1.0) -> Column:
    """log softmax(z / T) with the max shift."""
    def body(v):
        return let(F.array_max(v), lambda m: let(
            F.log(_sum(F.transform(v, lambda x: F.exp(x - m)))),
            lambda lse: F.transform(v, lambda x: x - m - lse)))
    scaled = F.transform(as_doubles(z), lambda x: x / F.lit(float(temperature)))
    return let(scaled, body)


def softmax(z, temperature: float = 1.0) -> Column:
    return F.transform(log_softmax(z, temperature), lambda x: F.exp(x))


def argmax(z) -> Column:
    """0-based index of the largest element; ties → lowest index."""
    return let(as_doubles(z), lambda v: F.array_position(v, F.array_max(v)) - 1)


def dot(a, b) -> Column:
    return _sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(as_doubles(a), lambda x: x * x)))


def cosine(a, b) -> Column:
    """Cosine similarity in double; null when either vector has zero norm."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def kl_divergence(p_log, q_log) -> Column:
    """Σ p (ln p − ln q) from two log-probability arrays."""
    return _sum(F.zip_with(p_log, q_log, lambda lp, lq: F.exp(lp) * (lp - lq)))


def prefix_sums(a) -> Column:
    """Running sums before each element of an integer array, in about n·√n steps.

    Blocks of √n elements: sums of whole blocks first, then inside each block.
    """
    def blocks(v):
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")
        count = F.ceil(F.size(v) / size).cast("int")

        def per_block(b):
            starts = F.aggregate(b, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(
                acc, F.array(F.element_at(acc, -1) + F.aggregate(x, F.lit(0).cast("bigint"), lambda s, y: s + y))))
            return let(starts, lambda base: F.flatten(F.transform(b, lambda x, k: F.transform(
                x, lambda _, i: F.element_at(base, k + 1)
                + F.aggregate(F.slice(x, 1, i), F.lit(0).cast("bigint"), lambda s, y: s + y)))))
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(v, k * size + 1, size))
        return F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(let(cut, per_block))
    return let(col_of(a).cast("array<bigint>"), blocks)
