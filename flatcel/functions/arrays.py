"""Array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Plain Python reuse of a column repeats its expression, and inside a lambda
    it is evaluated anew for every element; a one-element ``transform`` binds it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, e: acc + e)


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")))


def rounded(value: Column, digits: int) -> Column:
    """Halves away from zero; what rounds to zero keeps its sign, as in IEEE arithmetic (Spark's own
    ``round`` goes through decimals, which have no negative zero)."""
    return F.round(F.abs(value), digits) * F.signum(value)


def argmax(values: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def norm_features(v: Column) -> Column:
    """Centered vector divided by its length."""

    def scaled(centered: Column) -> Column:
        return let(
            F.sqrt(dot(centered, centered)) + 1e-10, lambda length: F.transform(centered, lambda e: e / length)
        )

    return let(
        doubles(v),
        lambda x: let(
            array_sum(x) / F.size(x), lambda mean: let(F.transform(x, lambda e: e - mean), scaled)
        ),
    )


def softmax(logits: Column) -> Column:
    def shares(e: Column) -> Column:
        return let(array_sum(e), lambda total: F.transform(e, lambda z: z / total))

    return let(
        doubles(logits),
        lambda x: let(F.array_max(x), lambda top: let(F.transform(x, lambda z: F.exp(z - top)), shares)),
    )


def confidence(logits: Column, n: Column) -> Column:
    """1 - entropy / log(n) over the softmax of the first n logits; 1 when n <= 1."""

    def entropy(head: Column) -> Column:
        # log(total) - sum(p * (z - top))
        return let(
            F.array_max(head),
            lambda top: let(
                array_sum(F.transform(head, lambda z: F.exp(z - top))),
                lambda total: F.log(total)
                - array_sum(F.transform(head, lambda z: F.exp(z - top) * (z - top))) / total,
            ),
        )

    head = doubles(F.slice(logits, F.lit(1), F.greatest(n, F.lit(1))))
    return F.when(n <= 1, F.lit(1.0)).otherwise(1.0 - let(head, entropy) / F.log(n.cast("double")))


def seeded_text(seed: int, *parts: Column | str) -> Column:
    """Seeded hash of the parts as 32 hex digits: an order at random, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts]))


def seeded_number(seed: int, *parts: Column | str) -> Column:
    """The first 32 bits of ``seeded_text``."""
    return F.conv(F.substring(seeded_text(seed, *parts), 1, 8), 16, 10).cast("long")
