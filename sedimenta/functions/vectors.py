"""Vector functions over array columns; arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: At or below this squared norm a vector counts as zero.
TINY = 1e-9


def _col(v: str | Column) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _with(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def sanitize(v: str | Column) -> Column:
    """NaN and infinite components as 0; an empty vector stays empty."""
    return F.transform(_col(v), lambda x: F.when(finite(x), x.cast("double")).otherwise(F.lit(0.0)))


def square_sum(v: str | Column) -> Column:
    return _total(F.transform(_col(v), lambda x: x.cast("double") * x.cast("double")))


def normalize(v: str | Column) -> Column:
    """Sanitized and of unit length: empty if the squared norm overflows, only sanitized if it is tiny."""
    def unit(clean: Column) -> Column:
        def divided(size: Column) -> Column:
            scaled = F.transform(clean, lambda x: x / F.sqrt(size))
            return F.when(size == float("inf"), F.array().cast("array<double>")).when(size <= TINY, clean).otherwise(scaled)

        return _with(square_sum(clean), divided)

    return _with(sanitize(v), unit)


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product; 0 if the lengths differ or a vector is empty."""
    a, b = _col(a), _col(b)
    return F.when(F.size(a) == F.size(b), _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))).otherwise(F.lit(0.0))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine; 0 if the lengths differ, a vector is empty, or the product of the squared norms has a tiny root."""
    scale = F.sqrt(square_sum(a) * square_sum(b))
    return F.when((F.size(_col(a)) == F.size(_col(b))) & (scale > TINY), dot(a, b) / scale).otherwise(F.lit(0.0))


def l2_norm(v: str | Column) -> Column:
    return F.sqrt(square_sum(v))


def has_non_finite(v: str | Column) -> Column:
    return F.exists(_col(v), lambda x: ~finite(x))


def vector_stats(v: str | Column) -> Column:
    """Struct of mean, min, max, norm; all 0 for an empty vector."""
    v = _col(v)
    some = F.size(v) > 0
    zero = F.lit(0.0)
    return F.struct(
        F.when(some, _total(v) / F.size(v)).otherwise(zero).alias("mean"),
        F.coalesce(F.array_min(v).cast("double"), zero).alias("min"),
        F.coalesce(F.array_max(v).cast("double"), zero).alias("max"),
        l2_norm(v).alias("norm"),
    )


def layer_norm(v: str | Column, eps: float = 1e-5) -> Column:
    """Components less their mean, over the root of their population variance plus ``eps``."""
    def centred(c: Column) -> Column:
        return _with(square_sum(c) / F.size(c), lambda variance: F.transform(c, lambda x: x / F.sqrt(variance + eps)))

    v = _col(v)
    shifted = _with(F.try_divide(_total(v), F.size(v)), lambda mean: F.transform(v, lambda x: x.cast("double") - mean))
    return F.when(F.size(v) > 0, _with(shifted, centred)).otherwise(F.array().cast("array<double>"))


def argmax(v: str | Column) -> Column:
    """Place of the first largest component, from 0."""
    return (F.array_position(_col(v), F.array_max(_col(v))) - 1).cast("int")


def guided_combine(negative: str | Column, text: str | Column, weight: float | Column) -> Column:
    """negative + weight * (text - negative) by component where the weight is above 1, else text."""
    w = F.lit(weight) if isinstance(weight, int | float) else weight
    return F.when(w > 1, F.zip_with(_col(negative), _col(text), lambda n, t: n.cast("double") + w * (t.cast("double") - n.cast("double")))).otherwise(F.transform(_col(text), lambda t: t.cast("double")))


def attention_mask(ids: str | Column, pad_id: int) -> Column:
    """True where an id isn't the pad id; a real token of that id is masked too."""
    return F.transform(_col(ids), lambda x: x != pad_id)


def log_sum_exp(v: str | Column) -> Column:
    v = _col(v)
    top = F.array_max(v).cast("double")
    return top + F.log(_total(F.transform(v, lambda x: F.exp(x.cast("double") - top))))
