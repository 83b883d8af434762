"""Array arithmetic on embeddings and channel-first tensors, all in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CHANNEL_MEAN = (0.48145466, 0.4578275, 0.40821073)
CHANNEL_STD = (0.26862954, 0.26130258, 0.27577711)
LOGIT_SCALE = float(np.log(1 / 0.07))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where the body loops over an array."""
    return F.get(F.transform(F.array(value), body), 0)


def dot(u: Column, v: Column) -> Column:
    products = F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector divided by its length."""
    return let(l2_norm(v), lambda length: F.transform(v, lambda x: x.cast("double") / length))


def scaled_cosine(u: Column, v: Column, scale: float = LOGIT_SCALE) -> Column:
    """Logit of one pair: exp(scale) times the dot product of unit vectors."""
    return F.exp(F.lit(scale)) * dot(u, v)


def standardize_channels(
    tensor: Column,
    pixels: int,
    scale: float = 1.0,
    mean: Sequence[float] = CHANNEL_MEAN,
    std: Sequence[float] = CHANNEL_STD,
) -> Column:
    """``(x / scale - mean_c) / std_c`` of a flat channel-first tensor.

    ``pixels`` is height times width; use ``scale=255`` for bytes.
    """

    def plane(c: int) -> Column:
        values = F.slice(tensor, c * pixels + 1, pixels)
        return F.transform(values, lambda x: (x.cast("double") / F.lit(scale) - F.lit(mean[c])) / F.lit(std[c]))

    return F.concat(*[plane(c) for c in range(len(mean))])


def argmax(values: Column) -> Column:
    """Zero-based place of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def cross_entropy(logits: Column, target: Column) -> Column:
    """Negative log-softmax at ``target``, shifted by the maximum before exp."""

    def log_sum(top: Column) -> Column:
        return F.ln(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))) + top

    return let(F.array_max(logits), log_sum) - F.get(logits, target)
