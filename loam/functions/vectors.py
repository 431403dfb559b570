"""Vector and curve expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.arrays import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    return let(norm(a) * norm(b), lambda size: F.when(size > 0, dot(a, b) / size))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def set_overlap(a: Column, b: Column) -> Column:
    """The same of arrays that list nothing twice: their union's size follows from the others."""

    def share(common: Column) -> Column:
        union = F.size(a) + F.size(b) - common
        return F.when(union > 0, common / union).otherwise(F.lit(0.0))

    return let(F.size(F.array_intersect(a, b)), share)


def centroid(vectors: Column, size: int) -> Column:
    total = F.aggregate(vectors, F.array_repeat(F.lit(0.0), size), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(vectors))


def savgol_kernel(window: int, order: int, deriv: int) -> list[float] | None:
    """Least-squares weights of a polynomial's derivative at the window's centre; None for invalid windows."""
    if window % 2 == 0 or window <= order or window < 1:
        return None
    half = window // 2
    powers = np.vander(np.arange(-half, half + 1, dtype=float), order + 1, increasing=True)
    if deriv > order:
        return [0.0] * window
    return [float(x) for x in np.linalg.pinv(powers)[deriv] * math.factorial(deriv)]


def savgol(data: Column, window: Column, order: int, deriv: int, largest: int) -> Column:
    """Savitzky-Golay filter of an array; ``window`` may differ by row up to ``largest``.

    Places past an end mirror without repeating the end, then clamp. Null where the window is even or no larger
    than the order, or the array is empty.
    """
    sizes = [w for w in range(1, largest + 1, 2) if w > order]
    kernels = F.create_map(*[x for w in sizes for x in (F.lit(w), F.array(*[F.lit(k) for k in savgol_kernel(w, order, deriv)]))])

    def filtered(kernel: Column, values: Column) -> Column:
        n, half = F.size(values), F.floor(F.size(kernel) / 2).cast("int")

        def at(i: Column) -> Column:
            mirrored = F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)
            return F.get(values, F.least(F.greatest(mirrored, F.lit(0)), n - 1))

        def smoothed(_: Column, i: Column) -> Column:
            parts = F.transform(kernel, lambda k, j: k * at(i - half + j))
            return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

        return F.when(kernel.isNotNull() & (n > 0), F.transform(values, smoothed))

    return let(F.try_element_at(kernels, window), lambda k: let(data, lambda d: filtered(k, d)))


def odd_window(size: Column | int, n: Column) -> Column:
    """The largest odd window of at least 3 up to ``size`` and n, then no more than n."""
    w = F.least(F.lit(size), n)
    odd = F.when(w % 2 == 0, w - 1).otherwise(w)
    return F.least(F.greatest(F.lit(3), odd), n)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
