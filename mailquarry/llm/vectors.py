"""Quantised vectors as bytes: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greatest magnitude of a quantised component: sums of products of a million of them still fit 38 digits.
LIMIT = 1 << 52


def complete(column: str) -> Column:
    """Whether the vector is there and none of its components is null or not finite."""
    x = F.col(column)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & good, F.lit(False))


def quantised(vector: list[float], scale: int) -> bytes:
    """floor(scale * x) of each component, as bytes: 16-bit integers where all fit and there is a component, else 64-bit ones
    behind one more byte, so that equal bytes are equal vectors and the other way round. Values beyond LIMIT become it."""
    x = np.clip(np.floor(np.asarray(vector, np.float64) * scale), -LIMIT, LIMIT)
    if len(x) and -(1 << 15) <= x.min() and x.max() < 1 << 15:
        return x.astype("<i2").tobytes()
    return b"\0" + x.astype("<i8").tobytes()


def unpacked(packed: list[bytes]) -> np.ndarray:
    """The vectors as rows of 64-bit integers; a shorter one is filled up with zeros."""
    if packed and len({len(p) for p in packed}) == 1 and len(packed[0]) % 2 == 0:
        return np.frombuffer(b"".join(packed), "<i2").reshape(len(packed), -1).astype(np.int64)
    rows = [np.frombuffer(p, "<i2").astype(np.int64) if len(p) % 2 == 0 else np.frombuffer(p, "<i8", offset=1) for p in packed]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for at, row in zip(out, rows):
        at[: len(row)] = row
    return out


def largest(x: np.ndarray) -> int:
    """The greatest magnitude, as a Python integer."""
    return max(int(x.max()), -int(x.min())) if x.size else 0
