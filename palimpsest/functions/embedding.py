"""The embedder surface: a column of unit vectors from texts. Any callable list of texts -> list of vectors can be plugged in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 384


def hashed(texts: list[str], dimension: int = DIMENSION) -> list[list[float]]:
    """Deterministic stand-in for a model: bits of digests of a text's words, added up and normalised."""
    out = []
    for t in texts:
        v = np.zeros(dimension)
        for w in (t or "").lower().split() or [""]:
            raw = b"".join(hashlib.sha256(f"{k}:{w}".encode()).digest() for k in range(-(-dimension // 256)))
            v += np.unpackbits(np.frombuffer(raw, np.uint8))[:dimension] * 2.0 - 1.0
        n = float(np.linalg.norm(v))
        out.append((v / n if n else v).tolist())
    return out


def embed(text: Column, embedder: Callable[[list[str]], list[list[float]]] = hashed) -> Column:
    """Vectors of a column, a batch of texts at a time."""
    def run(s):
        return pd.Series(embedder(s.tolist()))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(text)
