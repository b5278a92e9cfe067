"""Embedding hook: any column function text -> array<float>. The default hashes words, as no model is shipped; it finds shared words, not meaning.

Null or blank texts give an all-zero vector."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384
_WORD = re.compile(r"[^\W_]+")


def hashed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Signed word counts in hashed places, scaled to length 1; an Arrow batch at a time."""
    def run(texts: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for t in texts:
            marks = np.array([zlib.crc32(w.encode()) for w in _WORD.findall(t.lower())] if isinstance(t, str) else [], dtype=np.int64)
            v = np.bincount(marks % dimensions, np.where(marks >> 31 & 1, -1.0, 1.0), dimensions) if len(marks) else np.zeros(dimensions)
            n = np.sqrt(v @ v)
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out)

    return F.pandas_udf(run, "array<float>")(text)


def embed(df: DataFrame, text: str = "text", function: Callable[[Column], Column] = hashed, name: str = "embedding") -> DataFrame:
    """Adds the embedding; each distinct text is embedded once and joined back."""
    distinct = df.select(F.col(text).alias("_t")).distinct().withColumn(name, function(F.col("_t")))
    return df.join(distinct, df[text].eqNullSafe(distinct["_t"]), "left").drop("_t")


class EmbeddingCache:
    """A bounded store on the driver, for single queries; tables go through `embed`. When full, the older half stays."""

    def __init__(self, max_size: int = 10_000):
        self.max_size, self._held = max_size, {}

    def get(self, text: str) -> list[float] | None:
        return self._held.get(text)

    def set(self, text: str, vector: list[float]) -> None:
        if len(self._held) >= self.max_size:
            self._held = dict(list(self._held.items())[: self.max_size // 2])
        self._held[text] = vector

    def clear(self) -> None:
        self._held.clear()

    def size(self) -> int:
        return len(self._held)
