"""Generated test inputs, the same on every run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bench_corpus(spark: SparkSession, n: int) -> DataFrame:
    """``idx, text``: text i has 8 + (37 i mod 190) words, word w is token((i + w) mod 100)."""
    i = F.col("id")
    words = F.transform(F.sequence(F.lit(0), 7 + (i * 37) % 190), lambda w: F.concat(F.lit("token"), ((i + w) % 100).cast("string")))
    return spark.range(n).select(i.alias("idx"), F.array_join(words, " ").alias("text"))


def lcg(seed: int, n: int) -> np.ndarray:
    """Numbers in [0, 1) of a 32-bit linear congruential generator."""
    out = np.empty(n)
    x = seed & 0xFFFFFFFF
    for i in range(n):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        out[i] = x / 2**32
    return out


def unit_vectors(n: int, dims: int, seed: int = 1) -> np.ndarray:
    x = lcg(seed, n * dims).reshape(n, dims) * 2 - 1
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
