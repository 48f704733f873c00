"""Checksums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fnv1a(*sections: bytes) -> int:
    """32-bit FNV-1a over the sections one after the other."""
    h = 0x811C9DC5
    for part in sections:
        for byte in part:
            h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
    return h


def fnv1a_many(values: list[bytes]) -> np.ndarray:
    """FNV-1a of many values: byte n of all of them at once, as long as several have one."""
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    h = np.full(len(values), 0x811C9DC5, np.uint64)
    sizes = np.array([len(values[i]) for i in order], np.int64)
    data = np.frombuffer(b"".join(values[i] for i in order), np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    at, many = 0, int(np.searchsorted(-sizes, 0))
    while many > 4:
        h[:many] = ((h[:many] ^ data[starts[:many] + at]) * np.uint64(0x01000193)) & np.uint64(0xFFFFFFFF)
        at += 1
        many = int(np.searchsorted(-sizes, -at))  # values longer than ``at``
    for i in range(many):  # the few longest go on alone
        x = int(h[i])
        for byte in values[order[i]][at:]:
            x = (x ^ byte) * 0x01000193 & 0xFFFFFFFF
        h[i] = x
    out = np.empty(len(values), np.int64)
    out[order] = h.astype(np.int64)
    return out


@F.pandas_udf(T.LongType())
def fnv1a_column(data: pd.Series) -> pd.Series:
    """FNV-1a of a binary column; null for null.  Use xxhash64 unless parity with stored checksums is needed."""
    out = pd.Series([None] * len(data), dtype="Int64")
    known = [i for i, b in enumerate(data) if b is not None]
    out.iloc[known] = fnv1a_many([bytes(data.iloc[i]) for i in known])
    return out
