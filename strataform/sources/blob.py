"""An index as one binary blob, for exchange with programs that read that format.

Little-endian: magic, version, dims, count, checksum, lengths of the model id,
the revision and the packed chunks (24 bytes); then model id, revision, one
float scale and ``dims`` signed bytes per vector, and the chunks as gzipped JSON.
The checksum is FNV-1a over the last three parts.  Tables are stored as Parquet
(:mod:`strataform.sources.snapshots`); this is for single files of bounded size.
"""

from __future__ import annotations

import gzip
import json
import struct
from dataclasses import dataclass

import numpy as np

from strataform.functions.hashing import fnv1a

#: The format's magic, version and header.
MAGIC, VERSION, HEADER = b"DSSI", 1, struct.Struct("<4sHHIIHHI")


class BlobError(ValueError):
    """The blob can't be read."""


@dataclass
class Snapshot:
    model_id: str
    revision: str
    vectors: np.ndarray
    chunks: list[dict]


def quantize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scales and codes of the rows."""
    x = np.asarray(x, np.float64)
    scales = np.abs(x).max(axis=1, initial=0.0)
    scales[scales == 0] = 1.0
    return scales.astype(np.float32), np.clip(np.floor(x / scales[:, None] * 127 + 0.5), -127, 127).astype(np.int8)


def dequantize(scales: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Unit vectors; a zero row stays zero."""
    x = codes.astype(np.float64) / 127 * scales[:, None]
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n == 0, 1, n)).astype(np.float32)


def pack(snapshot: Snapshot) -> bytes:
    x = np.asarray(snapshot.vectors, np.float32)
    if x.ndim != 2 or len(x) != len(snapshot.chunks):
        raise BlobError("vectors and chunks differ in number")
    scales, codes = quantize(x)
    model, revision = snapshot.model_id.encode(), snapshot.revision.encode()
    packed = gzip.compress(json.dumps(snapshot.chunks, ensure_ascii=False).encode(), mtime=0)
    parts = (scales.astype("<f4").tobytes(), codes.tobytes(), packed)
    head = HEADER.pack(MAGIC, VERSION, x.shape[1], len(x), fnv1a(*parts), len(model), len(revision), len(packed))
    return b"".join((head, model, revision, *parts))


def unpack(blob: bytes) -> Snapshot:
    if len(blob) < HEADER.size:
        raise BlobError("too short")
    magic, version, dims, count, checksum, n_model, n_revision, n_packed = HEADER.unpack_from(blob)
    if magic != MAGIC:
        raise BlobError("not an index")
    if version != VERSION:
        raise BlobError(f"version {version} is unknown")
    at = [HEADER.size]
    for n in (n_model, n_revision, 4 * count, dims * count, n_packed):
        at.append(at[-1] + n)
    if at[-1] > len(blob):
        raise BlobError("too short")
    model, revision, scales, codes, packed = (blob[a:b] for a, b in zip(at, at[1:]))
    if fnv1a(scales, codes, packed) != checksum:
        raise BlobError("checksum differs")
    x = dequantize(np.frombuffer(scales, "<f4"), np.frombuffer(codes, np.int8).reshape(count, dims))
    return Snapshot(model.decode(), revision.decode(), x, json.loads(gzip.decompress(packed)))
