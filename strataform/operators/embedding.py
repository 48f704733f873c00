"""Embedding texts: spaces, a pluggable embedder, and checks of its answers."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.operators.batching import BatchOptions, plan_list
from strataform.operators.exporting import ATTEMPTS, with_retries
from strataform.workspace import spread


@dataclass(frozen=True)
class EmbeddingSpace:
    """Vectors can be compared only within one space."""

    model_id: str
    revision: str
    dims: int


#: The deterministic stand-in; no model weights are needed.
HASHED = EmbeddingSpace("hashed-ngrams", "1", 384)


def hashed_ngrams(texts: list[str], dims: int = HASHED.dims) -> np.ndarray:
    """Unit vectors of hashed words and character trigrams.

    Texts that share words or parts of words are near each other; it knows
    nothing of meaning.
    """
    out = np.zeros((len(texts), dims), np.float32)
    for i, text in enumerate(texts):
        for word in text.lower().split():
            padded = f" {word} "
            for gram in [padded, *(padded[j : j + 3] for j in range(len(padded) - 2))]:
                h = zlib.crc32(gram.encode())
                out[i, h % dims] += 1.0 if h & 0x80000000 else -1.0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


@dataclass(frozen=True)
class Embedder:
    """A space and the function that maps texts into it."""

    space: EmbeddingSpace = HASHED
    function: Callable[[list[str]], np.ndarray] = hashed_ngrams
    batch: BatchOptions = BatchOptions()

    def embed_list(self, texts: list[str]) -> np.ndarray:
        """Vectors in the order of the texts, computed in batches of like length."""
        out = np.zeros((len(texts), self.space.dims), np.float32)
        for part in plan_list([len(t) for t in texts], self.batch):
            got = np.asarray(self.function([texts[i] for i in part]), np.float32)
            if got.shape != (len(part), self.space.dims):
                raise ValueError(f"expected {len(part)} x {self.space.dims}, got {got.shape}")
            out[part] = got
        return out

    def embed(self, rows: DataFrame, text: str = "text", output: str = "embedding") -> DataFrame:
        """The rows with a vector each; null texts get null.

        Works batch by batch where the rows are; results return to their rows,
        so that no order has to be restored.
        """
        fields = rows.columns
        schema = rows.withColumn(output, F.lit(None).cast("array<float>")).schema
        at = fields.index(text)
        columns = [*fields, output]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at).to_pylist()
                known = [i for i, t in enumerate(texts) if t is not None]
                vectors = self.embed_list([texts[i] for i in known])
                held: list = [None] * len(texts)
                for i, v in zip(known, vectors):
                    held[i] = v
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, pa.list_(pa.float32()))], names=columns)

        return spread(rows, heavy=True).mapInArrow(run, schema)


#: Fixed value: texts of one request to a remote model.
REMOTE_SLICE = 12


def response_fault(response: dict, space: EmbeddingSpace, texts: int) -> str | None:
    """What is wrong with an answer; the same rules as :func:`response_error`."""
    if not isinstance(response, dict) or any(response.get(k) is None for k in ("vectors", "dims", "model")):
        return "malformed"
    vectors = response["vectors"]
    if response["model"] != space.model_id:
        return "model"
    if response["dims"] != space.dims:
        return "dims"
    if len(vectors) != texts:
        return "count"
    return "vector length" if any(v is None or len(v) != space.dims for v in vectors) else None


def remote(space: EmbeddingSpace, call: Callable[[list[str]], dict], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], np.ndarray]:
    """A function for an :class:`Embedder` that asks a service, ``REMOTE_SLICE`` texts at a time.

    ``call`` takes texts and gives ``{"vectors", "dims", "model"}``, or raises
    ``Refused``; passing refusals are tried again after the delay the service
    asks for.  An answer that fails its checks raises ``ValueError``.
    """

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), space.dims), np.float32)
        for i in range(0, len(texts), REMOTE_SLICE):
            part = texts[i : i + REMOTE_SLICE]
            got = with_retries(lambda part=part: call(part), attempts=attempts, sleep=sleep)
            if fault := response_fault(got, space, len(part)):
                raise ValueError(f"answer of {space.model_id}: {fault}")
            out[i : i + len(part)] = got["vectors"]
        return out

    return run


#: The spaces known here by model id.
SPACES = {HASHED.model_id: HASHED}


def space_for(model_id: str, spaces: dict[str, EmbeddingSpace] = SPACES) -> EmbeddingSpace:
    """The space of a model; an unknown model is an error, as its vectors compare with nothing."""
    if model_id not in spaces:
        raise ValueError(f"unknown model {model_id}")
    return spaces[model_id]


def response_error(response: Column, space: EmbeddingSpace, texts: Column) -> Column:
    """What is wrong with an answer ``struct<vectors, dims, model>``; null if nothing is."""
    v = response["vectors"]
    ragged = F.exists(v, lambda x: x.isNull() | (F.size(x) != space.dims))
    return (
        F.when(response.isNull() | v.isNull() | response["dims"].isNull() | response["model"].isNull(), "malformed")
        .when(response["model"] != space.model_id, "model")
        .when(response["dims"] != space.dims, "dims")
        .when(F.size(v) != texts, "count")
        .when(ragged, "vector length")
    )


def request_error(texts: Column, most: int = 64, longest: int = 8000) -> Column:
    """What is wrong with a request for embeddings; null if nothing is."""
    return (
        F.when(texts.isNull() | (F.size(texts) < 1), "empty")
        .when(F.size(texts) > most, "too many")
        .when(F.exists(texts, lambda t: t.isNull() | (t == "")), "blank text")
        .when(F.exists(texts, lambda t: F.length(t) > longest), "too long")
    )
