"""Cutting oversized texts at natural boundaries, into pieces of like length.

The fewest pieces that can hold a text are computed first, targets of equal
length are placed, and each target is moved to the strongest boundary near it.
If a limit fails, one more piece is tried.  A cut inside a run of characters
without any boundary ("hard") happens only where the run is longer than the
limit, so no text is cut by force that could be cut otherwise.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Boundary strengths, strongest first.
HEADING, PARAGRAPH, LINE, SENTENCE, WORD, MARK, HARD = 6, 5, 4, 3, 2, 1, 0
NAMES = {HEADING: "heading", PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", WORD: "word", MARK: "mark", HARD: "hard"}

_BLANK = r"[^\S\n]*"
_RULES = [
    (MARK, re.compile(r"(?=[.!?。！？])|(?<=[.!?。！？])")),
    (WORD, re.compile(r"(?<=\s)(?=\S)|(?<=\S)(?=\s)|(?<=\s)(?=\s)")),
    (SENTENCE, re.compile(r"(?<=[.!?])[\"'»”’)\]]*\s+(?=\S)|(?<=[。！？])\s*(?=\S)")),
    (LINE, re.compile(r"\r?\n(?=.)", re.S)),
    (PARAGRAPH, re.compile(rf"\r?\n{_BLANK}\r?\n\s*")),
    (HEADING, re.compile(rf"(?:\A|\n){_BLANK}\s*(?=#{{1,6}}\s\S|={{2,6}}[^=\n]+={{2,6}}\s*$|<h[1-6]\b|\\(?:sub)*section\b)", re.M | re.I)),
]


@dataclass(frozen=True)
class Piece:
    """``text[start:end]``; its first ``overlap`` characters repeat the piece before."""

    start: int
    end: int
    overlap: int
    cut: int  # strength of the boundary at ``end``; of the last piece, of the text's end


def boundaries(text: str) -> dict[int, int]:
    """Position to strength of every place where the text may be cut naturally."""
    found: dict[int, int] = {}
    for strength, rule in _RULES:
        for m in rule.finditer(text):
            found[m.end()] = strength
    found.pop(0, None)
    found.pop(len(text), None)
    return found


class _Cutter:
    def __init__(self, text: str, limit: int, overlap: int):
        self.text, self.n, self.limit, self.overlap = text, len(text), limit, overlap
        self.strength = boundaries(text)
        self.at = sorted(self.strength)
        # starts for a repeated tail: after a sentence end or a blank, not before one
        self.starts = [p for p in self.at if self.strength[p] >= WORD and not text[p].isspace()]

    def _lead(self, cut: int, lowest: int, room: int) -> int:
        """Length of the tail before ``cut`` that the next piece repeats."""
        most = min(self.overlap, room, cut - lowest)
        if most <= 0:
            return 0
        lo, hi = bisect_left(self.starts, cut - most), bisect_left(self.starts, cut)
        if lo == hi:
            return 0
        window = self.starts[lo:hi]
        sentence = [p for p in window if self.strength[p] >= SENTENCE]
        return cut - (sentence[0] if sentence else window[0])

    def _snap(self, target: int, lowest: int, highest: int, reach: int) -> int | None:
        """The strongest boundary near a target, the nearest of equal ones."""
        lo, hi = max(lowest, target - reach), min(highest, target + reach)
        window = self.at[bisect_left(self.at, lo) : bisect_right(self.at, hi)]
        if not window:
            window = self.at[bisect_left(self.at, lowest) : bisect_right(self.at, highest)]
            if not window:
                return None
            return min(window, key=lambda p: abs(p - target))
        return max(window, key=lambda p: (self.strength[p], -abs(p - target)))

    def balanced(self, pieces: int) -> list[Piece] | None:
        out: list[Piece] = []
        prev, lead = 0, 0
        for j in range(1, pieces):
            target = prev + (self.n - prev) // (pieces - j + 1)
            highest = min(prev + self.limit - lead, self.n - 1)
            cut = self._snap(min(target, highest), prev + 1, highest, max(40, self.limit // 5))
            if cut is None and lead:  # give up the repeated part before cutting by force
                lead, highest = 0, min(prev + self.limit, self.n - 1)
                cut = self._snap(min(target, highest), prev + 1, highest, self.limit // 5)
            if cut is None and self.n - prev <= self.limit:
                break  # the rest is one piece
            strength = HARD if cut is None else self.strength[cut]
            cut = min(target, highest) if cut is None else cut
            out.append(Piece(prev - lead, cut, lead, strength))
            lead = self._lead(cut, prev, self.limit - 1)
            prev = cut
            if self.n - prev + lead <= self.limit and j < pieces - 1:
                break
        if self.n - prev + lead > self.limit and out:
            lead = self._lead(prev, out[-1].start + out[-1].overlap, self.limit - (self.n - prev))
        if self.n - prev + lead > self.limit:
            return None
        out.append(Piece(prev - lead, self.n, lead, PARAGRAPH))
        return out


def split_text(text: str, limit: int, overlap: int = 0) -> list[Piece]:
    """Pieces of at most ``limit`` characters that together cover ``text``.

    Piece i+1 without its overlap begins where piece i ends, so the text can
    be put together again.  A text within the limit, empty ones included, is
    one piece.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and the overlap below it")
    n = len(text)
    if n <= limit:
        return [Piece(0, n, 0, PARAGRAPH)]
    cutter = _Cutter(text, limit, overlap)
    fewest = max(2, -(-(n - overlap) // (limit - overlap)))
    # Pieces are added until every limit holds, one at a time and faster after many tries.  With n pieces, each of which takes a
    # character at least, nothing is left over, so the search ends; nearly always it does at the first or second try.
    pieces, tries = fewest, 0
    while not (found := cutter.balanced(pieces)):
        tries += 1
        pieces = min(n, pieces + 1 + tries // 8)
    return found


PIECES = T.StructType(
    [
        T.StructField("record_kind", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("pieces", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("overlap", T.IntegerType()),
        T.StructField("cut", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def _split_batches(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("record_kind", pa.string()), ("record_id", pa.string()), ("text_hash", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("start", pa.int32()), ("overlap", pa.int32()), ("cut", pa.string()), ("text", pa.string())]
        )
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            held = 0
            for kind, rid, hashed, text in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = split_text(text, limit, overlap)
                for i, p in enumerate(pieces):
                    row = (kind, rid, hashed, i, len(pieces), p.start, p.overlap, NAMES[p.cut] if i < len(pieces) - 1 else "end", text[p.start : p.end])
                    for c, v in zip(cols, row):
                        c.append(v)
                held += len(text)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                    cols, held = [[] for _ in schema], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def split_oversized(items: DataFrame, record_id: Column, text: Column, kind: str, limit: int, overlap: int = 150) -> DataFrame:
    """Pieces of every distinct text over ``limit`` characters.

    One row a piece; ``text_hash`` tells several texts of one id apart, and a
    row that is repeated unchanged comes out once.  Null ids are kept, null,
    empty and short texts have no pieces.  Only the two columns are read.
    The work is row by row, so no group is ever collected; the removal of
    repeated rows runs over the oversized ones alone.
    """
    over = items.select(F.lit(kind).alias("record_kind"), record_id.cast("string").alias("record_id"), text.alias("text")).where(F.length("text") > limit)
    rows = over.distinct().select("record_kind", "record_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_split_batches(limit, overlap), PIECES)


def cut_kinds(pieces: DataFrame) -> DataFrame:
    """``forced`` for each record of which a text had to be cut inside a run, else ``natural``."""
    hard = F.max((F.col("cut") == "hard").cast("int"))
    return pieces.groupBy("record_kind", "record_id").agg(F.when(hard == 1, "forced").otherwise("natural").alias("cut"))
