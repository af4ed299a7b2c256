"""Oversized items cut at natural boundaries: a recursive separator hierarchy, packed greedily with a trailing overlap.

The separators form a hierarchy: section, paragraph, sentence (or line), word and at last character. A piece is packed greedily
with parts of the highest level of which one ends within the limit, going down a level only where none does (or where the piece
would stay under a third of the limit); the next piece begins about `overlap` characters before the end of the last one, at a word's start where there
is one near. Pieces are slices of the text, so [start_char, end_char)
of all pieces cover it and the text can be put together again exactly.

Defined results: null texts and texts of at most `limit` characters are not oversized and give no piece; white space counts
as characters; a CR LF pair is never cut; null order, document or id stay null; rows that occur twice are cut twice.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, SLACK = 1200, 100, 30

#: The separators of each level; a match's end is where the text may be cut.
LEVELS = [
    regex.compile(r"(?:\r\n|\n|\r|\f)(?=[ \t]{0,3}(?:#{1,6}[ \t]|={3,}|\*{3,}|-{3,}))|\f"),
    regex.compile(r"(?:\r\n|\n|\r)[ \t　]*(?:\r\n|\n|\r)[\s]*"),
    regex.compile(r"[.!?…]+[\"'»”’)\]]*\s+|[。！？；]+[」』”’）]*\s*|(?:\r\n|\n|\r)"),
    regex.compile(r"\s+|[，、]"),
]


class Splitter:
    def __init__(self, text: str, limit: int, overlap: int, slack: int):
        self.text, self.limit, self.overlap, self.slack = text, limit, overlap, slack
        self.cuts: list[list[int] | None] = [None] * len(LEVELS)

    def level(self, k: int) -> list[int]:
        if self.cuts[k] is None:
            self.cuts[k] = [m.end() for m in LEVELS[k].finditer(self.text)]
        return self.cuts[k]

    def end(self, start: int, done: int) -> tuple[int, int]:
        """(end, level) of the piece that begins at start, where done characters are in earlier pieces: the last boundary of the
        highest level that fills the piece to a third at least, else the last one of any level, else a cut at the limit."""
        most = start + self.limit
        for least in (max(done, start + self.limit // 3), done):
            for k in range(len(LEVELS)):
                cuts = self.level(k)
                i = bisect.bisect_right(cuts, most)
                if i and cuts[i - 1] > least:
                    return cuts[i - 1], k
        return (most - 1 if self.text[most - 1 : most + 1] == "\r\n" else most), len(LEVELS)

    def back(self, end: int) -> int:
        """Where the next piece begins: at the word's start nearest to overlap characters before end."""
        want, words = end - self.overlap, self.level(3)
        i = bisect.bisect_left(words, want - self.slack)
        near = [w for w in words[i : bisect.bisect_right(words, want + self.slack)] if w < end]
        at = min(near, key=lambda w: abs(w - want)) if near else want
        return at - 1 if self.text[at - 1 : at + 1] == "\r\n" and at == want else at

    def pieces(self) -> Iterator[tuple[int, int, int]]:
        """(start, end, level of the boundary at the end: 0 section, 1 paragraph, 2 sentence or line, 3 word, 4 none, -1 the text's end)."""
        start, done = 0, 0
        while len(self.text) - start > self.limit:
            done, k = self.end(start, done)
            yield start, done, k
            start = self.back(done)
        yield start, len(self.text), -1


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> list[tuple[int, int]]:
    return [(s, e) for s, e, _ in Splitter(text, limit, overlap, slack).pieces()]


def pieces(df: DataFrame, key: str = "chunk_id", text: str = "text", order: str = "chunk_order", document: str = "document_id", limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> DataFrame:
    """key, document, order, piece (from 0), start_char, end_char, level (of the boundary at its end, see Splitter.pieces) and text of
    the pieces of each oversized item.

    Each item is cut alone, so a document of very many items needs no special care."""
    if not 0 <= overlap + slack < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    big = df.select(F.col(key).cast("string").alias("k"), F.col(document).cast("bigint").alias("d"), F.col(order).cast("int").alias("o"), F.col(text).alias("t")).filter(F.length("t") > limit)

    types = pa.schema([("k", pa.string()), ("d", pa.int64()), ("o", pa.int32()), ("piece", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("level", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for k, d, o, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i, (s, e, level) in enumerate(Splitter(t, limit, overlap, slack).pieces()):
                    rows.append((k, d, o, i, s, e, level, t[s:e]))
                    if len(rows) == 4096:  # bounds what is held, however long a text
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    out = big.mapInArrow(run, "k string, d bigint, o int, piece int, start_char int, end_char int, level int, text string")
    return out.withColumnsRenamed({"k": "chunk_id", "d": "document_id", "o": "chunk_order"})


def found(df: DataFrame) -> DataFrame:
    """chunk_id of each item that was cut."""
    return pieces(df).filter("piece = 0").select("chunk_id")
