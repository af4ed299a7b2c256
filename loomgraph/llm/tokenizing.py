"""Encoding of a corpus with a public byte-level BPE vocabulary.

The corpus' most frequent words (pre-tokens) are encoded once and compiled into a minimal acyclic automaton with shared
suffixes, whose paths number the words (a minimal perfect hash); the number leads to the word's ids. The automaton is one
flat file that every worker maps into memory. Words that it doesn't hold are merged by the BPE rules, so the result is exact
whatever the lexicon contains.

Defined results: null and empty texts give an empty list; the strings of special tokens are ordinary text; text that is
not well-formed Unicode can't occur in Parquet strings.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import shared_path

#: Words in the lexicon, a bound on what the driver builds and broadcasts (not on what is encoded).
LEXICON = 1 << 15
LONGEST = 64
#: The published split pattern of the vocabulary (fixed).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAGIC = 0x4C4D4631


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The path of a public vocabulary; the operators take any path."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"/opt/tokenizers/{name}"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: always merge the leftmost pair of lowest rank. O(n log n), so long runs are no trouble."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    nxt, prv, end, live = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if not live[i] or nxt[i] != j or j >= n or end[j] != e:
            continue
        live[j], end[i], nxt[i] = False, e, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for a, b in ((prv[i], i), (i, nxt[i])):
            if a >= 0 and b < n and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, b, end[b]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The minimal acyclic automaton of the words, built from sorted words by merging equal states as they are finished,
    with the number of words to the left of every arc, and the ids by word number."""
    items = sorted(dict(entries).items())
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def finish(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # the open states along the last word: [final, arcs]
    last = b""
    for word, _ in items:
        same = next((i for i, (x, y) in enumerate(zip(word, last, strict=False)) if x != y), min(len(word), len(last)))
        while len(path) > same + 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], finish(done)))
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((last[len(path) - 1], finish(done)))
    root = finish(path[0])
    count = np.zeros(len(states), np.uint32)
    first = np.zeros(len(states) + 1, np.uint32)
    labels, targets, before = [], [], []
    for s, (final, arcs) in enumerate(states):  # states are numbered children first
        total = int(final)
        for label, target in arcs:
            labels.append(label), targets.append(target), before.append(total)
            total += int(count[target])
        count[s], first[s + 1] = total, len(labels)
    finals = np.fromiter((f for f, _ in states), np.uint32, len(states))
    offsets = np.zeros(len(items) + 1, np.uint32)
    np.cumsum([len(x) for _, x in items], out=offsets[1:])
    ids = np.fromiter((i for _, x in items for i in x), np.uint32)
    parts = [first, finals, np.array(labels, np.uint32), np.array(targets, np.uint32), np.array(before, np.uint32), offsets, ids]
    head = np.array([MAGIC, root, *map(len, parts)], np.uint32)
    return b"".join(x.tobytes() for x in (head, *parts))


class Lexicon:
    """A compiled lexicon over a buffer or a memory-mapped file."""

    def __init__(self, data: np.ndarray):
        head = data[:9].tolist()
        if head[0] != MAGIC:
            raise ValueError("not a lexicon")
        self.root, at, parts = head[1], 9, []
        for n in head[2:]:
            parts.append(data[at : at + n])
            at += n
        self.first, self.finals, self.labels, self.targets, self.before, self.offsets, self.ids = parts

    @classmethod
    def open(cls, path: str | None, data: bytes) -> Lexicon:
        if path and os.path.exists(path):
            return cls(np.memmap(path, np.uint32, "r"))
        return cls(np.frombuffer(data, np.uint32))

    def get(self, word: bytes) -> list[int] | None:
        s, number = self.root, 0
        for byte in word:
            a, b = int(self.first[s]), int(self.first[s + 1])
            i = a + int(np.searchsorted(self.labels[a:b], byte)) if b - a > 4 else next((k for k in range(a, b) if self.labels[k] == byte), b)
            if i >= b or self.labels[i] != byte:
                return None
            number += int(self.before[i])
            s = int(self.targets[i])
        if not self.finals[s]:
            return None
        return self.ids[int(self.offsets[number]) : int(self.offsets[number + 1])].tolist()


def frequent_words(df: DataFrame, text: str = "text", size: int = LEXICON) -> list[str]:
    """The corpus' most frequent words, counted over all texts in the JVM. Java's white space differs from the pattern's in
    a few rare characters, which only decides what the lexicon holds."""
    words = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).alias("w")).filter(F.length("w") <= LONGEST)
    top = words.groupBy("w").count().filter("count > 1").orderBy(F.desc("count"), "w").limit(size)
    return [r.w for r in top.select("w").collect()]


def build(df: DataFrame, text: str, path: str, size: int) -> tuple[str | None, bytes]:
    """Compile the lexicon of df's texts and lay it in the shared folder: (mapped path or None, its bytes)."""
    ranks = load_ranks(path)
    data = compile_lexicon((w, merge(w, ranks)) for w in (x.encode() for x in frequent_words(df, text, size)))
    place = urlparse(shared_path(df.sparkSession, "lexicon"))
    if place.scheme not in ("", "file"):
        return None, data  # a store that can't be mapped: workers use the broadcast bytes
    os.makedirs(os.path.dirname(place.path), exist_ok=True)
    with open(place.path + ".part", "wb") as f:
        f.write(data)
    os.replace(place.path + ".part", place.path)
    return place.path, data


class Encoder:
    """Encodes texts in a worker; results for words met before are kept, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], lexicon: Lexicon | None = None, kept: int = 1 << 17):
        self.ranks, self.lexicon, self.kept = ranks, lexicon, kept
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        b = w.encode()
        ids = self.lexicon.get(b) if self.lexicon and len(w) <= LONGEST else None
        if ids is None:
            ids = merge(b, self.ranks)
        if len(self.known) >= self.kept:
            self.known.clear()
        if len(w) <= LONGEST:
            self.known[w] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known
        for w in self.split(text) if text else ():
            ids = known.get(w)
            out.extend(self.word(w) if ids is None else ids)
        return out


_ranks: dict[str, dict[bytes, int]] = {}


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = LEXICON, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids) of every row, and the columns to keep; with counts_only (doc_id, n_tokens) of the same encoding. The vocabulary's
    path must be the same on all machines."""
    path = path or vocabulary()
    mapped, data = build(df, text, path, size)
    shared = df.sparkSession.sparkContext.broadcast(data)  # at most LEXICON words of at most LONGEST characters
    rows = df.select(F.col(text).cast("string").alias("__t"), F.col(key).cast("bigint").alias("doc_id"), *keep)
    last = "n_tokens" if counts_only else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ranks:
            _ranks[path] = load_ranks(path)
        enc = Encoder(_ranks[path], Lexicon.open(mapped, shared.value))
        for b in batches:
            for lo in range(0, b.num_rows, 1000):  # bounds the ids held at once
                part = b.slice(lo, 1000)
                ids = [enc.encode(t) for t in part.column(0).to_pylist()]
                out = pa.array(map(len, ids), pa.int64()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], out], names=[*part.schema.names[1:], last])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("__t").schema)
    return rows.mapInArrow(run, f"{kept}, {last} {'bigint' if counts_only else 'array<int>'}")
