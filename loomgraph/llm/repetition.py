"""Repetition inside a document: line sequence labelling with a linear-chain conditional random field.

A text is cut into lines, long lines into sentences and long sentences into blocks of words. Every run of five successive
words belongs to the line in which it begins, and is a repeat if an equal run began earlier in the text. A line's features
(the shares of its words, triples and runs that were met before, whether the line itself was, its length, its place) feed a CRF with
the labels content and boilerplate; Viterbi decoding marks each line, and the share of words in content lines is the document's
content share, which decides its retention.

The CRF is trained here on a bounded sample of documents, labelled weakly by whether half of the sought share of a line's runs
are repeats. Documents whose content share is low enough are then checked for the exact share (1 - distinct / all runs).

Defined results: null, empty and blank texts and texts under five words have no runs: repeated_share 0 and content_share 1,
retained. A text of one endless line is cut into blocks. Rows that occur twice are measured twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, SHARE, BLOCK = 5, 0.3, 25
#: Documents in the training sample of the CRF, and lines of a training sequence.
SAMPLE, WINDOW = 600, 100
KEEP_AT = 0.7
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_CUT = re.compile(r"[.!?。！？]\s+|[。！？]|[\r\n\f]+")


def lines_of(text: str) -> tuple[list[str], np.ndarray]:
    """The words of a text and for each the number of its line."""
    words: list[str] = []
    line: list[int] = []
    n = 0
    for part in _CUT.split(text):
        own = _WORD.findall(part.lower())
        if own:
            words += own
            line += [n + k // BLOCK for k in range(len(own))]
            n += (len(own) - 1) // BLOCK + 1
    return words, np.array(line, np.int64)


def run_ids(words: list[str], size: int = SIZE) -> tuple[np.ndarray, list[np.ndarray]]:
    """(numbers of the words, and for the runs of 1, 3 and `size` words whether an equal run began before). Numbers are exact: equal
    numbers mean equal runs. A run of n + k words, k <= n, is its first n words and its last n."""
    known: dict[str, int] = {}
    one = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    ids, n, out = one, 1, [_again(np.unique(one, return_index=True)[1], len(one))]
    while n < size:
        k = 1 if n < 3 else min(n, size - n)  # 1, 2, 3, then up to twice as long each time
        n += k
        pair = ids[: max(0, len(ids) - k)] * (int(ids.max(initial=0)) + 1) + ids[k:]
        _, first, ids = np.unique(pair, return_index=True, return_inverse=True)
        if n in (3, size):
            out.append(_again(first, len(pair)))
    return one, out


def _again(first: np.ndarray, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    out[first] = False
    return out


def repeats(words: list[str], size: int = SIZE) -> np.ndarray:
    """For each run of `size` words, whether an equal run began before it."""
    return run_ids(words, size)[1][-1]


def _shares(line: np.ndarray, rep: np.ndarray, n: int) -> np.ndarray:
    at = line[: len(rep)]
    return np.bincount(at, rep, n) / np.maximum(np.bincount(at, minlength=n), 1)


def features(line: np.ndarray, one: np.ndarray, runs: list[np.ndarray]) -> np.ndarray:
    """One row a line: bias, shares of its words, triples and runs of SIZE words met before, whole line met before, log length, first
    line."""
    n = int(line[-1]) + 1
    size = np.bincount(line, minlength=n)
    start = np.cumsum(size) - size
    met: set[bytes] = set()
    before = np.zeros(n)
    for i in range(n):
        key = one[start[i] : start[i] + size[i]].tobytes()
        before[i] = key in met
        met.add(key)
    return np.column_stack([np.ones(n), *(_shares(line, r, n) for r in runs), before, np.log1p(size) / 4, np.arange(n) == 0])


class Chain:
    """A two-label linear-chain CRF: emission scores x . w for label 1 (0 for label 0), transition scores t[a, b]."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    def decode(self, x: np.ndarray, shift: float = 0.0) -> np.ndarray:
        e, t = x @ self.w + shift, self.t.tolist()
        a0, a1, back = 0.0, float(e[0]), []
        for v in e[1:].tolist():
            p, q = a0 + t[0][0], a1 + t[1][0]
            r, s = a0 + t[0][1], a1 + t[1][1]
            back.append((q > p, s > r))
            a0, a1 = max(p, q), max(r, s) + v
        out = np.empty(len(e), bool)
        lab = a1 > a0
        for i in range(len(e) - 1, -1, -1):
            out[i] = lab
            if i:
                lab = back[i - 1][int(lab)]
        return out

    @classmethod
    def fit(cls, sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 2.0, ridge: float = 1e-4) -> Chain:
        """Maximum likelihood by gradient ascent with momentum; forward-backward over all sequences at once, padded by position."""
        if not sequences:
            return cls(np.array([-4.0, 0.0, 0.0, 12.0, 1.0, 0.0, 0.0]), np.array([[0.3, 0.0], [0.0, 0.3]]))
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i][1]))
        seqs = [sequences[i] for i in order]
        lens = np.array([len(y) for _, y in seqs])
        n, m, d = len(seqs), int(lens.max()), seqs[0][0].shape[1]
        x, y, mask = np.zeros((n, m, d)), np.zeros((n, m)), np.arange(m)[None, :] < lens[:, None]
        for i, (a, b) in enumerate(seqs):
            x[i, : len(b)], y[i, : len(b)] = a, b
        w, t, total = np.zeros(d), np.zeros((2, 2)), mask.sum()
        dw, dt = np.zeros(d), np.zeros((2, 2))
        seen_w = (x * (y * mask)[..., None]).sum((0, 1))
        pair = mask[:, 1:]
        seen_t = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)], float)
        for _ in range(steps):
            e = np.stack([np.zeros((n, m)), x @ w], -1)
            f, b = np.zeros((n, m, 2)), np.zeros((n, m, 2))
            f[:, 0] = e[:, 0]
            for j in range(1, m):
                f[:, j] = np.logaddexp(f[:, j - 1, :1] + t[0], f[:, j - 1, 1:] + t[1]) + e[:, j]
            for j in range(m - 2, -1, -1):
                g = e[:, j + 1] + b[:, j + 1]
                new = np.stack([np.logaddexp(t[a, 0] + g[:, 0], t[a, 1] + g[:, 1]) for a in (0, 1)], -1)
                b[:, j] = np.where(mask[:, j + 1, None], new, 0)
            last = f[np.arange(n), lens - 1]
            z = np.logaddexp(last[:, 0], last[:, 1])
            p1 = np.exp(f[..., 1] + b[..., 1] - z[:, None]) * mask
            exp_t = np.array([[(np.exp(f[:, :-1, i] + t[i, j] + e[:, 1:, j] + b[:, 1:, j] - z[:, None]) * pair).sum() for j in (0, 1)] for i in (0, 1)])
            dw = 0.9 * dw + rate * ((seen_w - (x * p1[..., None]).sum((0, 1))) / total - ridge * w)
            dt = 0.9 * dt + rate * ((seen_t - exp_t) / total - ridge * t)
            w, t = w + dw, t + dt
        return cls(w, t)


def train(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, share: float = SHARE) -> Chain:
    """Fit the CRF on at most `sample` whole documents (those of smallest key hash), read on the driver. A line's weak label is whether
    half of the sought share of its runs are repeats. Long documents are cut into sequences of WINDOW lines."""
    rows = df.filter(F.length(text) > 0).select(F.xxhash64(F.col(key)).alias("h"), F.col(text).cast("string").alias("t")).orderBy("h", "t").limit(sample).collect()
    seqs = []
    for r in rows:
        words, line = lines_of(r.t)
        if len(words) >= SIZE:
            one, runs = run_ids(words)
            x, y = features(line, one, runs), (_shares(line, runs[-1], int(line[-1]) + 1) >= share / 2).astype(float)
            seqs += [(x[i : i + WINDOW], y[i : i + WINDOW]) for i in range(0, len(y), WINDOW)]
    return Chain.fit(seqs)


OUT = "doc_id bigint, n_runs bigint, repeated_share double, content_share double, n_lines bigint, marked_lines bigint"


def measure(df: DataFrame, key: str = "doc_id", text: str = "text", chain: Chain | None = None) -> DataFrame:
    """For each row: doc_id, n_runs, repeated_share (exact), content_share (words in lines that Viterbi marks as content),
    n_lines, marked_lines."""
    chain = chain or train(df, key, text)

    def one(t: str | None) -> tuple:
        words, line = lines_of(t or "")
        if len(words) < SIZE:
            return 0, 0.0, 1.0, int(line[-1]) + 1 if len(line) else 0, 0
        ids, runs = run_ids(words)
        mark, met = chain.decode(features(line, ids, runs)), runs[-1]
        return len(met), float(met.sum()) / len(met), float(1 - np.bincount(line)[mark].sum() / len(words)), len(mark), int(mark.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(one(t) for t in b.column(1).to_pylist()), strict=True)) or [[]] * 5
            types = (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_runs", "repeated_share", "content_share", "n_lines", "marked_lines"])

    return df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, OUT)


def retention(df: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """measure, and whether the content share lets the document be kept."""
    return measure(df).withColumn("retained", F.col("content_share") >= keep_at)


def by_content(df: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id of the documents of which the chain marks at least `share` of the words, by its decision alone."""
    return measure(df).filter(F.col("content_share") <= 1 - share + 1e-12).select("doc_id")


def found(df: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id of the documents that the content share singles out and whose exact share of repeated runs is at least `share`.

    A text with that share of repeats has at least (share - share / 2) / (1 - share / 2) of its runs in lines that the labels call
    boilerplate, so a content share of up to 1 - share / 2 is looked at."""
    return measure(df).filter((F.col("content_share") <= 1 - share / 2) & (F.col("repeated_share") >= share - 1e-12)).select("doc_id")
