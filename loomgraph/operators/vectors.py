"""Vector search, reranking and embeddings."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.records import SNIPPET_STOPWORDS


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1.0)


def topk(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = 0.2, key: str = "vec_id", vec: str = "embedding", most_queries: int = 100_000) -> DataFrame:
    """query_id, key, score, dense_order: exact cosine top-k of every query over all vectors, those below the threshold left out. The key
    may be of any type that orders.

    queries: query_id, qvec - a stated set, whose size is checked; it is broadcast as one matrix. Each Arrow batch is one matrix
    product and keeps its own k best a query, so only k rows a query and batch are shuffled. Ties go to the smaller key."""
    q = queries.select("query_id", "qvec").filter("qvec IS NOT NULL").orderBy("query_id").limit(most_queries + 1).collect()
    if len(q) > most_queries:
        raise ValueError("too many queries for one pass: run them in blocks")
    ids = [r.query_id for r in q]
    mat = unit(np.array([r.qvec for r in q], np.float64)) if q else np.zeros((0, 1))
    shared = vectors.sparkSession.sparkContext.broadcast(mat)
    rows = vectors.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            if not b.num_rows or not len(m):
                continue
            place = np.empty(b.num_rows, np.int64)
            place[np.asarray(pc.sort_indices(b.column(0)))] = np.arange(b.num_rows)
            x = unit(np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1))
            for lo in range(0, len(m), 256):  # in blocks of queries
                s = np.round(m[lo : lo + 256] @ x.T, 9)  # so that equal scores tie, whatever the order of sums
                hits = []
                for i, r in enumerate(s):
                    at = np.flatnonzero(r >= threshold)
                    if len(at) > k:
                        at = at[np.lexsort((place[at], -r[at]))[:k]]
                    hits.append((np.full(len(at), lo + i), at, r[at]))
                n, at, score = (np.concatenate(c) for c in zip(*hits, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), b.column(0).take(pa.array(at)), pa.array(score)], names=["q", "k", "score"])

    hits = rows.mapInArrow(run, f"q bigint, k {kind}, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "k")  # at most k rows a query and batch
    best = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    names = vectors.sparkSession.createDataFrame(list(enumerate(ids)) or [], f"q bigint, query_id {queries.schema['query_id'].dataType.simpleString()}")
    return best.join(F.broadcast(names), "q").select("query_id", F.col("k").alias(key), "score", (F.col("rank") - 1).alias("dense_order"))


def maxsim(pairs: DataFrame, query_tokens: str, doc_tokens: str) -> DataFrame:
    """Late interaction: the sum over query vectors of the best cosine with a document vector, appended as rerank_score.
    Both columns hold array<array<float>>; an empty side scores 0."""

    @F.pandas_udf("double")
    def run(q: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(q, d, strict=True):
            if a is None or b is None or len(a) == 0 or len(b) == 0:
                out.append(0.0)
                continue
            x, y = unit(np.array([list(v) for v in a], float)), unit(np.array([list(v) for v in b], float))
            out.append(float((x @ y.T).max(axis=1).sum()))
        return pd.Series(out)

    return pairs.withColumn("rerank_score", run(F.col(query_tokens), F.col(doc_tokens)))


def rerank(hits: DataFrame, scores: DataFrame | None, top_k: int, top_n: int, key: str = "vec_id") -> DataFrame:
    """The first max(top_k, top_n) hits ordered by rerank score, then dense score; the tail keeps its order. Without scores, or
    for a hit whose score is missing, the dense score stands in."""
    head = F.col("dense_order") < max(top_k, top_n)
    x = hits.join(scores, ["query_id", key], "left") if scores is not None else hits.withColumn("rerank_score", F.lit(None).cast("double"))
    s = F.coalesce("rerank_score", "score")
    w = Window.partitionBy("query_id").orderBy(F.desc(head), F.when(head, s).desc_nulls_last(), F.when(head, F.col("score")).desc_nulls_last(), "dense_order", key)
    return x.withColumn("final_order", F.row_number().over(w) - 1).filter(F.col("final_order") < top_k)


_WORD = regex.compile(r"[\p{L}\p{N}]+")


def hashed(texts: list[str], dims: int = 64) -> np.ndarray:
    """The default embedder: signed counts of words and pairs of words by hash. Whole numbers, so any engine gives the same; cosines
    take care of lengths."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        w = _WORD.findall(t.lower())
        h = np.array([*map(_gram, w), *map(_gram, map(" ".join, zip(w, w[1:], strict=False)))], np.int64)
        n = np.bincount(h % dims + dims * (1 - (h >> 16 & 1)), minlength=2 * dims)
        out[i] = n[:dims] - n[dims:]
    return out


@functools.lru_cache(1 << 18)  # the same words come again in every batch
def _gram(g: str) -> int:
    return int.from_bytes(hashlib.md5(g.encode()).digest()[:4], "big")


def word_maxsim(embedder: Callable[[list[str]], np.ndarray] | None = None) -> Callable[[list[str], list[str]], list[float | None]]:
    """The default reranker: the words of query and text are embedded one by one, and each word of the query takes its best cosine
    with a word of the text. Null where either has no word."""
    call = embedder or functools.partial(hashed, dims=1024)

    def run(queries: list[str], texts: list[str]) -> list[float | None]:
        words = {t: _WORD.findall(t.lower()) for t in {*queries, *texts}}
        every = sorted({w for x in words.values() for w in x})
        vec = unit(np.asarray(call(every), np.float64)) if every else None
        at = {w: i for i, w in enumerate(every)}
        rows = {t: vec[[at[w] for w in x]] for t, x in words.items() if x}
        return [float((rows[q] @ rows[t].T).max(axis=1).sum()) if q in rows and t in rows else None for q, t in zip(queries, texts, strict=True)]

    return run


def rerank_scores(pairs: DataFrame, query: str, text: str, reranker: Callable[[list[str], list[str]], list[float | None]] | None = None, batch: int = 1024) -> DataFrame:
    """pairs and rerank_score, by an injected function over pairs of texts; the default is word_maxsim. Null texts score null."""
    call = reranker or word_maxsim()

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        vals: list = [None] * len(q)
        known = [i for i in range(len(q)) if q.iloc[i] is not None and t.iloc[i] is not None]
        for lo in range(0, len(known), batch):
            part = known[lo : lo + batch]
            for i, v in zip(part, call([q.iloc[i] for i in part], [t.iloc[i] for i in part]), strict=True):
                vals[i] = v
        return pd.Series(vals, dtype=float)

    return pairs.withColumn("rerank_score", F.nanvl(run(F.col(query), F.col(text)), F.lit(None).cast("double")))


def embed(df: DataFrame, key: str, text: str, dims: int = 64, embedder: Callable[[list[str]], np.ndarray] | None = None, batch: int = 64) -> DataFrame:
    """key, vec: embeds texts in batches with an injected function; the default is a deterministic signed hashing of words and
    word pairs. Null texts give a null vector."""

    call = embedder or functools.partial(hashed, dims=dims)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            vals: list = [None] * len(s)
            known = [i for i, t in enumerate(s) if t is not None]
            for lo in range(0, len(known), batch):
                part = known[lo : lo + batch]
                for i, v in zip(part, call([s.iloc[i] for i in part]), strict=True):
                    vals[i] = np.asarray(v, np.float32)
            yield pd.Series(vals, dtype=object)

    return df.select(F.col(key), run(F.col(text)).alias("vec"))


def missing_vectors(items: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Items that have no vector; a loader raises if there is any."""
    return items.select(key).join(vectors.filter("vec IS NOT NULL").select(key), key, "left_anti")


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf: one and two words of the snippet tokens' alphabet."""
    w = df.select(F.col(key), F.filter(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0)), F.array().cast("array<string>")), lambda t: ~t.isin(*SNIPPET_STOPWORDS)).alias("w"))
    two = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(F.get("w", i), F.lit(" "), x))
    return w.select(key, F.explode(F.concat("w", two)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(df: DataFrame, key: str, text: str, features: int = 2048) -> DataFrame:
    """key, term, weight: l2-normalised tf-idf with smoothed idf ln((1 + n) / (1 + df)) + 1, over the most frequent terms (at
    most `features`; ties by term). One and two words of the snippet tokens' alphabet."""
    tf = term_counts(df, key, text)
    n = df.agg(F.count("*").alias("n"))
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).orderBy(F.desc("cf"), "term").limit(features)
    x = tf.join(F.broadcast(stats), "term").join(F.broadcast(n)).select(key, "term", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("x"))  # at most `features` rows; one row
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    return x.join(norm, key).select(key, "term", (F.col("x") / F.col("norm")).alias("weight"))
