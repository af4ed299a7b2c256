"""Soft clustering in layers: projection, Gaussian mixtures chosen by BIC, overlapping assignment.

Only statistics of fixed size (a covariance matrix, a sample of SAMPLE points for the first means, the moments of a block of
mixtures of at most `most` parts) reach the driver; every pass of a fit covers all vectors. The projection is PCA on unit vectors,
where the usual tool would be a stochastic neighbour embedding."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut

#: Points that the first means are chosen from.
SAMPLE = 4096


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def project(df: DataFrame, key: str, vec: str, dims: int = 2) -> DataFrame:
    """key, x: array of `dims` coordinates along the leading principal axes of the unit vectors. Null vectors are left out."""
    v = df.select(F.col(key), F.col(vec).cast("array<double>").alias("v")).filter("v IS NOT NULL AND size(v) > 0")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = _vectors(b)
                part = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["i", "s"])

    rows = v.mapInArrow(moments, "i bigint, s double").groupBy("i").agg(F.sum("s")).orderBy("i").collect()
    if not rows:
        return v.select(key, F.array().cast("array<double>").alias("x"))
    s = np.array([r[1] for r in rows])
    d = int((np.sqrt(4 * len(s) - 3) - 1) / 2)
    mean = s[1 : d + 1] / s[0]
    cov = s[d + 1 :].reshape(d, d) / s[0] - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, : min(dims, d)]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), range(axes.shape[1])] < 0, -1, 1)
    kind = v.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = (_vectors(b) - mean) @ axes
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=[key, "x"])

    return v.mapInArrow(apply, f"{key} {kind}, x array<double>")


def _density(x: np.ndarray, w: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    out = np.empty((len(x), len(w)))
    for j in range(len(w)):
        c = cov[j] + 1e-6 * np.eye(d)
        z = np.linalg.solve(np.linalg.cholesky(c), (x - mu[j]).T)
        out[:, j] = np.log(w[j]) - 0.5 * (z**2).sum(0) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d * np.log(2 * np.pi)
    return out


def _soft(x: np.ndarray, model) -> tuple[np.ndarray, np.ndarray]:
    lp = _density(x, *model)
    top = lp.max(1, keepdims=True)
    ll = top[:, 0] + np.log(np.exp(lp - top).sum(1))
    return np.exp(lp - ll[:, None]), ll


def _seeds(x: np.ndarray, k: int, tries: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A first mixture of k parts: k-means++ and a few moves of the means on a sample, the tightest of some tries."""
    best, least = None, np.inf
    for t in range(tries):
        rng = np.random.default_rng([k, t])
        mu = x[[rng.integers(len(x))]]
        far = ((x - mu[0]) ** 2).sum(1)
        while len(mu) < k:
            at = rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))
            mu = np.vstack([mu, x[at]])
            far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
        for _ in range(10):
            dist = ((x[:, None] - mu[None]) ** 2).sum(2)
            own = dist.argmin(1)
            mu = np.array([x[own == j].mean(0) if (own == j).any() else mu[j] for j in range(k)])
        if dist.min(1).sum() < least:
            best, least = (own, mu), dist.min(1).sum()
    own, mu = best
    gap = x - mu[own]
    pooled = gap.T @ gap / len(x)
    n = np.bincount(own, minlength=k)
    cov = np.array([(gap[own == j].T @ gap[own == j] + pooled) / (n[j] + 1) for j in range(k)])
    return (n + 1) / (n + 1).sum(), mu, cov


def _fit(points: DataFrame, models: list, steps: int, tol: float) -> tuple[list, list[float], float]:
    """EM over all points, all models in the same passes, each until its mean log likelihood gains less than tol. The log
    likelihoods are those of the models returned."""
    d = models[0][1].shape[1]
    done, lls, n = [None] * len(models), [-np.inf] * len(models), 0.0
    for step in range(steps):
        todo = [i for i in range(len(models)) if done[i] is None]
        now = [models[i] for i in todo]

        def stats(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.asarray(b.column(0).flatten(), np.float64).reshape(b.num_rows, -1)
                parts = []
                for m in now:
                    r, ll = _soft(x, m)
                    parts += [[len(x), ll.sum()], r.sum(0), (r.T @ x).ravel(), np.einsum("ij,ia,ib->jab", r, x, x).ravel()]
                part = np.concatenate(parts)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["i", "s"])

        s = np.array([r[1] for r in points.select("x").mapInArrow(stats, "i bigint, s double").groupBy("i").agg(F.sum("s")).orderBy("i").collect()])
        at = 0
        for i in todo:
            k = len(models[i][0])
            n, ll = s[at], s[at + 1]
            r = np.maximum(s[at + 2 : at + 2 + k], 1e-9)
            mu = s[at + 2 + k : at + 2 + k + k * d].reshape(k, d) / r[:, None]
            cov = s[at + 2 + k + k * d : at + 2 + k + k * d + k * d * d].reshape(k, d, d) / r[:, None, None] - np.einsum("ja,jb->jab", mu, mu)
            at += 2 + k + k * d + k * d * d
            if abs(ll - lls[i]) / n < tol or step + 1 == steps:
                done[i] = models[i]
            lls[i] = ll
            models[i] = (r / n, mu, cov)
        if all(m is not None for m in done):
            break
    return done, lls, n


def fit_mixtures(points: DataFrame, most: int = 49, steps: int = 100, tol: float = 1e-3, change_at: float = 1e-3, block: int = 8) -> tuple[list, dict[int, float]]:
    """Mixtures of 1, 2, ... parts and their BIC, up to `most` or one less than there are points, or to the first whose BIC differs
    from the last by a share under change_at. `block` of them are fitted in the same passes. points: key, x."""
    first = points.select("x").orderBy(F.xxhash64("x")).limit(SAMPLE).collect()
    if not first:
        return [], {}
    seeds = np.array([r.x for r in first])
    d, top = seeds.shape[1], max(1, min(most, len(seeds) - 1))
    models, bic = [], {}
    for lo in range(1, top + 1, block):
        fitted, lls, n = _fit(points, [_seeds(seeds, k) for k in range(lo, min(lo + block, top + 1))], steps, tol)
        for k, (m, ll) in enumerate(zip(fitted, lls, strict=True), lo):
            models.append(m)
            bic[k] = -2 * ll + (k * d + k * d * (d + 1) / 2 + k - 1) * np.log(max(n, 1))
            if k > 1 and abs(bic[k - 1] - bic[k]) < change_at * abs(bic[k - 1]):
                return models, bic
    return models, bic


def soft_clusters(df: DataFrame, key: str, vec: str, most: int = 49, at_least: float = 0.1, dims: int = 2) -> DataFrame:
    """key, cluster, p: every cluster of probability above at_least, and the most probable one in any case (overlapping). The number
    of parts has the least BIC; equal vectors get equal clusters."""
    points = cut(project(df, key, vec, dims))
    models, bic = fit_mixtures(points, most)
    kind = points.schema[key].dataType.simpleString()
    if not models:
        return points.select(key, F.lit(0).alias("cluster"), F.lit(1.0).alias("p"))
    best = min(bic, key=lambda k: (bic[k], k))
    model = models[best - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
            r, _ = _soft(x, model)
            keep = (r > at_least) | (np.arange(r.shape[1])[None, :] == r.argmax(1)[:, None])
            i, j = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(j, pa.int32()), pa.array(r[i, j])], names=[key, "cluster", "p"])

    return points.mapInArrow(run, f"{key} {kind}, cluster int, p double")


def layers(df: DataFrame, key: str, vec: str, most: int = 49, sparsity_at: float = 0.98, change_at: float = 0.05) -> DataFrame:
    """layer, key, cluster, and the next layer's items are the clusters' mean vectors. Stops at a sparsity of sparsity_at, a change
    of at most change_at, or two items; a layer has fewer items than the last, so it ends. Keys of higher layers are 'cluster-layer-number'."""
    items = cut(df.select(F.col(key).cast("string").alias("item"), F.col(vec).cast("array<double>").alias("v")).filter("v IS NOT NULL"))
    out, before = None, 0.01
    for layer in itertools.count():
        n = items.count()
        if n <= 2:
            break
        c = cut(soft_clusters(items, "item", "v", min(most, n - 1)))
        rows = c.select(F.lit(layer).alias("layer"), "item", "cluster", "p")
        out = rows if out is None else out.unionByName(rows)
        sizes = c.groupBy("cluster").agg(F.count("*").alias("x"))
        t, p = sizes.agg(F.sum("x"), F.sum(F.col("x") * (F.col("x") - 1))).first()
        sparsity = 1 - p / (t * (t - 1)) if t > 1 else 1.0
        if sparsity >= sparsity_at or abs(sparsity - before) / max(before, 1e-9) <= change_at:
            break
        before = sparsity
        mean = c.join(items, "item").select("cluster", F.posexplode("v")).groupBy("cluster", "pos").agg(F.avg("col").alias("a"))
        items = cut(mean.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "a"))).alias("l")).select(F.concat(F.lit(f"cluster-{layer}-"), F.col("cluster").cast("string")).alias("item"), F.transform("l", lambda x: x["a"]).alias("v")))
    return out if out is not None else items.select(F.lit(0).alias("layer"), "item", F.lit(0).alias("cluster"), F.lit(1.0).alias("p"))
