"""Stores as Parquet tables: key-value, vectors, response and edge-embedding caches, and the materialised index.

A store is a folder of versions; a commit writes a new version completely and then names it as current, so readers see the old or
the new one and a failed write changes nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import records as fr
from loomgraph.operators import vectors


class Store:
    """A keyed table: get, missing, upsert, drop."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def current(self) -> str | None:
        fs, path = self._fs()
        mark = path(f"{self.path}/CURRENT")
        if not fs.exists(mark):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(mark)]
        return max(names) if names else None

    def read(self) -> DataFrame | None:
        name = self.current()
        return self.spark.read.parquet(f"{self.path}/{name.split('.', 1)[1]}") if name else None

    def overwrite(self, df: DataFrame) -> None:
        before = self.current()
        n = int(before.split(".")[0]) + 1 if before else 0
        version = f"v{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        fs, path = self._fs()
        fs.mkdirs(path(f"{self.path}/CURRENT"))
        if any(s.getPath().getName().startswith(f"{n:09d}.") for s in fs.listStatus(path(f"{self.path}/CURRENT"))):
            raise RuntimeError(f"another writer committed version {n} of {self.path} first: read it and try again")
        fs.create(path(f"{self.path}/CURRENT/{n:09d}.{version}"), False).close()

    def get(self, keys: DataFrame, fields: list[str] | None = None) -> DataFrame:
        have = self.read()
        if have is None:
            return keys.select(*self.keys).limit(0)
        out = have.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")
        return out.select(*self.keys, *[f for f in fields if f not in self.keys]) if fields else out

    def missing(self, keys: DataFrame) -> DataFrame:
        have = self.read()
        return keys.join(have.select(*self.keys), self.keys, "left_anti") if have is not None else keys

    def upsert(self, rows: DataFrame, order: list | None = None) -> None:
        """New rows replace stored ones of the same key. Of rows with one key the last in `order` stays; without an order the one whose
        columns are greatest, so that the result doesn't depend on partitions."""
        rest = [c for c in rows.columns if c not in self.keys]
        if rest:
            by = F.struct(*(order or []), F.to_json(F.struct(*rest)))
            rows = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), by).alias("__r")).select(*self.keys, "__r.*").select(*rows.columns)
        else:
            rows = rows.distinct()
        have = self.read()
        self.overwrite(rows if have is None else have.join(rows.select(*self.keys), self.keys, "left_anti").unionByName(rows, allowMissingColumns=True))

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)


class VectorStore(Store):
    """Vectors by id: upsert embeds new texts, query gives the nearest ids."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, ["id"])

    def add(self, items: DataFrame, embedder=None) -> None:
        """items: id, content. Contents of ids that are stored already are embedded again."""
        self.upsert(vectors.embed(items, "id", "content", embedder=embedder).join(items.select("id", "content"), "id"))

    def query(self, queries: DataFrame, k: int, threshold: float = 0.2) -> DataFrame:
        """query_id, id, score, dense_order. queries: query_id, qvec."""
        from loomgraph.operators.retrieval import nearest

        return nearest(self.read(), queries, k, threshold)


def edge_requests(edges: DataFrame, nodes: DataFrame, model: str) -> DataFrame:
    """custom_id, src, tgt, input, text_hash, embedded_text_hash: one embedding request an edge, its id from its ends alone; both ends'
    descriptions are part of the text, which is cut to 2048 tokens for the model."""
    d = nodes.select("entity_name", "description")
    x = edges.join(d.select(F.col("entity_name").alias("src"), F.col("description").alias("sd")), "src", "left").join(d.select(F.col("entity_name").alias("tgt"), F.col("description").alias("td")), "tgt", "left")
    text = fr.edge_text(F.col("src"), F.col("sd"), F.col("tgt"), F.col("td"), F.col("description"))
    x = x.select("src", "tgt", text.alias("text")).withColumn("input", F.when(fr.n_tokens(F.col("text")) > 2048, fr.truncate_tokens(F.col("text"), 2048)).otherwise(F.col("text")))
    return x.select(F.concat(F.lit("edge-"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(model), "src", "tgt"), 256), 1, 24)).alias("custom_id"), "src", "tgt", "input", fr.text_hash(F.col("text")).alias("text_hash"), fr.text_hash(F.col("input")).alias("embedded_text_hash"))


def import_embeddings(outputs: DataFrame, requests: DataFrame, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors: src, tgt, text_hash, embedded_text_hash, vec; errors: custom_id, error) of the answers to edge requests, merged with an
    existing cache, of which what is still valid stays. outputs: custom_id, vec, error."""
    x = outputs.join(requests.drop("input"), "custom_id", "left")
    why = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("src").isNull(), "no metadata").when(F.col("vec").isNull(), "no embedding")
    k = ["src", "tgt", "text_hash", "embedded_text_hash"]
    good = x.filter(why.isNull()).groupBy(*k).agg(F.min("vec").alias("vec"))
    if cache is not None:
        good = good.unionByName(cache.select(*k, "vec").join(good.select("src", "tgt"), ["src", "tgt"], "left_anti"))
    return good, x.select("custom_id", why.alias("error")).filter("error IS NOT NULL")


def checked_vectors(vecs: DataFrame, items: DataFrame, key: str, namespace: str | None = None) -> DataFrame:
    """Vectors without an error, of the namespace, with id and embedding; raises if an item has none."""
    ok = vecs.filter(F.col(key).isNotNull() & F.col("vec").isNotNull())
    if "error" in vecs.columns:
        ok = ok.filter("error IS NULL")
    if namespace is not None:
        ok = ok.filter(F.col("namespace") == namespace)
    lost = items.select(key).join(ok.select(key), key, "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"items without a vector, among them {[r[0] for r in lost]}")
    return ok


def edge_cache_misses(edges: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid cached vectors, edges to embed): a vector holds only while both text hashes match."""
    k = ["src", "tgt", "text_hash", "embedded_text_hash"]
    return cache.join(edges.select(*k), k, "left_semi"), edges.join(cache.select(*k), k, "left_anti")


def materialize(index, folder: str) -> DataFrame:
    """Write all tables of an index below a folder; returns name and count of each."""
    spark = index.chunks.sparkSession
    rows = []
    for name in index.__dataclass_fields__:
        getattr(index, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        rows.append((name, spark.read.parquet(f"{folder}/{name}").count()))
    return spark.createDataFrame(rows, "name string, n bigint")


def load_index(spark: SparkSession, folder: str):
    from loomgraph.operators.retrieval import Index

    return Index(**{name: spark.read.parquet(f"{folder}/{name}") for name in Index.__dataclass_fields__})
