"""Documents to chunks: ids, word windows, separator chunks, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.records import prefixed_id, tokens, trim_ws, words_of
from loomgraph.operators.order import positions
from loomgraph.session import cut

#: Items of a shard of batches where none is given.
SHARD = 1 << 17


def dedupe_documents(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_key (doc-md5 of the stripped text), content, first_id and copies; blank and null texts are no documents."""
    t = df.select(F.col(key).alias("id"), trim_ws(F.col(text)).alias("content")).filter("content IS NOT NULL AND content <> ''")
    return t.groupBy(prefixed_id("doc", F.col("content")).alias("doc_key")).agg(F.min("content").alias("content"), F.min("id").alias("first_id"), F.count("*").alias("copies"))


def only_new(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored yet."""
    return df.join(stored.select(key).distinct(), key, "left_anti")


def word_windows(df: DataFrame, text: str, keep: list[str], size: int = 1200, overlap: int = 100, redundant_tail: bool = True) -> DataFrame:
    """Windows of `size` words at every multiple of size - overlap. With redundant_tail each start below the length gives a
    window, even one that lies within the last overlap; without it the windows stop when the end is reached."""
    step = max(1, size - overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            row, no, n, content = [], [], [], []
            for i, t in enumerate(x.column(len(keep)).cast(pa.binary()).to_pylist()):
                w = words_of(t or b"")
                last = len(w) - 1 if redundant_tail else max(len(w) - overlap - 1, 0)
                for k, at in enumerate(range(0, last + 1, step) if w else ()):
                    part = w[at : at + size]
                    row.append(i)
                    no.append(k)
                    n.append(len(part))
                    content.append(b" ".join(part))
            own = [x.column(i).take(pa.array(row, pa.int64())) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(no, pa.int32()), pa.array(n, pa.int64()), pa.array(content, pa.binary()).view(pa.string())], names=[*keep, "chunk_order_index", "tokens", "content"])

    src = df.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{fields}{', ' * bool(keep)}chunk_order_index int, tokens bigint, content string")


def chunks(docs: DataFrame, key: str = "doc_key", text: str = "content", size: int = 1200, overlap: int = 100, order: str | None = None, chunker=None) -> DataFrame:
    """chunk_id, full_doc_id, chunk_order_index, tokens, content. Equal contents collapse, the last one by the documents' order wins (by
    default first_id where there is one, else the key). chunker: documents, text, key to rows of key, chunk_order_index, tokens, content."""
    order = order or ("first_id" if "first_id" in docs.columns else key)
    own = docs.select(key, text, F.col(order).alias("__order"))
    w = chunker(own, text, [key, "__order"]) if chunker else word_windows(own, text, [key, "__order"], size, overlap)
    w = w.withColumn("chunk_id", prefixed_id("chunk", F.col("content")))
    last = w.groupBy("chunk_id").agg(F.max_by(F.struct(F.col(key).alias("full_doc_id"), "chunk_order_index", "tokens", "content"), F.struct("__order", key, "chunk_order_index")).alias("c"))
    return last.select("chunk_id", "c.*")


def separator_chunks(docs: DataFrame, key: str, text: str, separators: list[str], size: int, overlap: int) -> DataFrame:
    """Chunks cut at separators (which stay at the end of their part), packed to at most `size` words; each new chunk begins
    with the last `overlap` words of the one before; a part longer than `size` is cut by sliding windows."""
    import re

    cut = re.compile("|".join(re.escape(s) for s in sorted(separators, key=len, reverse=True)))

    def split(t: str | None) -> list[list[str]]:
        parts, at = [], 0
        for m in cut.finditer(t or ""):
            parts.append(t[at : m.end()].split())
            at = m.end()
        parts.append((t or "")[at:].split())
        merged: list[list[str]] = []
        for p in filter(None, parts):
            if len(p) > size:
                step = max(1, size - overlap)
                merged += [p[i : i + size] for i in range(0, len(p), step) if i == 0 or len(p) - i > overlap]
            elif merged and len(merged[-1]) + len(p) <= size:
                merged[-1] = merged[-1] + p
            else:
                merged.append(p)
        return [p if i == 0 else (merged[i - 1][-overlap:] + p)[:size] if overlap else p for i, p in enumerate(merged)]

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[" ".join(p) for p in split(t)] for t in s])

    out = docs.select(F.col(key), F.posexplode(run(F.col(text))).alias("chunk_order_index", "content"))
    return out.withColumn("chunk_id", prefixed_id("chunk", F.col("content"))).withColumn("tokens", F.size(tokens(F.col("content"))).cast("bigint"))


def chunk_stats(df: DataFrame, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.count("*").alias("chunk_count"), F.sum("tokens").alias("total_tokens"), F.max("tokens").alias("max_tokens"))


def unique_contexts(df: DataFrame, context: str, order: list[str]) -> DataFrame:
    """Each distinct context once, with the first place it stands at."""
    first = df.filter(F.col(context).isNotNull()).groupBy(context).agg(F.min(F.struct(*order)).alias("f"))
    return first.select(context, *[F.col(f"f.{c}").alias(c) for c in order])


def dataset_stats(df: DataFrame, text: str, label: list[str]) -> DataFrame:
    """Rows, mean length (round 2) and bytes for the first known label."""
    return df.groupBy(F.coalesce(*[F.col(c) for c in label], F.lit("unknown")).alias("label")).agg(
        F.count("*").alias("n_rows"), F.round(F.avg(F.length(text)), 2).alias("avg_chars"), F.sum(F.octet_length(text)).cast("bigint").alias("n_bytes")
    )


def greedy_batches(df: DataFrame, key: str, cost: str, most_cost: int, most_items: int, shard: str | None = None) -> DataFrame:
    """Batch numbers for items in order of key: a batch closes before the item that would take it over a bound. Resetting
    sums are sequential, so they run inside shards: the given column, or else every SHARD items of the one global order, whatever the
    number of partitions. Items without a cost are left out."""

    def run(batches):
        n, total, items, before = 0, 0, 0, None
        for pdf in batches:
            out = []
            for s, c in zip(pdf["__shard"], pdf[cost], strict=True):
                if s != before:
                    n, total, items, before = 0, 0, 0, s
                if items and (total + c > most_cost or items >= most_items):
                    n, total, items = n + 1, 0, 0
                total, items = total + c, items + 1
                out.append(n)
            yield pdf.assign(batch_no=out)

    src = df.filter(F.col(cost).isNotNull())
    src = src.withColumn("__shard", F.col(shard).cast("string")) if shard else positions(src, [F.asc(key)], "__pos").withColumn("__shard", F.floor(F.col("__pos") / SHARD).cast("string")).drop("__pos")
    src = src.repartition("__shard").sortWithinPartitions("__shard", key)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInPandas(run, f"{fields}, batch_no bigint").withColumnRenamed("__shard", "batch_shard")


def token_budget(df: DataFrame, group: list[str], order: list, cost: str, budget, split: bool = False) -> DataFrame:
    """The prefix of each ranked list whose running cost stays within the budget: it ends before the first item that overflows,
    so a first item beyond the budget gives nothing. A null cost counts 0.

    With split a list is spread over tasks by ranges of its order (which should end with a unique column), and running costs are two-level, so
    that a group may hold any share of the rows."""
    if not split:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("running_cost", F.sum(F.coalesce(F.col(cost), F.lit(0))).over(w)).filter(F.col("running_cost") <= budget)
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = cut(df.repartitionByRange(parts, *group, *order).withColumn("__part", F.spark_partition_id()))
    sums = x.groupBy(*group, "__part").agg(F.sum(F.coalesce(F.col(cost), F.lit(0))).alias("__n"))
    ahead = sums.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))  # a row for each group and part
    ahead = ahead.filter(F.col("__ahead") <= budget)
    same = F.col("__part") == F.col("__p")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    w = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(ahead, same).withColumn("running_cost", F.col("__ahead") + F.sum(F.coalesce(F.col(cost), F.lit(0))).over(w))
    return x.filter(F.col("running_cost") <= budget).drop("__part", "__p", "__ahead", *[f"__{g}" for g in group])
