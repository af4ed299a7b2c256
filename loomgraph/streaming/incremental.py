"""Incremental inserts and streaming forms of the general operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators import chunking
from loomgraph.operators.delivery import identity_text
from loomgraph.sources.stores import Store


def insert_documents(batch: DataFrame, docs: Store, chunks: Store, text: str = "text") -> None:
    """Add what is new of a batch to the document and chunk stores; inserting a batch again changes nothing."""
    new = docs.missing(chunking.dedupe_documents(batch, text))
    if new.limit(1).count() == 0:
        return
    fresh = chunks.missing(chunking.chunks(new))
    chunks.upsert(fresh)
    docs.upsert(new)


def stream_documents(source: DataFrame, docs: Store, chunks: Store, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """A stream of documents into the stores, batch by batch; `after` may rebuild communities."""

    def each(batch: DataFrame, number: int) -> None:
        insert_documents(batch, docs, chunks)
        if after:
            after(number)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_once(source: DataFrame, scope: str, ident: str, arrived: str, lateness: str) -> DataFrame:
    """The first seen delivery of each message within the watermark; those without an identifier all pass.

    A stream can't wait for an earlier arrival time, so here the first delivery seen is kept; the batch operator keeps the
    earliest."""
    x = source.withColumn("__id", F.coalesce(identity_text(F.col(scope), F.col(ident)), F.uuid())).withWatermark(arrived, lateness)
    return x.dropDuplicatesWithinWatermark(["__id"]).drop("__id")


def stream_telemetry(source: DataFrame, at: str, stage: str, value: str, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Calls and latency by stage and time window, with late events up to the watermark."""
    return source.withWatermark(at, lateness).groupBy(F.window(at, window).alias("w"), stage).agg(F.count("*").alias("calls"), F.sum(value).alias("latency_sum")).select(F.col("w.start").alias("start"), stage, "calls", "latency_sum")
