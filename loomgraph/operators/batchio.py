"""Batch requests and responses: parsing, retries, resuming, validation, response cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESPONSE = (
    "custom_id string, error string, response struct<status_code: int, body: struct<id: string, choices: array<struct<finish_reason: string, message: struct<content: string>>>, "
    "usage: struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint, input_tokens: bigint, output_tokens: bigint>>>"
)
REQUEST = "custom_id string, method string, url string, body string"


def response_text(df: DataFrame) -> DataFrame:
    """custom_id, ok, text (the content, or why there is none), finish_reason, prompt_tokens, completion_tokens, retryable."""
    first = F.get("response.body.choices", F.lit(0))
    u = F.col("response.body.usage")
    bad = F.col("error").isNotNull() | (F.col("response.status_code") >= 400)
    return df.select(
        "custom_id", (~F.coalesce(bad, F.lit(False)) & first["message"]["content"].isNotNull()).alias("ok"),
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("response.status_code") >= 400, F.concat(F.lit("status "), F.col("response.status_code").cast("string"))).otherwise(first["message"]["content"]).alias("text"),
        first["finish_reason"].alias("finish_reason"), F.coalesce(u["prompt_tokens"], u["input_tokens"]).alias("prompt_tokens"), F.coalesce(u["completion_tokens"], u["output_tokens"]).alias("completion_tokens"),
        (F.coalesce(bad, F.lit(False)) | F.coalesce(first["finish_reason"] == "length", F.lit(False))).alias("retryable"),
    )


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't written yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def retries(requests: DataFrame, parsed: DataFrame, cap: int, limit: int) -> DataFrame:
    """The retryable requests with their output cap raised: doubled, at most `limit`; the older name of the cap is dropped."""
    again = parsed.filter("retryable").select("custom_id").distinct()
    body = F.from_json("body", "map<string,string>")
    return requests.join(again, "custom_id", "left_semi").withColumn("__b", body).withColumn(
        "max_completion_tokens", F.least(F.lit(limit), 2 * F.coalesce(F.col("__b")["max_completion_tokens"].try_cast("int"), F.col("__b")["max_tokens"].try_cast("int"), F.lit(cap)))
    ).drop("__b")


def validate(requests: DataFrame, most_rows: int = 50_000, most_bytes: int = 200_000_000) -> dict:
    """Raises on an empty or repeated custom_id, more than one endpoint, too many rows or bytes."""
    r = requests.agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("custom_id"), F.lit("")) == "").alias("blank"), F.count_distinct("custom_id").alias("ids"),
        F.count_distinct("url").alias("urls"), F.sum(F.octet_length(F.to_json(F.struct(*requests.columns)))).alias("bytes"),
    ).first()
    problems = [w for w, bad in (("blank custom_id", r.blank), ("repeated custom_id", r.ids != r.n - r.blank), ("more than one url", r.urls > 1), ("too many rows", r.n > most_rows), ("too many bytes", (r.bytes or 0) > most_bytes)) if bad]
    if problems:
        raise ValueError("; ".join(problems))
    return {"rows": r.n, "bytes": r.bytes or 0}


def with_metadata(parsed: DataFrame, metadata: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Left join on custom_id: outputs without metadata are kept with a note, and with the given defaults in place of nulls."""
    m = metadata.withColumn("__known", F.lit(True))
    out = parsed.join(m, "custom_id", "left").withColumn("note", F.when(F.col("__known").isNull(), "no metadata")).drop("__known")
    return out.fillna(defaults) if defaults else out


def retryable(df: DataFrame, ident: str = "custom_id") -> DataFrame:
    """The identified rows that failed: with an error, or with a status of 400 or more."""
    return df.filter(F.col(ident).isNotNull() & (F.col("error").isNotNull() | (F.col("response.status_code") >= 400)))


def cache_key(model: Column, messages: Column) -> Column:
    return F.md5(F.concat_ws("\u0001", model, messages))


def cached_calls(requests: DataFrame, cache: DataFrame, call: Callable[[list[str]], list[str]]) -> tuple[DataFrame, DataFrame]:
    """(request_id, ret, cache_hit) of all requests, and the rows to append to the cache. Each distinct miss is called once.
    requests: request_id, model, messages; cache: args_hash, ret, model."""
    r = requests.withColumn("args_hash", cache_key(F.col("model"), F.col("messages")))
    miss = r.join(cache.select("args_hash"), "args_hash", "left_anti").groupBy("args_hash").agg(F.min("model").alias("model"), F.min("messages").alias("messages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"args_hash": p["args_hash"], "ret": call(p["messages"].tolist()), "model": p["model"]})

    new = miss.mapInPandas(run, "args_hash string, ret string, model string")
    all_ = cache.select("args_hash", "ret", F.lit(True).alias("cache_hit")).unionByName(new.select("args_hash", "ret", F.lit(False).alias("cache_hit")))
    return r.select("request_id", "args_hash").join(all_, "args_hash").select("request_id", "ret", "cache_hit"), new
