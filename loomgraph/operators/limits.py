"""Token limits of model calls: chat estimates, output clamps, stage caps, preflight checks, resuming of runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Safety margins in tokens.
PREFLIGHT_MARGIN, OUTPUT_MARGIN, PER_MESSAGE, PER_CHAT = 512, 2048, 4, 2


def chat_tokens(messages: DataFrame, chat: str, tokens: str) -> DataFrame:
    """chat, estimate: four tokens a message and two a chat beside the messages' own."""
    return messages.groupBy(chat).agg((F.sum(F.col(tokens) + PER_MESSAGE) + PER_CHAT).alias("estimate"))


def clamped_output(requested: Column, context: Column, prompt: Column) -> Column:
    """At least 1, at most what the context leaves beside the prompt and a margin."""
    return F.greatest(F.lit(1), F.least(requested, context - prompt - OUTPUT_MARGIN))


def stage_caps(defaults: dict[str, int], overrides: list[str]) -> dict[str, int]:
    """Defaults with 'stage=value' overrides; an unknown stage or a value that is no positive number raises."""
    out = dict(defaults)
    for o in overrides:
        stage, eq, value = o.partition("=")
        if not eq or stage.strip() not in defaults or not value.strip().isdigit() or int(value) < 1:
            raise ValueError(f"bad stage cap {o!r}")
        out[stage.strip()] = int(value)
    return out


def preflight(chunks: DataFrame, stages: DataFrame, context: int) -> DataFrame:
    """stage, prompt_tokens, output_cap, fits: whether each stage's largest prompt and its cap fit the context.
    stages: stage, overhead_tokens, output_cap."""
    top = chunks.agg(F.coalesce(F.max("tokens"), F.lit(0)).alias("top"))
    x = stages.join(F.broadcast(top))  # one row
    return x.select("stage", (F.col("overhead_tokens") + F.col("top")).alias("prompt_tokens"), "output_cap", (F.col("overhead_tokens") + F.col("top") + F.col("output_cap") <= context - PREFLIGHT_MARGIN).alias("fits"))


def run_requests(requests: DataFrame, call: Callable[[str], str], in_flight: int = 1) -> DataFrame:
    """custom_id, ok, text: one call a request, at most `in_flight` at a time in each task; an exception gives a row with its message
    instead of failing the run."""

    def one(i: str, body: str) -> tuple[str, bool, str]:
        try:
            return i, True, call(body)
        except Exception as e:  # noqa: BLE001
            return i, False, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for p in batches:
                yield pd.DataFrame(pool.map(one, p["custom_id"], p["body"]), columns=["custom_id", "ok", "text"])

    return requests.select("custom_id", "body").mapInPandas(run, "custom_id string, ok boolean, text string")


#: Named sets of retrieval modes for a benchmark (fixed names; see retrieval.MODES).
VARIANTS = {
    "baseline": ("naive", "hi"),
    "bridge": ("hi", "hi_weighted", "hi_minmax", "hi_minmax_budgeted", "hi_mcts"),
    "rerank": ("hi_rerank", "hi_rerank_weighted"),
}


def variants(names: list[str]) -> list[str]:
    """Presets and single modes to modes, each once, in order; an unknown name raises."""
    from loomgraph.operators.retrieval import MODES

    out: list[str] = []
    for n in names:
        if n not in VARIANTS and n not in MODES and n != "all":
            raise ValueError(f"unknown variant {n!r}")
        out += MODES if n == "all" else VARIANTS.get(n, (n,))
    return list(dict.fromkeys(out))
