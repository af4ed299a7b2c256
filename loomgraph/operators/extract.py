"""Mentions from text: extraction records, capitalised names, co-occurrence, coverage."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import records as fr
from loomgraph.functions.records import n_words

#: Rows and pairs that a task takes at once.
ROWS, PAIRS = 1 << 16, 1 << 20


def _attributes(df: DataFrame, key: str, text: str) -> DataFrame:
    parts = F.split(F.replace(F.col(text), F.lit(fr.COMPLETE), F.lit(fr.RECORD)), fr.RECORD)
    rows = df.filter(F.contains(F.col(text), F.lit(fr.TUPLE))).select(F.col(key), F.posexplode(parts).alias("pos", "r"))
    return rows.select(key, (F.col("pos") + 1).cast("bigint").alias("pos"), F.split(F.regexp_extract("r", r"\((.*)\)", 1), r"<\|>").alias("p"))


def _upper(c: Column, unescape: bool) -> Column:
    return F.upper(fr.clean_name(c, True) if unescape else fr.trim_ws(c))


def parse_entities(df: DataFrame, key: str, text: str, unescape: bool = True) -> DataFrame:
    """key, pos, entity_name, entity_type, description of each well-formed entity record; names keep their quotes."""
    p = _attributes(df, key, text).filter((F.size("p") >= 4) & (fr.trim_ws(F.get("p", F.lit(0))) == '"entity"'))
    g = lambda i: F.get("p", F.lit(i))
    out = p.select(key, "pos", _upper(g(1), unescape).alias("entity_name"), _upper(g(2), unescape).alias("entity_type"), (fr.clean_name(g(3)) if unescape else fr.trim_ws(g(3))).alias("description"))
    return out.filter("entity_name <> ''")


def parse_relations(df: DataFrame, key: str, text: str, unescape: bool = True, drop_blank: bool = False) -> DataFrame:
    """key, pos, src_id, tgt_id, description, weight (the last attribute if it is a number, else 1)."""
    p = _attributes(df, key, text).filter((F.size("p") >= 5) & (fr.trim_ws(F.get("p", F.lit(0))) == '"relationship"'))
    g = lambda i: F.get("p", F.lit(i))
    last = fr.trim_ws(F.element_at("p", -1))
    out = p.select(key, "pos", _upper(g(1), unescape).alias("src_id"), _upper(g(2), unescape).alias("tgt_id"), (fr.clean_name(g(3)) if unescape else fr.trim_ws(g(3))).alias("description"), F.when(fr.is_float(last), last.try_cast("double")).otherwise(1.0).alias("weight"))
    return out.filter("src_id <> '' AND tgt_id <> ''") if drop_blank else out


def regex_entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, name: distinct capitalised names of each text, in order of first mention."""
    return df.select(F.col(key), F.posexplode(fr.entity_names(F.col(text))).alias("pos", "name"))


def chunk_entities(mentions: DataFrame, key: str) -> DataFrame:
    """key, names: the distinct names of each chunk in order of first mention. mentions: key, pos, name; a chunk bounds its names."""
    first = mentions.filter(F.col("name").isNotNull()).groupBy(key, "name").agg(F.min("pos").alias("pos"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))


def cooccurrence(mentions: DataFrame, key: str, block: int = 256, words: bool = False) -> DataFrame:
    """src < tgt, weight: the number of texts in which both names stand; with `words` also tokens, the words of both names. A text of up to `block`
    names is one row's work. The names of a longer one are cut into blocks by hash, as many as their number asks for, and every two blocks meet in
    a row of their own: no row holds more than about 2 x `block` names, however long the text."""
    m = mentions.select(F.col(key).alias("k"), "name").filter("k IS NOT NULL AND name IS NOT NULL")
    kind = "src string, tgt string, n bigint, tokens bigint"
    near = m.repartition("k").sortWithinPartitions(F.xxhash64("k"), "k").withColumn("k", F.col("k").cast("string")).mapInArrow(functools.partial(_pairs_of_texts, most=block), kind)
    long = m.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("k")
    m = m.join(long, "k", "left_semi").distinct()
    own = m.join(m.groupBy("k").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "k").withColumn("own", F.pmod(F.xxhash64("name"), "parts").cast("int"))
    cells = own.select("k", "name", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    lists = cells.groupBy("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("name"))).alias("a"), F.collect_list(F.when(F.col("own") > F.col("other"), F.col("name"))).alias("b"))
    far = lists.select("a", "b", (F.col("i") == F.col("j")).alias("inner")).mapInArrow(_pairs_of_lists, kind)
    e = near.unionByName(far).groupBy("src", "tgt").agg(F.sum("n").cast("double").alias("weight"), F.max("tokens").alias("tokens"))
    return e if words else e.drop("tokens")


def _pairs_of_texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of rows k, name, in which equal k follow each other: the pairs of names of each k that has at most `most` rows."""
    held = None
    for x in itertools.chain(batches, [None]):
        t = pa.Table.from_batches([y for y in (held, x) if y is not None]) if held is not None or x is not None else None
        held = None
        if t is None or not t.num_rows:
            continue
        t = t.combine_chunks()
        k = t["k"].chunk(0)
        first = np.r_[0, np.flatnonzero(np.asarray(pc.not_equal(k[1:], k[:-1]))) + 1]
        if x is not None and t.num_rows - first[0] < ROWS:  # more may come
            held = t.to_batches()[0]
            continue
        if x is not None:  # what the last k has isn't all here, unless it is too long anyway
            held = t.slice(first[-1]).to_batches()[0] if t.num_rows - first[-1] <= most else t.slice(t.num_rows - most - 1).to_batches()[0]
            t, first = t.slice(0, first[-1]), first[:-1]
        if t.num_rows:
            size = np.diff(np.r_[first, t.num_rows])
            keep = np.repeat(size <= most, size)
            names = t["name"].combine_chunks().filter(pa.array(keep))
            yield from _pairs(names, size[size <= most], names[:0], np.zeros((size <= most).sum(), np.int64), np.ones((size <= most).sum(), bool))


def _pairs_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows a, b, inner: the pairs within each list a that is inner, between the lists a and b of the others."""
    for x in batches:
        a, b = x.column(0), x.column(1)
        yield from _pairs(a.flatten(), np.asarray(pc.list_value_length(a), np.int64), b.flatten(), np.asarray(pc.list_value_length(b), np.int64), np.asarray(x.column(2).to_numpy(zero_copy_only=False), bool))


def _pairs(left: pa.Array, n: np.ndarray, right: pa.Array, m: np.ndarray, inner: np.ndarray) -> Iterator[pa.RecordBatch]:
    """src < tgt, n, tokens of pairs in rows that hold the next n names of left and m of right; pairs made at once are summed, and a name that a
    row holds twice counts once."""
    names = pc.unique(pa.concat_arrays([left, right]))
    names = names.take(pc.sort_indices(names))
    code = np.asarray(pc.index_in(pa.concat_arrays([left, right]), value_set=names), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    if len(left):
        key = np.unique(row * len(names) + code[: len(left)])
        row, own = np.divmod(key, len(names))
        n, code = np.bincount(row, minlength=len(n)), np.r_[own, code[len(left) :]]
    words = np.array([n_words(x) for x in names.cast(pa.binary()).to_pylist()], np.int64)
    at = np.arange(len(row))
    begin = np.where(inner[row], at + 1, len(row) + (np.cumsum(m) - m)[row])  # of an element's partners
    many = np.where(inner[row], np.cumsum(n)[row] - at - 1, m[row])
    for lo, hi in itertools.pairwise(np.r_[0, np.flatnonzero(np.diff(np.cumsum(many) // PAIRS)) + 1, len(at)]):
        k = many[lo:hi]
        u = code[np.repeat(at[lo:hi], k)]
        v = code[np.arange(k.sum()) + np.repeat(begin[lo:hi] - (np.cumsum(k) - k), k)]
        key, count = np.unique(np.minimum(u, v) * len(names) + np.maximum(u, v), return_counts=True)
        src, tgt = np.divmod(key, max(len(names), 1))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(src)), names.take(pa.array(tgt)), pa.array(count.astype(np.int64)), pa.array(words[src] + words[tgt])], names=["src", "tgt", "n", "tokens"])


def coverage(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """query_tokens, shared, coverage (shared / query) and Jaccard of the snippet tokens of two columns."""
    t = df.select(F.col(key), fr.snippet_tokens(F.col(a)).alias("q"), fr.snippet_tokens(F.col(b)).alias("x"))
    shared, union = F.size(F.array_intersect("q", "x")), F.size(F.array_union("q", "x"))
    return t.select(key, F.size("q").cast("bigint").alias("query_tokens"), shared.cast("bigint").alias("shared"), F.when(F.size("q") > 0, F.round(shared / F.size("q"), 9)).alias("coverage"), F.when(union > 0, F.round(shared / union, 9)).alias("jaccard"))


def section_tokens(df: DataFrame, key: str, text: str, heading: str = r"^#+ ") -> DataFrame:
    """Words under each heading of a text; the heading is carried forward over its lines."""
    lines = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    head = lines.withColumn("head", F.when(F.col("line").rlike(heading), F.regexp_replace("line", heading, "")))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = head.withColumn("section", F.last("head", True).over(w))
    return named.groupBy(key, F.coalesce("section", F.lit("")).alias("section")).agg(F.sum(F.when(F.col("head").isNull(), fr.n_tokens(F.col("line"))).otherwise(0)).cast("bigint").alias("tokens"))
