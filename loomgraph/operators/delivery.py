"""Exactly one delivery of each message: an exact quotient hash table, sharded by quotient.

The identity (scope, identifier) is packed to a fixed-width word of 256 bits and permuted by a bijective Feistel network. The
high bits of the permuted word are its quotient, which alone chooses the shard. A shard is an open-addressing table: the bits
after the quotient give an entry's home slot, and the slot holds the complete word, so an entry is met only by the same word and
there are no false matches. Each identity is inserted once; of two deliveries of one identity the table keeps the earlier, and
the other is a delivery to drop.

Insertion happens twice, before and after the one shuffle. First every input partition fills tables of its own, so that a message
that holds a third of all rows arrives at its shard as one entry a partition and table; then the shard takes these entries in order of
their quotients. A table is emptied when it is full (before the shuffle) or at the next quotient (in the shard), which bounds its
size whatever the size of a partition. Losers of the first insertion pass through the shuffle spread evenly, 16 bytes each.

Defined results: a null identifier never equals another, such deliveries are all kept; a null scope is a scope of its own;
an identifier of nothing but white space is an identifier; received_at null comes last, then the smallest delivery id; a
delivery without an id is kept, since it can't be named; rows that repeat a delivery in all these values are one delivery.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import strip_spaces

ROUNDS = 4
#: Bits of the quotient; 2^16 quotients are spread over the shards by Spark's exchange.
QUOTIENT_BITS = 16
#: Entries after which a table is emptied.
TABLE = 1 << 18
NEVER = np.iinfo(np.int64).max
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def identity_text(scope: Column, ident: Column) -> Column:
    """The identity's text, with the scope's length before it so that no two identities share a text."""
    s = F.coalesce(scope.cast("string"), F.lit(""))
    return F.when(ident.isNotNull(), F.concat(F.when(scope.isNull(), "n").otherwise(F.length(s).cast("string")), F.lit(":"), s, F.lower(strip_spaces(ident))))


def fixed_width(text: Column) -> Column:
    """256 bits: a digest of which no two texts are known to share one."""
    return F.unhex(F.sha2(text, 256))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def permute(w: np.ndarray) -> np.ndarray:
    """A balanced Feistel network over 2 x 128 bits (rows of four words): a bijection whatever the round function."""
    a, b, c, d = w.T.copy()
    for r in range(ROUNDS):
        a, b, c, d = c, d, a ^ _mix(c + _mix(d, 2 * r), 2 * r + 1), b ^ _mix(d + _mix(c, 2 * r + 1), 2 * r)
    return np.column_stack([a, b, c, d])


def unpermute(w: np.ndarray) -> np.ndarray:
    """The inverse of permute."""
    a, b, c, d = w.T.copy()
    for r in reversed(range(ROUNDS)):
        a, b, c, d = c ^ _mix(a + _mix(b, 2 * r), 2 * r + 1), d ^ _mix(b + _mix(a, 2 * r + 1), 2 * r), a, b
    return np.column_stack([a, b, c, d])


def quotient(w: np.ndarray) -> np.ndarray:
    return (w[:, 0] >> np.uint64(64 - QUOTIENT_BITS)).astype(np.int32)


class QuotientTable:
    """Open addressing over complete words, with the earliest delivery of each. All deliveries of a batch go in together."""

    def __init__(self, bits: int = 12):
        self.n, self.bits = 0, bits
        self.words = np.zeros((1 << bits, 4), np.uint64)
        self.used = np.zeros(1 << bits, bool)
        self.at, self.d = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)

    def home(self, w: np.ndarray) -> np.ndarray:
        return ((w[:, 0] << np.uint64(QUOTIENT_BITS)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def insert(self, w: np.ndarray, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The delivery ids that lose."""
        order = np.lexsort((d, at, w[:, 3], w[:, 2], w[:, 1], w[:, 0]))
        w, at, d = w[order], at[order], d[order]
        first = np.r_[True, (w[1:] != w[:-1]).any(1)] if len(w) else np.zeros(0, bool)
        head = np.flatnonzero(first)
        of = head[np.cumsum(first) - 1]
        lost = [d[~first & ((d != d[of]) | (at != at[of]))]]
        w, at, d = w[head], at[head], d[head]
        while self.n + len(w) > self.used.size * 0.6:
            self._grow()
        self.n += self._place(w, at, d, lost)
        return np.concatenate(lost)

    def _place(self, w, at, d, lost) -> int:
        """Linear probing for distinct words, all at once: in each round the entries at a free slot take it (the first of several),
        those that meet their own word merge with it, and the rest go on to the next slot."""
        todo, slot, new = np.arange(len(w)), self.home(w), 0
        while len(todo):
            s = slot[todo]
            free = np.flatnonzero(~self.used[s])
            take = free[np.unique(s[free], return_index=True)[1]]
            i = todo[take]
            self.words[slot[i]], self.at[slot[i]], self.d[slot[i]], self.used[slot[i]] = w[i], at[i], d[i], True
            new += len(i)
            todo = np.delete(todo, take)
            met = (self.words[slot[todo]] == w[todo]).all(1)
            i, todo = todo[met], todo[~met]
            s = slot[i]
            if len(i):
                same = (self.at[s] == at[i]) & (self.d[s] == d[i])
                better = (at[i] < self.at[s]) | ((at[i] == self.at[s]) & (d[i] < self.d[s]))
                lost.append(np.where(better, self.d[s], d[i])[~same])
                self.at[s[better]], self.d[s[better]] = at[i[better]], d[i[better]]
            slot[todo] = (slot[todo] + 1) & (self.used.size - 1)
        return new

    def _grow(self) -> None:
        w, at, d = self.entries()
        self.__init__(self.bits + 1)
        self.n = self._place(w, at, d, [])

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.words[self.used], self.at[self.used], self.d[self.used]


_OUT = "quotient int, word binary, at bigint, d bigint"
_ARROW = pa.schema([("quotient", pa.int32()), ("word", pa.binary()), ("at", pa.int64()), ("d", pa.int64())])


def _words(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 4)


def _entries(w: np.ndarray, at: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    raw = w.astype(">u8").tobytes()
    col = pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer((np.arange(len(w) + 1, dtype=np.int32) * 32).tobytes()), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([pa.array(quotient(w)), col, pa.array(at), pa.array(d)], schema=_ARROW)


def _losers(d: np.ndarray) -> pa.RecordBatch:
    spread = (_mix(d.astype(np.uint64), 7) >> np.uint64(64 - QUOTIENT_BITS)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(len(d), pa.binary()), pa.nulls(len(d), pa.int64()), pa.array(d)], schema=_ARROW)


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words to the entries of this partition's tables, and the deliveries that lost already (word null)."""
    table = QuotientTable()
    for b in batches:
        lost = table.insert(permute(_words(b.column(0))), np.asarray(b.column(1)), np.asarray(b.column(2)))
        if len(lost):
            yield _losers(lost)
        if table.n > TABLE:
            yield _entries(*table.entries())
            table = QuotientTable()
    if table.n:
        yield _entries(*table.entries())


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in order of their quotients to the deliveries that lose."""
    out = pa.schema([("delivery_id", pa.int64())])
    table, last = QuotientTable(), -1
    for b in batches:
        q, known = np.asarray(b.column(0)), np.asarray(b.column(1).is_valid())
        d = np.asarray(b.column(3))
        if not known.all():
            yield pa.RecordBatch.from_arrays([pa.array(d[~known])], schema=out)
        e = b.filter(b.column(1).is_valid())
        if not e.num_rows:
            continue
        q, w, at, d = q[known], _words(e.column(1)), np.asarray(e.column(2)), d[known]
        if table.n > TABLE:  # all entries of the last quotient have to meet, those before it are done with
            old = QuotientTable()
            keep = quotient(table.words[table.used]) == last
            old.insert(*(x[keep] for x in table.entries()))
            table = old
        lost, last = table.insert(w, at, d), int(q[-1])
        if len(lost):
            yield pa.RecordBatch.from_arrays([pa.array(lost)], schema=out)


def to_drop(df: DataFrame, scope: str = "run_id", ident: str = "custom_id", arrived: str = "received_at", delivery: str = "delivery_id") -> DataFrame:
    """delivery_id of every delivery that is not the kept one of its message."""
    rows = df.filter(F.col(ident).isNotNull() & F.col(delivery).isNotNull()).select(
        fixed_width(identity_text(F.col(scope), F.col(ident))).alias("word"),
        F.coalesce(F.unix_micros(F.col(arrived).cast("timestamp")), F.lit(int(NEVER))).alias("at"), F.col(delivery).cast("bigint").alias("d"),
    )
    spark = df.sparkSession
    shards = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInArrow(_before, _OUT).repartition(shards, "quotient").sortWithinPartitions("quotient").mapInArrow(_shard, "delivery_id bigint")


def once(df: DataFrame, scope: str = "run_id", ident: str = "custom_id", arrived: str = "received_at", delivery: str = "delivery_id") -> DataFrame:
    """df without the deliveries to drop; every column is kept."""
    gone = to_drop(df, scope, ident, arrived, delivery).withColumnRenamed("delivery_id", "__gone")
    return df.join(gone, F.col(delivery) == F.col("__gone"), "left_anti")


def found(tables: dict[str, DataFrame]) -> DataFrame:
    """source_table, delivery_id of the deliveries to drop from each table."""
    parts = [to_drop(df).select(F.lit(name).alias("source_table"), "delivery_id") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
