"""Near-duplicate records: an exact set-similarity join that uses relations between sets.

A record is the set of its runs of successive words. Sets of Jaccard similarity of at least a threshold are found, all of
them, in these steps:

1. Records of equal word sequence form a class; one representative goes on. A notice copied a third of all times is one set.
2. The members of every set are put in one global order, rare ones first (by a fixed-size table of counts over all records).
   Any two similar sets then share a member within their prefixes.
3. Index lists hold, for each prefix member, the sets it occurs in, sorted by size and position and cut into blocks of at most
   BLOCK entries. A block keeps its bounds of size and position: pairs of blocks whose bounds rule out the needed overlap are
   skipped before any entry is looked at. The lists travel once, packed by bucket; the list of a hot member is split into groups,
   and every two groups meet in a bucket of their own. A pair of sets is a candidate if the members its prefixes share and what is
   left after the last of them can reach the needed overlap, and if bitmaps of the two sets allow it. Only sets of such pairs travel.
4. Set relations: sets within `CLOSE` of a leader follow it. Leaders are joined at a threshold lowered by the followers'
   distances (Jaccard distance is a metric, so nothing can be missed). A follower's answers are derived from its leader's
   computed answers: |y and z| = |x and z| - |(x minus y) and z| + |(y minus x) and z|, from the few members that differ. A
   leader's followers are kept in parts, so that a leader of very many spreads over tasks.
5. Classes are expanded to records, large ones in groups.

Defined results: null, empty and short texts (fewer words than `least_words`) have no near-duplicate. Members are 64-bit
hashes of the runs. Rows of the same id and text are one record; ids are unique otherwise. Rows of a null id are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import written

SIZE, THRESHOLD, LEAST_WORDS = 3, 0.6, 30
CLOSE = 0.95
BLOCK = 64
#: Sets a list may have by the counters before it is split, candidates packed at once, followers and class members in a part.
LIST, EVENTS, PART = 4096, 1 << 19, 64
#: Counters that give the global order; fixed, so the driver and the broadcast hold 1 MB.
COUNTERS = 1 << 18
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def parallelism(spark) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ---------------------------------------------------------------- sets and their order


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat.astype(np.int64)))


def _flat(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a list column."""
    off = np.asarray(col.offsets)
    return np.asarray(col.flatten()), np.diff(off)


class Known(dict):
    """Hashes of words, computed once each."""

    def __missing__(self, w: str) -> int:
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode())
        return h


def records(df: DataFrame, key: str, text: str, size: int, least_words: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep) and (sets: rep id, s sorted) with one set for each class of equal word sequences."""
    least = max(size, least_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for b in batches:
            ids, digests, sets = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = _WORD.findall(t.lower()) if t else ()
                if len(words) < least:
                    continue
                if len(known) > 1 << 17:
                    known.clear()
                h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                run = np.zeros(len(h) - size + 1, np.uint64)
                for k in range(size):
                    run = mixed(run * _GOLD + h[k : len(h) - size + 1 + k])
                ids.append(i), digests.append(hashlib.sha256(" ".join(words).encode()).digest()), sets.append(np.unique(run.view(np.int64)))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), _lists(np.concatenate(sets), np.array([len(s) for s in sets]))], names=["id", "digest", "s"])

    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("t")).filter("id IS NOT NULL AND t IS NOT NULL")
    w = written(rows.mapInArrow(run, "id bigint, digest binary, s array<bigint>"), "sets")
    first = w.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    members = written(w.select("id", "digest").join(first.select("digest", "rep"), "digest").select("id", "rep").distinct(), "members")
    copies = members.filter("id <> rep").select("id")  # its size is that of a file: Spark broadcasts it only where it is small
    return members, w.join(copies, "id", "left_anti").select("id", "s")


def counters(sets: DataFrame) -> np.ndarray:
    """How many sets have a member of each counter: each partition's counts, added up in slices."""
    slices = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            total += np.bincount(_flat(b.column(0))[0] & (COUNTERS - 1), minlength=COUNTERS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.astype(np.int32).tobytes() for x in np.split(total, slices)])], names=["c", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for c, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[c] = total.get(c, 0) + np.frombuffer(n, np.int32)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.int32).tobytes() for x in total.values()])], names=["c", "n"])

    rows = sets.select("s").mapInArrow(count, "c int, n binary").repartition(min(slices, parallelism(sets.sparkSession)), "c").mapInArrow(add, "c int, n binary").collect()
    table = np.zeros((slices, COUNTERS // slices), np.int32)  # `slices` rows came back
    for r in rows:
        table[r.c] = np.frombuffer(bytes(r.n), np.int32)
    return table.ravel()


# ---------------------------------------------------------------- packed rows by bucket


def pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n, out, at = len(raw) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += out[-1].nbytes
    return out


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray], kinds: tuple) -> Iterator[pa.RecordBatch]:
    """One packed row for each bucket. Ids (the int64 columns) are stored as differences. `kinds` is one of KINDS."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    data = [pack(*[np.diff(c[lo:hi], prepend=0) if k is np.int64 else c[lo:hi].astype(k) for c, k in zip(columns, kinds, strict=True)]) for lo, hi in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array(np.full(len(cuts), KINDS.index(kinds), np.int32)), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])


def of_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[tuple, list[np.ndarray]]]:
    """The columns of each bucket by kind, from rows sorted by bucket."""
    last, parts = None, {}
    joined = lambda: {k: [np.concatenate(c) for c in zip(*p, strict=True)] for k, p in parts.items()}
    for b in batches:
        for key, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != last and parts:
                yield joined()
                parts = {}
            last, kinds = key, KINDS[kind]
            parts.setdefault(kinds, []).append([np.cumsum(c) if t is np.int64 else c for c, t in zip(unpack(data, kinds), kinds, strict=True)])
    if parts:
        yield joined()


def met(rows: DataFrame) -> DataFrame:
    return rows.repartition(parallelism(rows.sparkSession), "bucket").sortWithinPartitions("bucket")


ENTRY = (np.uint32, np.int64, np.int32, np.int32, np.float32, np.uint8)  # member, id, size, position, radius, side
EVENT = (np.int64, np.int64, np.int32, np.int32, np.int32)  # a, b, shared members, members left, overlap needed
SKETCH = (np.int64, np.int32, "V64")  # id, size, bits
HALF = (np.int64, np.int64, np.int32, np.int32, "V64")  # a, b, overlap needed, size and bits of a
KINDS = (ENTRY, EVENT, SKETCH, HALF)
PACKED = "bucket int, kind int, data binary"


def needed(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.ceil(t / (1 + t) * (a + b) - 1e-6).astype(np.int32)


def listed(sets: DataFrame, table, base: float, widest: float, buckets: int, limit: int) -> DataFrame:
    """sets: id, s, r to the packed entries of all index lists: the members in the prefix that a join at base - r - widest needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for b in batches:
            if not b.num_rows:
                continue
            flat, n = _flat(b.column(1))
            ids, r = np.asarray(b.column(0)), np.asarray(b.column(2))
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, counts[flat & (COUNTERS - 1)], owner))
            start = np.r_[0, np.cumsum(n)[:-1]]
            pos = np.arange(len(flat)) - start[owner]
            need = np.ceil(np.maximum(base - widest - r, 0.01) * n - 1e-6).astype(np.int64)
            keep = pos < (n - need + 1)[owner]
            m, owner, pos = flat[order][keep], owner[keep], pos[keep]
            groups = np.maximum(1, -(-counts[m & (COUNTERS - 1)].astype(np.int64) // limit))
            mine = (mixed(ids[owner].view(np.uint64)) % groups.astype(np.uint64)).astype(np.int64)
            again = np.repeat(np.arange(len(m)), groups)  # an entry of a split list goes to each cell of two groups that has its own
            other = np.arange(len(again)) - np.repeat(np.cumsum(groups) - groups, groups)
            own, owner, pos = mine[again], owner[again], pos[again]
            side = np.where(other == own, 0, np.where(own < other, 1, 2))
            cell = np.minimum(own, other) * np.int64(1_000_003) + np.maximum(own, other)
            h = mixed(m[again].view(np.uint64) ^ (cell.astype(np.uint64) * _GOLD))
            yield from by_bucket((h >> np.uint64(32)) % np.uint64(buckets), [h & np.uint64(0xFFFFFFFF), ids[owner], n[owner], pos, r[owner], side], ENTRY)

    return sets.select("id", "s", "r").mapInArrow(run, PACKED)


def block_pairs(m, ids, n, pos, r, side, base: float) -> Iterator[tuple]:
    """Entries that meet in an index list and can still reach their overlap: a, b, 1, members left, overlap needed. Entries are
    sorted by member, size and position."""

    def check(i: np.ndarray, j: np.ndarray):
        ok = np.isin(side[i] + side[j], (0, 3)) & (ids[i] != ids[j])
        i, j = i[ok], j[ok]
        t = base - r[i].astype(float) - r[j]
        need = needed(t, n[i], n[j])
        left = np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1
        ok = (np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j]) - 1e-6) & (left + 1 + np.minimum(pos[i], pos[j]) >= need)
        i, j = i[ok], j[ok]
        return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.ones(len(i), np.int32), left[ok], need[ok]

    at = np.arange(len(m))
    head = np.r_[True, m[1:] != m[:-1]]
    within = at - np.maximum.accumulate(np.where(head, at, 0))
    cut = within % BLOCK == 0
    block = np.cumsum(cut) - 1
    for k in range(1, BLOCK):  # within a block
        i = np.flatnonzero(block[:-k] == block[k:]) if k < len(m) else at[:0]
        if not len(i):
            break
        yield check(i, i + k)
    starts = np.flatnonzero(cut)
    ends = np.r_[starts[1:], len(m)]
    lo, hi = n[starts], n[ends - 1]
    first, loose = np.minimum.reduceat(pos, starts), base - 2.0 * np.maximum.reduceat(r, starts)
    of = m[starts]
    for x in np.flatnonzero(of[:-1] == of[1:]):  # a block and the later ones of its list
        y = np.arange(x + 1, np.searchsorted(of[x:], of[x], "right") + x) if len(m) else at[:0]
        t = np.minimum(loose[x], loose[y])
        y = y[(hi[x] >= t * lo[y] - 1e-6) & (np.minimum(hi[x] - first[x], hi[y] - first[y]) + np.minimum(pos[starts[x] : ends[x]].max(), hi[y]) >= needed(t, lo[x], lo[y]))]
        if len(y):
            j = np.concatenate([np.arange(starts[k], ends[k]) for k in y])
            i = np.arange(starts[x], ends[x])
            yield check(np.repeat(i, len(j)), np.tile(j, len(i)))


def summed(parts: list[tuple]) -> tuple:
    """Events added up by pair: shared members, least left, needed."""
    a, b, c, left, need = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b, c, left, need = (x[order] for x in (a, b, c, left, need))
    cuts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return (a[cuts], b[cuts], np.add.reduceat(c, cuts), np.minimum.reduceat(left, cuts), need[cuts]) if len(a) else (a, b, c, left, need)


def id_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return mixed(ids.view(np.uint64) * _GOLD) % np.uint64(buckets)


def sketched(sets: DataFrame, buckets: int) -> DataFrame:
    """The packed bitmaps of all sets: 512 bits, one set by each member. Two sets of overlap c differ in at most n + m - 2c bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat, n = _flat(b.column(1))
                ids, bits = np.asarray(b.column(0)), np.zeros((len(n), 512), np.uint8)
                bits[np.repeat(np.arange(len(n)), n), (mixed(flat.view(np.uint64)) >> np.uint64(55)).astype(np.int64)] = 1
                yield from by_bucket(id_bucket(ids, buckets), [ids, n, np.packbits(bits, axis=1).view("V64")[:, 0]], SKETCH)

    return sets.select("id", "s").mapInArrow(run, PACKED)


def of_ids(table: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, bits) of the ids, all of which are in the table."""
    order = np.argsort(table[0], kind="stable")
    at = order[np.searchsorted(table[0], ids, sorter=order)]
    return table[1][at], table[2][at]


def candidates(sets: DataFrame, table, base: float, widest: float, limit: int) -> DataFrame:
    """(a, b), a < b, each pair once: all pairs that neither the members shared in their prefixes nor their bitmaps rule out.
    sets: id, s, r."""
    buckets = parallelism(sets.sparkSession) * 8

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(parts):
            a, b, *rest = summed(parts)
            if len(a):
                yield from by_bucket(id_bucket(a, buckets), [a, b, *rest], EVENT)

        for kinds in of_bucket(batches):
            columns = kinds[ENTRY]
            order = np.lexsort((columns[3], columns[2], columns[0]))
            parts, held = [], 0
            for p in block_pairs(*[c[order] for c in columns], base):
                parts.append(p)
                held += len(p[0])
                if held > EVENTS:
                    yield from send(parts)
                    parts, held = [], 0
            if parts:
                yield from send(parts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in of_bucket(batches):
            if EVENT in kinds:
                a, b, c, left, need = summed([tuple(kinds[EVENT])])
                ok = c + left >= need
                a, b, need = a[ok], b[ok], need[ok]
                if len(a):
                    yield from by_bucket(id_bucket(b, buckets), [a, b, need, *of_ids(kinds[SKETCH], a)], HALF)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in of_bucket(batches):
            if HALF in kinds:
                a, b, need, na, bits = kinds[HALF]
                nb, other = of_ids(kinds[SKETCH], b)
                apart = np.bitwise_count(bits.view(np.uint64).reshape(-1, 8) ^ other.view(np.uint64).reshape(-1, 8)).sum(1, dtype=np.int64)
                ok = na + nb - apart >= 2 * need
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    bitmaps = sketched(sets, buckets)
    events = met(listed(sets, table, base, widest, buckets, limit)).mapInArrow(join, PACKED)
    half = met(events.unionByName(bitmaps)).mapInArrow(first, PACKED)
    return met(half.unionByName(bitmaps)).mapInArrow(second, "a bigint, b bigint")


# ---------------------------------------------------------------- overlaps and set relations


def within(x: np.ndarray, s: np.ndarray) -> int:
    """How many of x are in the sorted array s."""
    if not len(x) or not len(s):
        return 0
    return int((s[np.minimum(np.searchsorted(s, x), len(s) - 1)] == x).sum())


def facing(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with both sets' columns, as xa and xb for each column x of sets. Sets of no pair don't travel."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    some = sets.join(ids, "id", "left_semi")
    side = lambda k: some.select(*[F.col(c).alias(k if c == "id" else c + k) for c in some.columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def close_pairs(pairs: DataFrame, sets: DataFrame, close: float) -> DataFrame:
    """(a, b, n, dist, more, less): pairs of similarity of at least `close`, and in what b differs from a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, sa, sb in zip(*(c.to_numpy(zero_copy_only=False) for c in batch.columns), strict=True):
                less, more = np.setdiff1d(sa, sb, True), np.setdiff1d(sb, sa, True)
                c = len(sa) - len(less)
                total = len(sa) + len(more)
                if c >= close * total - 1e-9:
                    rows.append((a, b, len(sb), 1 - c / total, more, less))
            if rows:
                a, b, n, dist, more, less = zip(*rows, strict=True)
                many = lambda x: _lists(np.concatenate(x), np.array([len(v) for v in x]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(dist, pa.float64()), many(more), many(less)], names=["a", "b", "n", "dist", "more", "less"])

    return facing(pairs, sets).select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, n int, dist double, more array<bigint>, less array<bigint>")


def answers(pairs: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of leaders and their followers. parts: id, part, s, r, f (followers: id, n, more, less). The leaders'
    overlap is computed, all others are derived from it and the members in which followers differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []

            def put(p, q, c, n, m, out=out):
                if c >= threshold * (n + m - c) - 1e-9:
                    out.append((min(p, q), max(p, q), c / (n + m - c)))

            x, z, px, pz, rx, rz = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            sx, sz = (batch.column(i).to_numpy(zero_copy_only=False) for i in (6, 7))
            fx, fz = batch.column(8).to_pylist(), batch.column(9).to_pylist()
            none = np.zeros(0, np.int64)
            for k in range(len(x)):
                same, a, b = x[k] == z[k], sx[k], sz[k]
                if same and px[k] > pz[k]:
                    continue
                c, n, m = (len(a), len(a), len(a)) if same else (within(a, b), len(a), len(b))
                if c < (threshold - rx[k] - rz[k]) * (n + m - c) - 1e-9:
                    continue
                left = [(int(x[k]), n, none, none)] * int(px[k] == 0) + [(f["id"], f["n"], np.array(f["more"], np.int64), np.array(f["less"], np.int64)) for f in fx[k]]
                right = [(int(z[k]), m, none, none)] * int(pz[k] == 0) + [(f["id"], f["n"], np.array(f["more"], np.int64), np.array(f["less"], np.int64)) for f in fz[k]]
                for i, (y, ny, more, less) in enumerate(left):
                    cyz = c - within(less, b) + within(more, b)
                    if cyz < (threshold - rz[k]) * (ny + m - cyz) - 1e-9:
                        continue
                    whole = None
                    for w, nw, wmore, wless in right[i + 1 :] if same and px[k] == pz[k] else right:
                        if not len(wmore) and not len(wless):
                            put(y, w, cyz, ny, nw)
                            continue
                        if whole is None:
                            whole = a if not len(more) and not len(less) else np.sort(np.concatenate([np.setdiff1d(a, less, True), more]))
                        put(y, w, cyz - within(wless, whole) + within(wmore, whole), ny, nw)
            if out:
                a, b, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    return facing(pairs, parts).select("a", "b", "parta", "partb", "ra", "rb", "sa", "sb", "fa", "fb").mapInArrow(run, "a bigint, b bigint, similarity double")


def pairs_of(sets: DataFrame, threshold: float, close: float = CLOSE) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of sets at or above the threshold. sets: id, s, best written before."""
    counts = counters(sets)
    limit = max(LIST, 8 * int(counts.mean()))
    table = sets.sparkSession.sparkContext.broadcast(counts)
    plain = sets.withColumn("r", F.lit(0.0))
    near = written(close_pairs(written(candidates(plain, table, close, 0.0, limit), "near"), sets, close), "close")
    # Leaders: sets without a smaller close set. Others follow the least leader they are close to, or lead themselves.
    led = near.join(near.select(F.col("b").alias("a")).distinct(), "a", "left_anti").groupBy("b").agg(F.min("a").alias("leader"))
    led = written(near.join(led.withColumnRenamed("leader", "a"), ["a", "b"]), "followers")
    size = led.groupBy("a").agg(F.max("dist").alias("r"), F.count("*").alias("followers"))
    widest = size.agg(F.max("r")).first()[0] or 0.0
    f = led.join(size.select("a", "followers"), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("followers") / PART)).cast("int"))
    f = f.groupBy("a", "part").agg(F.collect_list(F.struct(F.col("b").alias("id"), "n", "more", "less")).alias("f"))  # about PART followers
    f = size.select(F.col("a").alias("id"), "r").join(f.withColumnRenamed("a", "id"), "id")
    first = size.select(F.col("a").alias("id"), F.lit(0).alias("part"), "r")  # the leader itself stands in part 0
    f = written(f.join(first, ["id", "part", "r"], "full"), "parts")
    leaders = sets.join(led.select(F.col("b").alias("id")), "id", "left_anti").join(f, "id", "left").fillna(0, ["part"]).fillna(0.0, ["r"])
    leaders = written(leaders.withColumn("f", F.coalesce("f", F.array().cast(f.schema["f"].dataType))), "leaders")
    # A pair of leaders is needed from threshold - r(x) - r(z); each prefix allows for the widest partner.
    cand = candidates(leaders.filter("part = 0").select("id", "s", "r"), table, threshold, widest, limit)
    own = size.select(F.col("a"), F.col("a").alias("b"))
    return answers(written(cand.unionByName(own), "candidates"), leaders, threshold)


def join(df: DataFrame, key: str = "context_id", text: str = "context", size: int = SIZE, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, close: float = CLOSE) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep), (links between class representatives: a, b, similarity), a < b."""
    members, sets = records(df, key, text, size, least_words)
    return members, written(pairs_of(written(sets, "distinct"), threshold, close), "links")


def classes(df: DataFrame, key: str = "context_id", text: str = "context", **how) -> DataFrame:
    """One row for each record: id, class_id (the least id of equal word sequence; null for records that are too short), and
    n_links, the number of other records it is similar to, copies included."""
    members, links = join(df, key, text, **how)
    sizes = members.groupBy("rep").agg(F.count("*").alias("size"))
    out = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    far = out.join(sizes.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("size").alias("far"))
    per = sizes.join(far, "rep", "left").select("rep", (F.coalesce("far", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    keys = df.select(F.col(key).cast("bigint").alias("id")).distinct()
    return keys.join(members.join(per, "rep"), "id", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def found(df: DataFrame, key: str = "context_id", text: str = "context") -> DataFrame:
    """context_id_a, context_id_b, a < b: all pairs of records, class members included. A class of many members is expanded in
    groups of about PART, so that no task holds it whole."""
    members, links = join(df, key, text)
    sizes = members.groupBy("rep").count().filter("count > 1").select("rep", F.ceil(F.col("count") / PART).cast("int").alias("groups"))
    grouped = members.join(sizes, "rep", "left").select("rep", "id", F.coalesce("groups", F.lit(1)).alias("groups")).withColumn("g", F.pmod(F.xxhash64("id"), "groups").cast("int"))
    m = lambda s: grouped.select(F.col("id").alias(f"i{s}"), F.col("rep").alias(s), F.col("g").alias(f"g{s}"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    across = links.select("a", "b").join(sizes.select(F.col("rep").alias("a"), F.col("groups").alias("na")), "a", "left").join(sizes.select(F.col("rep").alias("b"), F.col("groups").alias("nb")), "b", "left").fillna(1, ["na", "nb"])
    across = across.select("a", "b", every("na").alias("ga"), "nb").select("a", "b", "ga", every("nb").alias("gb")).join(m("a"), ["a", "ga"]).join(m("b"), ["b", "gb"])
    some = grouped.join(sizes.select("rep"), "rep", "left_semi")
    cells = sizes.select("rep", every("groups").alias("ga"), "groups").select("rep", "ga", F.explode(F.sequence(F.col("ga"), F.col("groups") - 1)).alias("gb"))
    same = cells.join(some.select("rep", F.col("g").alias("ga"), F.col("id").alias("ia")), ["rep", "ga"]).join(some.select("rep", F.col("g").alias("gb"), F.col("id").alias("ib")), ["rep", "gb"]).filter("ga < gb OR ia < ib")
    both = across.select("ia", "ib").unionByName(same.select("ia", "ib"))
    return both.select(F.least("ia", "ib").alias("context_id_a"), F.greatest("ia", "ib").alias("context_id_b"))
