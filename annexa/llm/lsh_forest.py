"""Approximate nearest neighbours with a hash-prefix forest (operator 1).

Each tree hashes a vector to a long bit string (signs of random projections)
and keeps its strings in a sorted array. A query descends every tree to its
longest prefix match, found by bisection; then all trees ascend in step, one
bit shorter at a time, until the ranges under the common prefix length hold
``candidates`` entries together. The candidates are scored by inner product in
double precision on the original vectors.

Inner products become angles by the usual lift: vectors get one more
coordinate that brings them all to the largest norm; queries get a zero.

Scale: the index is dealt by hash into shards of about ``shard_rows`` vectors,
each with a forest of its own, and the stated queries into blocks; a task holds
one shard and one block. Equal vectors are collapsed first (per batch, then
over all): one entry with its smallest k + 1 ids, which is all a top k can use,
so a vector that fills a third of the rows costs one entry. A query's answer is
merged from k rows a shard. Ascending can reach the root, so short indexes are
searched whole and no query lacks results.

Candidates are ``share`` of a shard, and ``least`` of them at any rate, so an
index of ``least`` entries or fewer is searched exactly. The default share is
large because the vectors at hand are isotropic in 64 dimensions: their 20
nearest have cosines about 0.45 and no prefix tells them from the rest (recall
at shares 0.1, 0.3, 0.6: see README). Clustered vectors do with a few percent.
With a constant share the work stays proportional to queries times rows; that
is the price of recall 0.9 on such data, not of the plan.

Cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows without vec_id; vectors of another length than the
query's are not compared; a vec_id counts once, of different vectors under one
vec_id the smallest (by components) stands; no vectors, no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS = 32


def usable(c: str):
    """The vector if it can take part, else null."""
    v = F.col(c).cast("array<float>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), v)


def collapsed(rows: DataFrame, keep: int) -> DataFrame:
    """vec (binary), dim and ids: the smallest ``keep`` ids of each distinct vector."""

    def local(batches):
        for rb in batches:
            ids, vec = rb.column("vec_id").to_pylist(), rb.column("embedding")
            flat, size = np.asarray(vec.flatten(), np.float32) + np.float32(0), np.diff(vec.offsets.to_numpy())
            ends = np.cumsum(size)
            held: dict[bytes, list] = {}
            for i, e, n in zip(ids, ends, size, strict=True):
                held.setdefault(flat[e - n : e].tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(set(x))[:keep] for x in held.values()], pa.list_(pa.int64()))], ["vec", "ids"])

    each = rows.mapInArrow(local, "vec binary, ids array<long>")
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    # salted first: a vector in every batch is gathered by several tasks, keep ids from each
    some = each.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(32))).groupBy("vec", "salt").agg(best.alias("ids"))
    return some.groupBy("vec").agg(best.alias("ids")).withColumn("dim", F.floor(F.octet_length("vec") / 4).cast("int"))


def _planes(dim: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng(20_240 + dim).standard_normal((dim, trees * bits)).astype(np.float32)


def hash_strings(x: np.ndarray, trees: int, bits: int = BITS) -> np.ndarray:
    """(rows, trees) unsigned strings, most significant bit first."""
    sign = (x.astype(np.float32) @ _planes(x.shape[1], trees, bits)) > 0
    return np.packbits(sign.reshape(len(x), trees, bits), axis=2).view(f">u{bits // 8}")[:, :, 0].astype(np.uint64)


def search_shard(x: np.ndarray, q: np.ndarray, k: int, trees: int, share: float, least: int = 0):
    """For each query (row index, score) of the best k candidates of the shard, and one more."""
    norm = np.linalg.norm(x.astype(np.float64), axis=1)
    lift = np.sqrt(np.maximum(norm.max() ** 2 - norm**2, 0))
    h = hash_strings(np.column_stack([x, lift]), trees)
    g = hash_strings(np.column_stack([q, np.zeros(len(q))]), trees)
    order = np.argsort(h, axis=0, kind="stable")
    sorted_ids = [np.ascontiguousarray(order[:, t]) for t in range(trees)]
    strings = [h[o, t] for t, o in enumerate(sorted_ids)]
    want = min(len(x), max(k + 1, least, int(np.ceil(share * len(x)))))
    # descend: for every prefix length the range of the sorted array under the query's prefix
    depth = min(BITS, int(np.ceil(np.log2(max(2, len(x))))) + 2)  # beyond it a range holds one string or equal ones
    lo = np.zeros((depth + 1, len(q), trees), np.int32)
    hi = np.full((depth + 1, len(q), trees), len(x), np.int32)
    for length in range(1, depth + 1):
        low = (g >> np.uint64(BITS - length)) << np.uint64(BITS - length)
        high = low + (np.uint64(1) << np.uint64(BITS - length))
        for t in range(trees):
            lo[length, :, t] = np.searchsorted(strings[t], low[:, t], "left")
            hi[length, :, t] = np.searchsorted(strings[t], high[:, t], "left")
    x64, total = x.astype(np.float64), (hi - lo).sum(2)
    out = []
    for i in range(len(q)):
        # ascend in step until the ranges hold enough different entries
        seen = np.zeros(len(x), bool)
        for length in range(depth, -1, -1):
            if length and total[length, i] < want:
                continue
            for t, (a, b) in enumerate(zip(lo[length, i].tolist(), hi[length, i].tolist(), strict=True)) if length else ((0, (0, len(x))),):
                seen[sorted_ids[t][a:b]] = True
            if np.count_nonzero(seen) >= want:
                break
        at = np.flatnonzero(seen)
        s = x64[at] @ q[i].astype(np.float64)
        if len(at) > k + 1:
            # a tie at the border stays in: ids decide it later
            border = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
            at = at[s >= border - 1e-9 * abs(border)]
        # those that may stand are summed component by component, in one order on every machine
        s = np.zeros(len(at))
        for j in range(x64.shape[1]):
            s += x64[at, j] * float(q[i, j])
        out.append((at, s))
    return out


def nearest(rows: DataFrame, k: int = 20, query_every: int = 20, trees: int = 64, share: float = 0.6, shard_rows: int = 6144, block_rows: int = 4096, least: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score for every vec_id divisible by ``query_every`` against all other rows."""
    fine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), usable("embedding").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    fine = cut(fine.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    index = cut(collapsed(fine, k + 1))
    n = index.count()
    shards = max(1, -(-n // shard_rows))
    queries = fine.where(F.col("vec_id") % query_every == 0).select("vec_id", "embedding")
    blocks = max(1, -(-queries.count() // block_rows))
    spots = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    i = index.select((F.pmod(F.xxhash64(F.lit(1), "vec"), F.lit(shards))).cast("int").alias("shard"), spots(blocks).alias("block"), "dim", "vec", "ids")
    q = queries.select(spots(shards).alias("shard"), F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(blocks)).cast("int").alias("block"), F.size("embedding").alias("dim"), "vec_id", "embedding")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        x = np.frombuffer(b"".join(left["vec"].to_pylist()), np.float32).reshape(left.num_rows, -1)
        ids = left["ids"].to_pylist()
        names = right["vec_id"].to_pylist()
        qv = np.array(right["embedding"].to_pylist(), np.float32)
        a, b, c = [], [], []
        for name, (at, s) in zip(names, search_shard(x, qv, k, trees, share, least), strict=True):
            hits = sorted((-v, i) for j, v in zip(at.tolist(), s.tolist(), strict=True) for i in ids[j] if i != name)[:k]
            a += [name] * len(hits)
            b += [i for _, i in hits]
            c += [-v for v, _ in hits]
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    found = i.groupBy("shard", "block", "dim").cogroup(q.groupBy("shard", "block", "dim")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
