"""Corpus-wide statistics of n-gram hashes with one packed shuffle.

Texts are read in batches of a few MB. A batch sends each distinct hash once,
packed by hash bucket (the rest of the hash, 2-byte index step), so a gram that
fills a third of the corpus costs one entry per batch and no task sees more
than its bucket. The bucket answers with the hashes that matter, and the batch
(whose row-wise index stream went along, compressed) turns them back into
rows. Memory is bounded by the batch and the bucket; the number of buckets
grows with the bytes of text, one for every BUCKET_BYTES and without a limit.

Hashes have 64 bits whatever the number of buckets. Where a false hit would
only cost work, as what it finds is compared again, 32 bits beside the
bucket's are sent (``exact=False``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the packed rows.
NO_ID = -(1 << 63)
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
PACKED = "key long, batch long, kind int, a binary, b binary, c binary"
_PACKED = pa.schema([("key", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unsqueeze(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def pack_steps(idx: np.ndarray) -> bytes:
    """Ascending indexes as 2-byte steps, or 4-byte ones if a step needs them."""
    step = np.diff(idx, prepend=0)
    if len(step) and step.max() > 0xFFFF:
        return b"\4" + step.astype(np.uint32).tobytes()
    return b"\2" + step.astype(np.uint16).tobytes()


def unpack_steps(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, np.uint16 if x[0] == 2 else np.uint32, offset=1), dtype=np.int64)


def batches(rows, by_id: bool = True, once: bool = False, size_bytes: int = BATCH_BYTES):
    """Tables cut to about ``size_bytes`` of text (one row at least).

    by_id: in order of doc_id. once: rows equal in doc_id and text hash count once.
    """
    for rb in rows:
        t = pa.Table.from_batches([rb])
        if not t.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(t["text"]), 0).to_numpy()
        group = np.cumsum(size, dtype=np.int64) // size_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), t.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = t.slice(lo, hi - lo).combine_chunks()
            if by_id:
                ids = part["doc_id"].to_numpy()
                if (np.diff(ids) < 0).any():
                    part = part.take(np.argsort(ids, kind="stable"))
                    ids = part["doc_id"].to_numpy()
                if once and (np.diff(ids) == 0).any():
                    th = part["th"].to_numpy()
                    order = np.lexsort((th, ids))
                    new = np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(th[order]) != 0)])
                    part = part.take(np.sort(order[new]))
            yield part


def distinct(h: np.ndarray, row: np.ndarray, once_a_row: bool):
    """(entries kept, index stream, first entries): each hash is numbered by first appearance."""
    order = np.argsort(h, kind="stable")
    hs = h[order]
    new = np.ones(len(h), bool)
    new[1:] = hs[1:] != hs[:-1]
    if once_a_row:
        rs = row[order]
        keep = new.copy()
        keep[1:] |= rs[1:] != rs[:-1]
        order, new = order[keep], new[keep]
    group = np.cumsum(new) - 1
    first = order[new]
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    loc = np.full(len(h), -1, np.int64)
    loc[order] = rank[group]
    kept = np.flatnonzero(loc >= 0)
    return kept, loc[kept], np.sort(first)


def document_row(batch: int, key: int, ids: np.ndarray, hashes: np.ndarray, counts: np.ndarray, stream: np.ndarray, pos: np.ndarray) -> tuple:
    """The batch's rows and their entries: a new number is one bit, a known one its step from the known one before (1 throughout a copied passage)."""
    seen = np.maximum.accumulate(np.concatenate([[-1], stream]))
    fresh = stream > seen[:-1]
    head = np.array([len(stream), int((~fresh).sum())], np.int64).tobytes()
    body = head + np.packbits(fresh).tobytes() + np.diff(stream[~fresh], prepend=0).astype(np.int32).tobytes() + np.diff(pos, prepend=0).astype(np.int32).tobytes()
    return key, batch, 1, ids.tobytes() + hashes.tobytes(), counts.astype(np.int32).tobytes(), zstandard.ZstdCompressor(level=3).compress(body)


def read_document_row(a: bytes, b: bytes, c: bytes):
    """(ids, text hashes, entries of each row, index stream, which entries are the first, positions)."""
    both, counts = np.frombuffer(a, np.int64), np.frombuffer(b, np.int32)
    body = zstandard.ZstdDecompressor().decompress(c)
    n, old = np.frombuffer(body, np.int64, 2)
    at = 16 + (n + 7) // 8
    fresh = np.unpackbits(np.frombuffer(body, np.uint8, (n + 7) // 8, 16), count=n).astype(bool)
    stream = np.cumsum(fresh) - 1
    stream[~fresh] = np.cumsum(np.frombuffer(body, np.int32, old, at), dtype=np.int64)
    pos = np.cumsum(np.frombuffer(body, np.int32, n, at + 4 * old), dtype=np.int64)
    return both[: len(counts)], both[len(counts) :], counts, stream, fresh, pos


def table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED) if rows else _PACKED.empty_table()


def batch_number(k: int) -> int:
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 32) | k


def bucket_bits(docs: DataFrame) -> int:
    """log2 of the buckets: 256 at least, and one for every BUCKET_BYTES of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, (-(-size // BUCKET_BYTES) - 1).bit_length())


def by_bucket(h: np.ndarray, bits: int):
    """(bucket, indexes of h in it, ascending) of every bucket that holds some."""
    bucket = h >> np.uint64(64 - bits)
    order = np.argsort(bucket, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(h)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        yield int(bucket[order[lo]]), order[lo:hi]


def pack_rest(h: np.ndarray, exact: bool) -> bytes:
    """The low 56 bits of hashes (the bucket has the other 8), or their low 32."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 7 if exact else 4]).tobytes()


def unpack_rest(x: bytes, exact: bool) -> np.ndarray:
    width = 7 if exact else 4
    out = np.zeros((len(x) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(x, np.uint8).reshape(-1, width)
    return out.view("<u8")[:, 0]


def shared_grams(docs: DataFrame, grams, once_a_row: bool, need_mark: bool, per_batch, schema: str, once: bool = False, exact: bool = True) -> DataFrame:
    """Which gram hashes occur more than once, told to each row that has them.

    grams(table) -> (hash, row, position, mark) arrays, in row order.
    once_a_row: count rows with the hash, else occurrences. need_mark: a hash
    counts only if one of its occurrences is marked. per_batch(ids, hashes,
    counts, stream, positions, df, keys) -> pa.Table: df has each number's
    count (1 where not shared; with need_mark 2 where it is), keys its hash. once: see batches().
    """
    bits = bucket_bits(docs)

    def send(rows):
        for k, part in enumerate(batches(rows, once=once)):
            h, row, pos, mark = grams(part)
            kept, stream, first = distinct(h, row, once_a_row)
            ids = part["doc_id"].to_numpy()
            batch = batch_number(k)
            counts = np.bincount(row[kept], minlength=part.num_rows) if len(kept) else np.zeros(part.num_rows, int)
            out = [document_row(batch, int(mix_int(batch) % (1 << bits)), ids, part["th"].to_numpy(), counts, stream, pos[kept])]
            if len(first):
                hu = h[first]
                n = np.bincount(stream)
                m = np.bincount(stream, weights=mark[kept]) > 0 if need_mark else None
                for b, at in by_bucket(hu, bits):
                    many = np.flatnonzero(n[at] > 1)
                    extra = np.array([len(many)], np.uint32).tobytes() + many.astype(np.uint32).tobytes() + n[at[many]].astype(np.uint32).tobytes()
                    out.append((b, batch, 0, pack_rest(hu[at], exact), pack_steps(at), extra + (np.packbits(m[at]).tobytes() if need_mark else b"")))
            yield from table(out).to_batches()

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        out, own, kinds = [], [], t["kind"].to_pylist()
        for i, kind in enumerate(kinds):
            if kind == 1:
                out.append(tuple(t[c][i].as_py() for c in ("key", "batch", "kind", "a", "b", "c")))
            else:
                own.append(i)
        if own:
            rest = [unpack_rest(t["a"][i].as_py(), exact) for i in own]
            size = [len(x) for x in rest]
            n = np.ones(sum(size), np.int64)
            m = np.zeros(len(n), bool)
            at = 0
            for i, s in zip(own, size, strict=True):
                c = t["c"][i].as_py()
                k = int(np.frombuffer(c, np.uint32, 1)[0])
                n[at + np.frombuffer(c, np.uint32, k, 4)] = np.frombuffer(c, np.uint32, k, 4 + 4 * k)
                if need_mark:
                    m[at : at + s] = np.unpackbits(np.frombuffer(c, np.uint8, offset=4 + 8 * k), count=s)
                at += s
            rest = np.concatenate(rest)
            order = np.argsort(rest, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], rest[order][1:] != rest[order][:-1]]))
            total = np.add.reduceat(n[order], edge)
            good = total > 1
            if need_mark:
                good &= np.add.reduceat(m[order].astype(np.int64), edge) > 0
            run = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(rest))))
            df = np.zeros(len(rest), np.int64)
            df[order] = np.where(good, total, 0)[run]
            at, key = 0, t["key"][own[0]].as_py()
            for i, s in zip(own, size, strict=True):
                d = df[at : at + s]
                hit = np.flatnonzero(d)
                if len(hit):
                    idx = unpack_steps(t["b"][i].as_py())[hit]
                    out.append((key, t["batch"][i].as_py(), 0, pack_steps(idx), b"" if need_mark else squeeze(np.minimum(d[hit], 0xFFFFFFFF).astype(np.uint32)), b"" if need_mark else pack_rest(rest[at + hit], exact)))
                at += s
        return table(out)

    def back(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        kinds = t["kind"].to_pylist()
        i = kinds.index(1)
        ids, th, counts, stream, _, pos = read_document_row(*(t[c][i].as_py() for c in "abc"))
        size = int(stream.max()) + 1 if len(stream) else 0
        df, keys = np.ones(size, np.int64), np.zeros(size, np.int64)
        for i, kind in enumerate(kinds):
            if kind == 0:
                idx = unpack_steps(t["a"][i].as_py())
                df[idx] = 2 if need_mark else unsqueeze(t["b"][i].as_py(), np.uint32)
                if not need_mark:
                    top = np.uint64(t["key"][i].as_py() >> (bits - 8) << 56)
                    keys[idx] = (top + unpack_rest(t["c"][i].as_py(), exact)).view(np.int64)
        return per_batch(ids, th, counts, stream, pos, df, keys)

    return docs.mapInArrow(send, PACKED).groupBy("key").applyInArrow(meet, PACKED).groupBy("batch").applyInArrow(back, schema)


def mix_int(x: int) -> int:
    """A spread-out 31-bit number."""
    return ((x * 0x9E3779B97F4A7C15) & (1 << 64) - 1) >> 33


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (NO_ID for null), text and a hash that tells rows with one doc_id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("text").cast("string").alias("text"))


def real_id(c="doc_id"):
    """The doc_id that keyed() has read, null again where it was."""
    return F.when(F.col(c) != NO_ID, F.col(c))


def list_of(values: np.ndarray, counts: np.ndarray, kind=pa.int64()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))
