"""Substring dedup by fixed-block anchors (operator 2).

A repeated window of ``window`` words holds, in either occurrence, a whole
reference block: block k of a text is words ``k*b .. k*b + b - 1`` with
``b = window // 2``. So

1. every text's non-overlapping blocks are the index and every rolling window
   of b words probes it (one packed shuffle, see ``postings``);
2. hits extend to maximal exact repeats: all windows of ``window`` words that
   lie over a hit are compared by two independent 64-bit hashes of their words,
   and each sequence keeps its first occurrence (smallest doc_id, then start),
   whatever the number of copies, so nothing is quadratic in a passage's
   popularity; windows that repeat side by side make up the maximal repeat;
3. the words under windows that are not first are removed from the text.

Windows are judged on the input. Cases: null or empty texts have no words;
texts under ``window`` words stay whole; equal rows (same doc_id and text) are
one occurrence and get equal results; a null doc_id sorts before all others;
texts and words may be of any length, as words count by their hashes; other columns are ignored (clashing names included).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import cut
from .postings import NO_ID, PACKED, batch_number, batches, bucket_bits, by_bucket, distinct, document_row, keyed, list_of, mix_int, pack_steps, read_document_row, real_id, shared_grams, squeeze, table, unpack_steps, unsqueeze

_SPOTS = "doc_id long, th long, spots array<int>"


def _spots(ids: np.ndarray, th: np.ndarray, counts: np.ndarray, values: np.ndarray) -> pa.Table:
    some = counts > 0
    return pa.table({"doc_id": pa.array(ids[some], pa.int64()), "th": pa.array(th[some], pa.int64()), "spots": list_of(values.astype(np.int32), counts[some], pa.int32())})


def _per_row(counts: np.ndarray, flag: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flag)])[np.concatenate([[0], np.cumsum(counts)])])


def anchor_hits(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, th and the positions of rolling windows that occur elsewhere and match a reference block."""
    b = window // 2

    def grams(part):
        w, _, counts = words.hashed(part["text"])
        row, pos = words.gram_rows(np.where(counts >= window, counts, 0), b)
        first = np.cumsum(counts) - counts
        h = words.grams(w, b, 11)[first[row] + pos] if len(row) else np.zeros(0, np.uint64)
        return h, row, pos, pos % b == 0

    def per_batch(ids, th, counts, stream, pos, df, keys):
        hit = df[stream] > 1
        return _spots(ids, th, _per_row(counts, hit), pos[hit])

    return shared_grams(docs, grams, False, True, per_batch, _SPOTS, once=True, exact=False)


def later_windows(docs: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """doc_id, th and the starts of windows whose words also start earlier."""
    bits, b = bucket_bits(docs), window // 2
    over = docs.join(hits.dropDuplicates(["doc_id", "th"]), ["doc_id", "th"]).select("doc_id", "th", "text", "spots")

    def send(rows):
        for k, part in enumerate(batches(rows, once=True)):
            w, w2, n_words = words.hashed(part["text"])
            ids = part["doc_id"].to_numpy()
            spots = part["spots"].combine_chunks() if isinstance(part["spots"], pa.ChunkedArray) else part["spots"]
            spots = spots.chunk(0) if isinstance(spots, pa.ChunkedArray) else spots
            per = np.diff(spots.offsets.to_numpy().astype(np.int64))
            spot = spots.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(per)), per)
            first = np.cumsum(n_words) - n_words
            cover = np.zeros(len(w) + 1, np.int64)
            np.add.at(cover, first[row] + np.maximum(spot - (window - b), 0), 1)
            np.add.at(cover, first[row] + spot + 1, -1)
            here = np.cumsum(cover[:-1]) > 0
            g_row, g_pos = words.gram_rows(n_words, window)
            at = first[g_row] + g_pos
            use = here[at] if len(at) else np.zeros(0, bool)
            g_row, g_pos, at = g_row[use], g_pos[use], at[use]
            h = words.grams(w, window, 23)[at] if len(at) else np.zeros(0, np.uint64)
            h2 = words.grams(w2, window, 29)[at] if len(at) else h
            kept, stream, new = distinct(h, g_row, False)
            batch = batch_number(k)
            counts = np.bincount(g_row, minlength=part.num_rows)
            out = [document_row(batch, mix_int(batch) % (1 << bits), ids, part["th"].to_numpy(), counts, stream, g_pos)]
            if len(new):
                for x, u in by_bucket(h[new], bits):
                    e = new[u]
                    place = squeeze(np.concatenate([np.diff(ids[g_row[e]], prepend=0), g_pos[e]]))
                    out.append((x, batch, 0, h[e].tobytes() + h2[e].tobytes(), pack_steps(u), place))
            yield from table(out).to_batches()

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        out, own = [], []
        for i, kind in enumerate(t["kind"].to_pylist()):
            if kind == 1:
                out.append(tuple(t[c][i].as_py() for c in ("key", "batch", "kind", "a", "b", "c")))
            else:
                own.append(i)
        if own:
            both = [np.frombuffer(t["a"][i].as_py(), np.uint64) for i in own]
            size = [len(x) // 2 for x in both]
            h, h2 = np.concatenate([x[: len(x) // 2] for x in both]), np.concatenate([x[len(x) // 2 :] for x in both])
            place = [unsqueeze(t["c"][i].as_py(), np.int64) for i in own]
            ids, pos = np.concatenate([np.cumsum(x[: len(x) // 2]) for x in place]), np.concatenate([x[len(x) // 2 :] for x in place])
            order = np.lexsort((pos, ids, h2, h))
            a = order[:-1], order[1:]
            same = np.concatenate([[False], (h[a[0]] == h[a[1]]) & (h2[a[0]] == h2[a[1]])])
            group = np.cumsum(~same) - 1
            lead = order[~same][group]
            tie = (ids[order] == ids[lead]) & (pos[order] == pos[lead])
            late = np.zeros(len(order), bool)
            late[order] = ~tie
            at = 0
            for i, s in zip(own, size, strict=True):
                hit = np.flatnonzero(late[at : at + s])
                if len(hit):
                    out.append((0, t["batch"][i].as_py(), 0, pack_steps(unpack_steps(t["b"][i].as_py())[hit]), b"", b""))
                at += s
        return table(out)

    def back(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        kinds = t["kind"].to_pylist()
        i = kinds.index(1)
        ids, th, counts, stream, fresh, pos = read_document_row(*(t[c][i].as_py() for c in "abc"))
        late = np.zeros(int(stream.max()) + 1 if len(stream) else 0, bool)
        for i, kind in enumerate(kinds):
            if kind == 0:
                late[unpack_steps(t["a"][i].as_py())] = True
        gone = late[stream] | ~fresh
        return _spots(ids, th, _per_row(counts, gone), pos[gone])

    return over.mapInArrow(send, PACKED).groupBy("key").applyInArrow(meet, PACKED).groupBy("batch").applyInArrow(back, _SPOTS)


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """Every row's doc_id, th (text hash), kept_text, n_words, n_removed and kept_sha256."""
    if window < 2:
        raise ValueError("window must be 2 words at least")
    own = keyed(docs)
    hits = cut(anchor_hits(own, window))
    late = cut(later_windows(own, hits, window)).dropDuplicates(["doc_id", "th"])
    whole = own.join(late, ["doc_id", "th"], "left").select("doc_id", "th", "text", "spots")

    def keep(rows):
        for part in batches(rows, by_id=False):
            texts, spots = part["text"].to_pylist(), part["spots"].to_pylist()
            kept, n, gone, sha = [], [], [], []
            for text, at in zip(texts, spots, strict=True):
                w = (text or "").encode().split()
                n.append(len(w))
                if at:
                    cover = np.zeros(len(w) + 1, np.int64)
                    np.add.at(cover, np.array(at), 1)
                    np.add.at(cover, np.array(at) + window, -1)
                    stay = np.flatnonzero(np.cumsum(cover[:-1]) <= 0)
                    gone.append(len(w) - len(stay))
                    w = [w[i] for i in stay]
                else:
                    gone.append(0)
                line = b" ".join(w)
                kept.append(line.decode())
                sha.append(hashlib.sha256(line).hexdigest())
            yield from pa.table({"doc_id": part["doc_id"], "th": part["th"], "kept_text": pa.array(kept, pa.string()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}).to_batches()

    done = whole.mapInArrow(keep, "doc_id long, th long, kept_text string, n_words long, n_removed long, kept_sha256 string")
    return done.select(real_id().alias("doc_id"), "th", "kept_text", "n_words", "n_removed", "kept_sha256")
