"""Best-fit packing of token sequences with large-item matching (operator 9).

Documents become token ids (plus an end id); longer ones are cut into pieces
of the capacity. Items of one length are interchangeable, so packing needs only
the histogram of lengths, which has at most ``capacity`` rows whatever the
corpus. On it, items above a third of the capacity are matched greedily, two a
bin at most (largest first, each with the largest partner that fits); smaller
ones then go, largest first, to the tightest gap that holds them, and open a
new bin where none does. The plan is a list of segments "the next m items of
length L lie in bins b, b+1, ... at offset o"; an item finds its place by its
rank among its length.

Ranks are counted per (length, salt); a length has a salt for every
``salt_rows`` of its pieces, so one that fills a third of the rows is spread
over as many tasks as its rows need.

Cases: null text is empty and so a piece of the end id alone; repeated rows
are packed once each; an empty table packs to nothing; other columns ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .postings import batches

#: Bytes of text tokenized at a time, and words whose ids a Python worker keeps for the next time.
BATCH_BYTES = 16 << 20
_KNOWN = 1_000_000
_loaded: dict = {}
_MARKS = ".,!?;:%$*&#|"
_LETTERS = "^[a-zÀ-ÖØ-öø-ÿ]+"


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + count[i]] for all i, one behind the other."""
    shift = start - (np.cumsum(count) - count)
    return flat[np.repeat(shift, count) + np.arange(int(count.sum()))]


def _byte_signs() -> dict[int, str]:
    """The printable stand-in of every byte, as byte-level models write it: itself, or the next free code point from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = {}, 256
    for b in range(256):
        out[b] = chr(b if b in own else free)
        free += b not in own
    return out


class WordIds:
    """Token ids of words, learnt as they come.

    No token crosses ASCII white space, so a text's ids are those of its words.
    ASCII case is folded by the tokenizer, and a run of marks behind a letter is
    a pre-token of its own; so a word's ids are those of its lower-case stem and
    its marks. Stems of Latin letters that no normaliser changes go straight to
    the model; all else passes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.signs = _byte_signs()
        self.reset()

    def reset(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids, self.start, self.count = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _through(self, words: list[str]) -> list[list[int]]:
        return [e.ids for lo in range(0, len(words), 5000) for e in self.tokenizer.encode_batch_fast(words[lo : lo + 5000], add_special_tokens=False)]

    def _stem(self, word: str) -> list[int]:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.signs)
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def learn(self, words: pa.Array) -> None:
        """Adds lower-case words, none of them known."""
        stem = pc.ascii_rtrim(words, _MARKS)
        plain = pc.match_substring_regex(stem, _LETTERS + "$")
        whole = pc.invert(plain)
        stems = pc.utf8_lower(stem.filter(plain)).dictionary_encode()
        tails = pc.replace_substring_regex(words.filter(plain), _LETTERS, "").dictionary_encode()
        parts = [self._stem(w) for w in stems.dictionary.to_pylist()] + self._through(tails.dictionary.to_pylist()) + self._through(words.filter(whole).to_pylist())
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        start = np.cumsum(count) - count
        flat = np.fromiter((i for p in parts for i in p), "<u4", int(count.sum()))
        # a plain word is two parts, its stem and its marks (maybe none); any other is one
        is_plain = plain.to_numpy(zero_copy_only=False)
        first = np.empty(len(words), np.int64)
        first[is_plain] = stems.indices.to_numpy()
        first[~is_plain] = len(stems.dictionary) + len(tails.dictionary) + np.arange(int((~is_plain).sum()))
        each = 1 + is_plain
        at = np.cumsum(each) - each
        part = np.empty(int(each.sum()), np.int64)
        part[at] = first
        part[at[is_plain] + 1] = len(stems.dictionary) + tails.indices.to_numpy()
        own = count[first]
        own[is_plain] += count[part[at[is_plain] + 1]]
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(own) - own])
        self.ids = np.concatenate([self.ids, gather(flat, start[part], count[part])])
        self.count = np.concatenate([self.count, own])
        self.words = pa.concat_arrays([self.words, words])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat = split.flatten()
        flat = flat if not isinstance(flat, pa.ChunkedArray) else flat.combine_chunks()
        coded = flat.dictionary_encode()
        words = coded.dictionary
        if len(self.words) > _KNOWN:
            self.reset()
        place = pc.index_in(words, value_set=self.words)
        if place.null_count:
            before = len(self.words)
            self.learn(words.filter(place.is_null()))
            place = pc.fill_null(place, -1).to_numpy().astype(np.int64)
            place[place < 0] = before + np.arange(len(self.words) - before)
        else:
            place = place.to_numpy()
        at = place[coded.indices.to_numpy()]
        count = self.count[at]
        # the empty strings that white space at an end of a text leaves are words of no ids
        before = np.concatenate([[0], np.cumsum(count)])
        return gather(self.ids, self.start[at], count), np.diff(before[split.offsets.to_numpy()])


def tokenized(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked, the ids."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]

    def pieces(rows):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path not in _loaded:
            _loaded[tokenizer_path] = WordIds(tokenizer_path)
        known = _loaded[tokenizer_path]
        for part in batches(rows, by_id=False, size_bytes=BATCH_BYTES):
            ids, n = known.of(part["text"].combine_chunks())
            # every document's ids and its end id, as one run
            ends = np.cumsum(n + 1)
            run = np.full(int(ends[-1]), end_id, "<u4")
            keep = np.ones(len(run), bool)
            keep[ends - 1] = False
            run[keep] = ids
            per = -(-(n + 1) // capacity)
            doc = np.repeat(np.arange(len(n)), per)
            piece = np.arange(len(doc)) - (np.cumsum(per) - per)[doc]
            lo = (ends - n - 1)[doc] + piece * capacity
            hi = np.minimum(lo + capacity, ends[doc])
            raw = memoryview(run).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            held = pa.ListArray.from_arrays(pa.array(np.append(lo, hi[-1:]), pa.int32()), pa.array(run, pa.int64())) if keep_ids else pa.nulls(len(doc), pa.list_(pa.int64()))
            cols = [part["doc_id"].take(pa.array(doc)).combine_chunks(), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(hi - lo, pa.int64()), pa.array(crc, pa.int64()), held]
            yield from pa.table(cols, names).to_batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<long>")


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (length, first rank, items, first bin, offset) and the number of bins."""
    left = {k: n for k, n in counts.items() if n}
    rank = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    third = capacity // 3
    large = sorted((k for k in left if k > third), reverse=True)
    for a in large:
        while left[a]:
            b = next((k for k in large if k <= capacity - a and left[k] and (k != a or left[k] > 1)), None)
            if b is None:
                n, used = left[a], a
                put(a, n, bins, 0)
            else:
                n, used = (left[a] // 2 if a == b else min(left[a], left[b])), a + b
                put(a, n, bins, 0)
                put(b, n, bins, a)
            gaps.setdefault(capacity - used, []).append((bins, n))
            bins += n
    import bisect

    open_gaps = sorted(g for g in gaps if g)
    for s in sorted((k for k in left if k <= third), reverse=True):
        while left[s]:
            i = bisect.bisect_left(open_gaps, s)
            if i == len(open_gaps):
                n, per = left[s], capacity // s
                full, rest = divmod(n, per)
                for k in range(per):
                    if full or k < rest:
                        # slot k of the full bins, and of the last one if it has so many
                        put(s, full + (k < rest), bins, k * s)
                for gap, first, m in ((capacity - per * s, bins, full), (capacity - rest * s, bins + full, 1 if rest else 0)):
                    if m and gap:
                        if gap not in gaps or not gaps[gap]:
                            bisect.insort(open_gaps, gap)
                        gaps.setdefault(gap, []).append((first, m))
                bins += full + bool(rest)
                continue
            g = open_gaps[i]
            first, m = gaps[g].pop()
            n = min(left[s], m)
            put(s, n, first, capacity - g)
            if m > n:
                gaps[g].append((first + n, m - n))
            if not gaps[g]:
                open_gaps.pop(i)
            if g - s:
                if not gaps.get(g - s):
                    bisect.insort(open_gaps, g - s)
                gaps.setdefault(g - s, []).append((first, n))
    return out, bins


def pack_best_fit(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False, salt_rows: int = 1 << 10) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked)."""
    items = cut(tokenized(docs, tokenizer_path, capacity, end_id, keep_ids).withColumn("row", F.monotonically_increasing_id()))
    # At most `capacity` rows come to the driver, however large the corpus.
    histogram = {int(r["length"]): int(r["n"]) for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = docs.sparkSession.createDataFrame([(k, -(-n // salt_rows)) for k, n in histogram.items()], "length long, salts long")
    items = items.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row"), "salts").cast("int")).drop("salts")
    counts = cut(items.groupBy("length", "salt").agg(F.count("*").alias("n")))
    segments, _ = plan_bins(histogram, capacity)
    plan = np.array(sorted(segments), np.int64).reshape(-1, 5)
    first = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "base")
    ranked = items.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1)
    ranked = ranked.join(first, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own")).drop("base", "own", "salt", "row")

    def place(rows):
        scale = np.int64(1) << 44
        keys = plan[:, 0] * scale + plan[:, 1]
        for rb in rows:
            t = pa.Table.from_batches([rb])
            length, r = t["length"].to_numpy(), t["rank"].to_numpy()
            i = np.searchsorted(keys, length * scale + r, "right") - 1
            at = plan[i] if len(i) else np.zeros((0, 5), np.int64)
            t = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(at[:, 3] + r - at[:, 1], pa.int64())).append_column("offset", pa.array(at[:, 4], pa.int64()))
            yield from t.select(names).to_batches()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<long>" if keep_ids else "")
    return ranked.mapInArrow(place, kinds)
