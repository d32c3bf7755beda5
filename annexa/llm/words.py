"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, i.e. the
pattern ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text. Everything here works on
whole texts in Arrow and numpy, without a Python step per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_R = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers from a seed, alike on every machine."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _R + np.uint64(seed)) | np.uint64(1)


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; nulls count as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = text.chunk(0) if text.num_chunks else pa.array([], pa.string())
    if text.null_count:
        text = text.fill_null("")
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    _, off, data = text.buffers()
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends (bytes) and the number of words of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] |= word[inner]
    starts = np.flatnonzero(begins)
    stops = word.copy()
    stops[:-1] &= ~word[1:] | begins[1:]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hashed(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first half, second half) of a 128-bit hash of every word's bytes in order, and the number of words of each row.

    The halves are XXH3's, which no known family of words brings together (sums
    of powers modulo 2^64 collide on long periodic words). A batch's words are
    told apart first, so each different one is hashed once.
    """
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
    text = pc.fill_null(text, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    coded = split.flatten().dictionary_encode()
    each = coded.dictionary.cast(pa.binary()).to_pylist()
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in each]), "<u8").reshape(-1, 2)
    at, offsets = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    if b"" in each:  # white space at an end of a text leaves an empty word
        real = at != each.index(b"")
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        at = at[real]
    return both[at, 0].astype(np.uint64), both[at, 1].astype(np.uint64), np.diff(offsets)


def grams(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of every n consecutive words; entry i is words[i : i + n]."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for k, c in enumerate(constants(n, seed)):
            out += words[k : k + m] * c
        return mix(out)


def gram_rows(n_words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the n-grams that stay within a row, in order."""
    per = np.maximum(n_words - n + 1, 0)
    row = np.repeat(np.arange(len(per)), per)
    first = np.cumsum(per) - per
    return row, np.arange(int(per.sum())) - first[row]
