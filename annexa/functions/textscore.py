"""Scores of a text or token list against a reference: ROUGE, BLEU, aligned F1, greedy cosine.

Tokenising is built-in expressions; clipped counts, stems, alignments and
cosine matrices run on Arrow batches, since row-local hash maps and bit-vector
dynamic programming have no built-in form. BLEU is a sum of counts, so a corpus
score is an ordinary aggregate with map-side partial sums.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _c

#: Words that Porter's rules stem wrongly, with their stems.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Porter's second and third step, suffix and replacement, in order.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


_COUNTS = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("hits", "grams")] + [T.StructField(n, T.LongType()) for n in ("pred_len", "ref_len")])


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def _kinds(w: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return _kinds(w).count("vc")


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c"


def _short(w: str) -> bool:
    k = _kinds(w)
    return (k[-3:] == "cvc" and w[-1] not in "wxy") or (len(w) == 2 and k == "vc")


@lru_cache(maxsize=1 << 16)
def stem(w: str) -> str:
    """Porter's stem with the usual extensions (irregular words, -ied, -fulli, -logi)."""
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    # plurals
    if w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # past and progressive forms
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _kinds(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w):
                    w = w[:-1] if w[-1] not in "lsz" else w
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and len(w) > 2 and _kinds(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    w = _second(w)
    for end, new in STEP3:
        if w.endswith(end):
            w = w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
            break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            root = w[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root[-1:] in ("s", "t")):
                w = root
            break
    if w.endswith("e"):
        root = w[:-1]
        if _measure(root) > 1 or (_measure(root) == 1 and not _short(root)):
            w = root
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def _second(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _second(w[:-2])
    for end, new in STEP2:
        if w.endswith(end):
            return w[: -len(end)] + new if _measure(w[: -len(end)]) > 0 else w
    return w[:-1] if w.endswith("logi") and _measure(w[:-3]) > 0 else w


def lcs_length(a, b) -> int:
    """Longest common subsequence by bit vectors."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = s = (1 << len(a)) - 1
    for y in b:
        u = s & at.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def _f(hits: float, a: int, b: int) -> float:
    return 2.0 * hits / (a + b) if hits else 0.0


def _list(x) -> list:
    return [] if x is None else list(x)


@F.pandas_udf(_doubles("rouge1", "rouge_l"))
def _rouge(pred: pd.Series, ref: pd.Series, stems: pd.Series) -> pd.DataFrame:
    out = []
    for p, r, s in zip(pred, ref, stems, strict=True):
        p, r = ([stem(w) if s and len(w) > 3 else w for w in _list(x)] for x in (p, r))
        out.append((_f(sum((Counter(p) & Counter(r)).values()), len(p), len(r)), _f(lcs_length(p, r), len(p), len(r))))
    return pd.DataFrame(out, columns=["rouge1", "rouge_l"])


def words(c) -> Column:
    """Runs of a-z and digits, lower-cased; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def rouge(pred, ref, stemmed: bool = True) -> Column:
    """struct<rouge1, rouge_l>: F1 of clipped words and of the longest common subsequence; null texts are empty."""
    return _rouge(words(pred), words(ref), F.lit(stemmed))


def tokens_13a(c) -> Column:
    """Words and punctuation by the mteval-13a rules, case kept; null gives none."""
    t = F.rtrim(F.coalesce(_c(c), F.lit("")))
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pattern, new in ((r"([\{-~\[-` -&\(-\+:-@/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 ")):
        t = F.regexp_replace(t, pattern, new)
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


def _counts(p: list, r: list) -> tuple[list[int], list[int], int, int]:
    hits, grams = [], []
    for n in range(1, 5):
        gp, gr = (Counter(zip(*(x[i:] for i in range(n)), strict=False)) for x in (p, r))
        hits.append(sum((gp & gr).values()))
        grams.append(max(0, len(p) - n + 1))
    return hits, grams, len(p), len(r)


@F.pandas_udf(_COUNTS)
def _bleu_counts(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_counts(_list(p), _list(r)) for p, r in zip(pred, ref, strict=True)], columns=["hits", "grams", "pred_len", "ref_len"])


def bleu_of(p: list, r: list) -> float:
    """Sentence BLEU-4 (0 to 100) of two token lists, of the orders that ``p`` has."""
    hits, grams, n, m = _counts(p, r)
    if not hits[0]:
        return 0.0
    smooth, logs = 1.0, []
    for h, g in zip(hits, grams, strict=True):
        if g:
            smooth *= 1 if h else 2
            logs.append(math.log(100.0 * h / g if h else 100.0 / (smooth * g)))
    return math.exp(sum(logs) / len(logs) + min(0.0, 1 - m / n))


@F.pandas_udf(T.DoubleType())
def _bleu_of(pred: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([bleu_of(_list(p), _list(r)) for p, r in zip(pred, ref, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _similarity(pred: pd.Series, ref: pd.Series, pred_words: pd.Series, ref_words: pd.Series) -> pd.Series:
    out = []
    for p, r, a, b in zip(pred, ref, pred_words, ref_words, strict=True):
        a, b = _list(a), _list(b)
        out.append(0.5 * (bleu_of(_list(p), _list(r)) / 100.0 + _f(lcs_length(a, b), len(a), len(b))))
    return pd.Series(out, dtype="float64")


def bleu_counts(pred, ref) -> Column:
    """Clipped n-gram hits and n-grams for n of 1 to 4, and both lengths."""
    return _bleu_counts(tokens_13a(pred), tokens_13a(ref))


def bleu(hits: Column, grams: Column, pred_len: Column, ref_len: Column) -> Column:
    """BLEU-4 (0 to 100) from summed counts, with exponential smoothing; 0 without n-grams of every order."""
    at = F.sequence(F.lit(0), F.lit(3))
    start = F.struct(F.lit(1.0).alias("smooth"), F.lit(0.0).alias("log"))

    def step(s: Column, i: Column) -> Column:
        h, g = F.get(hits, i), F.get(grams, i)
        smooth = F.when(h == 0, s["smooth"] * 2).otherwise(s["smooth"])
        return F.struct(smooth.alias("smooth"), (s["log"] + F.log(F.when(h == 0, 100.0 / (smooth * g)).otherwise(100.0 * h / g))).alias("log"))

    short = F.when(pred_len < ref_len, F.exp(1 - ref_len / pred_len)).otherwise(1.0)
    return F.when((F.get(hits, F.lit(0)) > 0) & (F.array_min(grams) > 0), short * F.exp(F.aggregate(at, start, step, lambda s: s["log"] / 4))).otherwise(0.0)


def sentence_bleu(pred, ref) -> Column:
    """BLEU-4 (0 to 100) of a text, of the orders that it has; null texts are empty."""
    return _bleu_of(tokens_13a(pred), tokens_13a(ref))


def similarity(pred, ref) -> Column:
    """Half sentence BLEU (as a share) and half ROUGE-L on words as they stand, unstemmed; one call of Python."""
    return _similarity(tokens_13a(pred), tokens_13a(ref), words(pred), words(ref))


def corpus_bleu(counts: str) -> Column:
    """Aggregate over a column of ``bleu_counts``."""
    total = lambda name: F.array(*(F.sum(F.get(F.col(f"{counts}.{name}"), F.lit(i))) for i in range(4)))
    return bleu(total("hits"), total("grams"), F.sum(f"{counts}.pred_len"), F.sum(f"{counts}.ref_len"))


def edit_path(a: list, b: list) -> list[tuple[str, int, int]]:
    """(operation, place in a, place in b) turning a into b: equal, replace, delete, insert; deletions are preferred from the end."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    up, down, ups, downs = full, 0, [], []
    for y in b:  # vertical differences of the distance matrix, a row of bits a token of b
        eq = at.get(y, 0)
        d = ((((eq & up) + up) ^ up) | eq | down) & full
        hp, hn = (down | ~(d | up)) & full, d & up
        hp, hn = ((hp << 1) | 1) & full, (hn << 1) & full
        up, down = (hn | ~(d | hp)) & full, hp & d
        ups.append(up)
        downs.append(down)
    out, i, j = [], len(a), len(b)
    while i and j:
        if ups[j - 1] >> (i - 1) & 1:
            i -= 1
            out.append(("delete", i, j))
            continue
        j -= 1
        if j and downs[j - 1] >> (i - 1) & 1:
            out.append(("insert", i, j))
        else:
            i -= 1
            out.append(("equal" if a[i] == b[j] else "replace", i, j))
    out += [("delete", k, j) for k in range(i - 1, -1, -1)] + [("insert", i, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


@F.pandas_udf(T.DoubleType())
def _aligned(pred: pd.Series, ref: pd.Series, gaps: pd.Series) -> pd.Series:
    def one(p: list, r: list, gaps_match: bool) -> float:
        if not p and not r:
            return 1.0
        same = n = 0
        for op, i, j in edit_path(p, r):
            x = None if op == "delete" or i >= len(p) else p[i]
            y = None if j >= len(r) else r[j]
            n += 1
            same += x == y if x is not None and y is not None else gaps_match and x is None and y is None
        return same / n

    return pd.Series([one(_list(p), _list(r), bool(g)) for p, r, g in zip(pred, ref, gaps, strict=True)], dtype="float64")


def aligned_f1(pred, ref, compat: bool = False) -> Column:
    """Micro F1 of two token lists set side by side by their edit path; two empty lists give 1.

    A deleted token stands as a gap beside the next token of the reference;
    once the reference has ended, both sides are gaps, which count as equal
    only with ``compat``.
    """
    return _aligned(_c(pred), _c(ref), F.lit(compat))


@F.pandas_udf(_doubles("precision", "recall", "f1"))
def _greedy(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    def unit(x) -> np.ndarray:
        m = np.array([np.asarray(v, float) for v in _list(x)])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)

    out = []
    for p, r in zip(pred, ref, strict=True):
        if p is None or r is None or not len(p) or not len(r):
            out.append((0.0, 0.0, 0.0))
            continue
        best = unit(p) @ unit(r).T
        a, b = float(best.max(1).mean()), float(best.max(0).mean())
        out.append((a, b, 2 * a * b / (a + b) if a + b > 0 else 0.0))
    return pd.DataFrame(out, columns=["precision", "recall", "f1"])


def greedy_cosine(pred, ref) -> Column:
    """struct<precision, recall, f1>: each token vector against its nearest on the other side; a side without vectors gives 0."""
    return _greedy(_c(pred).cast("array<array<double>>"), _c(ref).cast("array<array<double>>"))
