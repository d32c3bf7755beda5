"""N-gram Jaccard join by grouped prefixes (operator 7).

Every document is its set of distinct word shingles (lower-cased A-Z). Shingles
are ordered rarest first by their corpus-wide document count. Two sets can only
reach the threshold if they share a shingle among their first
``n - ceil(t n) + 1``; a document whose prefix holds nothing that occurs
elsewhere is done at once. The rest collapse twice: equal sets become one
variant, variants with equal prefix and size one group. Groups meet on prefix
shingles under length and position filters, and group pairs expand to variants
that are verified on whole sets of 64-bit shingle hashes (built on XXH3 of the
words): two sets of a thousand shingles hold a false match with a chance of 1e-13.

Links are wanted as components, so pairs come in two rounds: first each group
or shingle meets its most central member (linear in its rows), then only
pairs still in different components, which loses no component and spares the
square of a large family of copies.

Cases: null, empty and word-less texts have 0 shingles and link with nothing;
texts with fewer words than a shingle are one shingle, their whole sequence;
repeated rows share their doc_id and so one component; a null doc_id is
returned with a null component; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import connected_components, cut
from .postings import NO_ID, keyed, list_of, shared_grams


def shingle_hashes(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all shingles in row order, repeats included."""
    w, _, counts = words.hashed(text, lower=True)
    row, pos = words.gram_rows(counts, n)
    first = np.cumsum(counts) - counts
    h = words.grams(w, n, 7)[first[row] + pos] if len(row) else np.zeros(0, np.uint64)
    for k in range(1, n):
        few = np.flatnonzero(counts == k)
        if len(few):
            own = np.zeros(len(few), np.uint64)
            with np.errstate(over="ignore"):
                for j, c in enumerate(words.constants(k, 7000 + k)):
                    own += w[first[few] + j] * c
                own = words.mix(own)
            row, h = np.concatenate([row, few]), np.concatenate([h, own])
    order = np.argsort(row, kind="stable")
    return h[order], row[order]


def ngram_jaccard_join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of Jaccard >= percent/100)."""

    def grams(part):
        h, row = shingle_hashes(part["text"], n)
        return h, row, np.zeros(len(h), np.int64), np.zeros(len(h), bool)

    def per_batch(ids, th, counts, stream, pos, df, keys):
        size = counts.astype(np.int64)
        shared = df[stream] > 1
        ends = np.cumsum(size)
        lone = size - np.diff(np.concatenate([[0], np.cumsum(shared)])[np.concatenate([[0], ends])])
        reach = size + (-percent * size // 100) + 1
        alive = (size > 0) & (lone < reach) & (ids != NO_ID)
        held: dict[bytes, int] = {}
        prefixes, sets = [None] * len(ids), [None] * len(ids)
        names, groups = [None] * len(ids), [None] * len(ids)
        for i in np.flatnonzero(alive):  # ids ascend: the first of equal sets has the smallest
            e = stream[ends[i] - size[i] : ends[i]]
            e = e[df[e] > 1]
            k = keys[e][np.lexsort((keys[e], df[e]))]
            p = k[: reach[i] - lone[i]]
            own = b"" if not lone[i] else int(ids[i]).to_bytes(8, "little", signed=True) + int(th[i]).to_bytes(8, "little", signed=True)
            names[i] = hashlib.blake2b(k.tobytes() + own, digest_size=16).digest()
            if names[i] not in held:
                held[names[i]] = i
                prefixes[i], sets[i] = p, np.sort(k)
                groups[i] = hashlib.blake2b(p.tobytes() + own + int(size[i]).to_bytes(8, "little"), digest_size=16).digest()
        lists = lambda x: pa.array(x, pa.list_(pa.int64()))
        return pa.table({
            "doc_id": pa.array(np.where(ids == NO_ID, 0, ids), pa.int64(), mask=ids == NO_ID), "n": pa.array(size, pa.int64()), "lone": pa.array(lone, pa.int64()),
            "name": pa.array(names, pa.binary()), "grp": pa.array(groups, pa.binary()), "prefix": lists(prefixes), "keys": lists(sets),
        })

    rows = cut(shared_grams(keyed(docs), grams, True, False, per_batch, "doc_id long, n long, lone long, name binary, grp binary, prefix array<long>, keys array<long>"))
    held = rows.where("keys IS NOT NULL")
    variants = cut(held.groupBy("name").agg(F.min_by(F.struct("doc_id", "n", "lone", "grp", "prefix", "keys"), "doc_id").alias("s")).select("name", F.col("s.doc_id").alias("vid"), "s.n", "s.lone", "s.grp", "s.prefix", "s.keys"))
    groups = variants.groupBy("grp").agg(F.min_by(F.struct("vid", "n", "lone", "prefix"), "vid").alias("s"), F.count("*").alias("size")).select("grp", F.col("s.vid").alias("gid"), "s.n", "s.lone", "s.prefix", "size")
    groups = cut(groups)
    member = cut(variants.select("vid", "grp").join(groups.select("grp", "gid", "size"), "grp").select("vid", "gid", "size"))
    post = cut(groups.select("gid", "n", "lone", F.posexplode("prefix").alias("at", "token")).select("token", "gid", "n", (F.col("lone") + F.col("at")).alias("pos")))

    def could(a: str, b: str):
        """Length and position filters; both hold at the first shingle that two linked sets share."""
        small, need = F.least(f"{a}n", f"{b}n"), F.col(f"{a}n") + F.col(f"{b}n")
        most = F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos"))
        return (100 * small >= percent * F.greatest(f"{a}n", f"{b}n")) & ((100 + percent) * most >= percent * need)

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda x: variants.select(F.col("vid").alias(x), F.col("n").alias(f"{x}_n"), F.col("keys").alias(f"{x}_keys"))
        both = F.size(F.array_intersect("a_keys", "b_keys"))
        return cut(pairs.join(side("a"), "a").join(side("b"), "b").where((100 + percent) * both >= percent * (F.col("a_n") + F.col("b_n"))).select("a", "b"))

    centre = post.groupBy("token").agg(F.min(F.struct("pos", "gid", "n")).alias("c"), F.count("*").alias("k")).where("k > 1")
    centre = centre.select("token", F.col("c.gid").alias("c_gid"), F.col("c.n").alias("c_n"), F.col("c.pos").alias("c_pos"))
    p = post.select("token", F.col("gid").alias("p_gid"), F.col("n").alias("p_n"), F.col("pos").alias("p_pos"))
    star = p.join(centre, "token").where(F.col("p_gid") != F.col("c_gid")).where(could("p_", "c_")).select(F.least("p_gid", "c_gid").alias("a"), F.greatest("p_gid", "c_gid").alias("b"))
    inner = member.where("vid <> gid").select(F.col("gid").alias("a"), F.col("vid").alias("b"))
    links = verified(star.union(inner).distinct())
    near = connected_components(links)

    placed = cut(member.join(near.withColumnRenamed("node", "vid"), "vid", "left").select("vid", "gid", "size", F.coalesce("component", "vid").alias("c")))
    range_of = placed.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    post2 = post.join(range_of, "gid")
    mixed = post2.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l < h").select("token")
    post2 = cut(post2.join(mixed, "token"))
    x = post2.select("token", *(F.col(c).alias(f"x_{c}") for c in ("gid", "n", "pos", "lo", "hi")))
    y = post2.select("token", *(F.col(c).alias(f"y_{c}") for c in ("gid", "n", "pos", "lo", "hi")))
    apart = F.least("x_lo", "y_lo") < F.greatest("x_hi", "y_hi")
    pairs = x.join(y, (x["token"] == y["token"]) & (F.col("x_gid") < F.col("y_gid")) & apart & could("x_", "y_")).select("x_gid", "y_gid").distinct()
    v = placed.select(F.col("gid").alias("x_gid"), F.col("vid").alias("a"), F.col("c").alias("a_c"))
    w = placed.select(F.col("gid").alias("y_gid"), F.col("vid").alias("b"), F.col("c").alias("b_c"))
    across = pairs.join(v, "x_gid").join(w, "y_gid").where("a_c <> b_c").select("a", "b")
    some = placed.where("size > 1")
    s, t = some.select("gid", F.col("vid").alias("a"), F.col("c").alias("a_c")), some.select("gid", F.col("vid").alias("b"), F.col("c").alias("b_c"))
    within = s.join(t, "gid").where("a < b AND a_c <> b_c").select("a", "b")
    more = verified(across.union(within).distinct())

    of = rows.where("name IS NOT NULL").select("doc_id", "name").join(variants.select("name", "vid"), "name").select(F.col("doc_id").alias("a"), F.col("vid").alias("b"))
    final = connected_components(links.union(more).union(of))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
