"""Embedding near-dedup by dual traversal of cover trees (operator 10).

Vectors of one label link when their cosine reaches the threshold. On unit
vectors that is a distance: ``d <= r`` with ``r = sqrt(2 - 2 cos)``. A cover
tree has nested levels whose radii halve: every node's children lie within its
radius, and each node knows the true radius of all below it. Two trees are
walked together: a node pair is dropped when the distance of its centres
exceeds both radii plus r, taken whole when the pair cannot exceed r, and
opened otherwise; single vectors in doubt are decided by their cosine in double
precision. So all threshold pairs are found, and a tight cluster costs its
nodes, not its pairs.

Scale: equal vectors are collapsed first. A label is cut by its coarsest level:
up to ``max_cells`` centres, every vector to its nearest; a cell with many
vectors is dealt into parts of ``part_rows``. A task walks the trees of two
parts. Cell pairs, and single vectors against cells, are pruned by the same
covering-radius bounds before they are sent. The bounds need distances that
differ: in a label whose vectors are all about as far from one another (isotropic
ones in many dimensions) no centre's ball excludes anything, and an exact join by
this method compares all pairs of the label, in blocks. A task returns link counts and a
spanning forest of its links, both linear in its vectors; components are then
found over the forests.

Cases: a label or vec_id that is null, and vectors that are null, empty, zero
or hold null or non-finite components link with nothing and are returned with
0 links (their vec_id as component, itself null if null); vectors of different
lengths are not compared; repeated rows of one vec_id count as one vector if
equal, and count as vectors if not; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut
from .lsh_forest import usable

_EPS = 1e-7


def _fresh(df: DataFrame) -> DataFrame:
    """The same rows under column ids of their own, for a cogroup with a relative."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


class Tree:
    """A cover tree over unit vectors: node i has centre[i], radius[i], children and a range of ``order``."""

    def __init__(self, x: np.ndarray):
        self.x, self.order, self.nodes = x, np.empty(len(x), np.int64), []
        self._at = 0
        self.root = self._grow(np.arange(len(x)), 0, 2.0) if len(x) else None
        self.centre = np.array([n[0] for n in self.nodes], np.int64)
        self.radius = np.array([n[1] for n in self.nodes])
        self.children = [np.array(n[2], np.int64) for n in self.nodes]
        self.lo, self.hi = np.array([n[3] for n in self.nodes], np.int64), np.array([n[4] for n in self.nodes], np.int64)

    def _leaf(self, i: int) -> int:
        self.order[self._at] = i
        self._at += 1
        self.nodes.append((i, 0.0, [], self._at - 1, self._at))
        return len(self.nodes) - 1

    def _grow(self, members: np.ndarray, centre: int, radius: float) -> int:
        """The subtree of members, all within ``radius`` of the centre (itself a member)."""
        stack_lo = self._at
        if len(members) == 1:
            return self._leaf(int(members[0]))
        d = self._distance(members, centre)
        far = float(d.max())
        if far <= 1e-9:
            kids = [self._leaf(int(i)) for i in members]
            self.nodes.append((centre, far, kids, stack_lo, self._at))
            return len(self.nodes) - 1
        half = radius / 2
        while half > far:  # levels on which nothing would happen
            half /= 2
        kids, rest, c = [], members, centre
        while len(rest):
            d = self._distance(rest, c)
            near = d <= half
            near[rest == c] = True
            kids.append(self._grow(rest[near], c, half))
            rest = rest[~near]
            c = int(rest[0]) if len(rest) else -1
        self.nodes.append((centre, far, kids, stack_lo, self._at))
        return len(self.nodes) - 1

    def _distance(self, members: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (self.x[members] @ self.x[centre]), 0))


def dual(a: Tree, b: Tree, r: float, threshold: float):
    """Yields (a range lo, hi, b range lo, hi) of node pairs taken whole, in positions of the trees' orders; a is b walks pairs once."""
    if a.root is None or b.root is None:
        return
    todo = [(a.root, b.root)]
    while todo:
        u, v = todo.pop()
        same = a is b and u == v
        us = a.children[u] if len(a.children[u]) and (same or a.radius[u] >= b.radius[v] or not len(b.children[v])) else np.array([u])
        vs = b.children[v] if same or (len(b.children[v]) and us[0] == u and len(us) == 1) else np.array([v])
        if same and not len(us):
            continue
        for k in range(0, len(us), 512):
            part = us[k : k + 512]
            cos = a.x[a.centre[part]] @ b.x[b.centre[vs]].T
            d = np.sqrt(np.maximum(2 - 2 * cos, 0))
            reach = a.radius[part][:, None] + b.radius[vs][None, :]
            leaf = reach <= 0
            open_ = np.where(leaf, cos >= threshold, d <= reach + r + _EPS)
            if same:
                open_ &= part[:, None] <= vs[None, :]
            whole = open_ & (leaf | (d + reach <= r - _EPS))
            for i, j in zip(*np.nonzero(open_), strict=True):
                p, q = int(part[i]), int(vs[j])
                if same and p == q:
                    if len(a.children[p]):
                        todo.append((p, p))
                elif whole[i, j]:
                    yield a.lo[p], a.hi[p], b.lo[q], b.hi[q]
                else:
                    todo.append((p, q))


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def links_between(ids: np.ndarray, x: np.ndarray, weight: np.ndarray, side: np.ndarray | None, threshold: float):
    """(links of each vector, forest edges) within one set (side None) or between the sets side 0 and 1."""
    r = float(np.sqrt(2 - 2 * threshold))
    groups = [np.arange(len(x))] if side is None else [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    trees = [Tree(x[g]) for g in groups]
    a, b = trees[0], trees[-1]
    at = [g[t.order] for g, t in zip(groups, trees, strict=True)]  # position in a tree's order -> row
    wa = np.concatenate([[0], np.cumsum(weight[at[0]])])
    wb = np.concatenate([[0], np.cumsum(weight[at[-1]])])
    more = [np.zeros(len(g) + 1, np.int64) for g in groups]
    union, edges = _Union(len(x)), []
    for al, ah, bl, bh in dual(a, b, r, threshold):
        more[0][al] += wb[bh] - wb[bl]
        more[0][ah] -= wb[bh] - wb[bl]
        more[-1][bl] += wa[ah] - wa[al]
        more[-1][bh] -= wa[ah] - wa[al]
        first = int(at[-1][bl])
        for i in at[0][al:ah]:
            if union.join(int(i), first):
                edges.append((ids[i], ids[first]))
        lead = int(at[0][al])
        for j in at[-1][bl + 1 : bh]:
            if union.join(lead, int(j)):
                edges.append((ids[lead], ids[j]))
    # a node whose vectors all lie within r of each other is met as its children's pairs
    links = np.zeros(len(x), np.int64)
    for g, m in zip(at, more, strict=True):
        links[g] += np.cumsum(m[:-1])
    return links, edges


def _unit(vec: pa.ChunkedArray, n: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vec.to_pylist()), np.float32).reshape(n, -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_dedup(rows: DataFrame, threshold: float = 0.98, max_cells: int = 1024, part_rows: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    r = float(np.sqrt(2 - 2 * threshold))
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), usable("embedding").alias("embedding"))
    fine = base.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")

    def pack(batches):
        for rb in batches:
            vec = rb.column("embedding")
            flat, size = np.asarray(vec.flatten(), np.float32) + np.float32(0), np.diff(vec.offsets.to_numpy())
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([rb.column("vec_id"), rb.column("label"), pa.array([flat[e - n : e].tobytes() for e, n in zip(ends, size, strict=True)], pa.binary())], ["vec_id", "label", "vec"])

    packed = cut(fine.mapInArrow(pack, "vec_id long, label string, vec binary"))
    one = packed.groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("weight"))
    one = cut(one.withColumn("dim", F.octet_length("vec").cast("int")))
    own = packed.select("vec_id", "label", "vec").join(one.where("weight > 1").select("label", "vec", "id"), ["label", "vec"]).where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b")).distinct()
    own = cut(own)

    # The coarsest level of each label: a bounded number of centres, and its vectors dealt in chunks.
    size = one.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sized = one.join(F.broadcast(size) if size.count() <= 100_000 else size, ["label", "dim"])
    cells = F.least(F.lit(max_cells), F.ceil(F.col("n") / part_rows))
    key = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 40))
    # about 4 candidates a cell, evenly by hash; one always stays, as the smallest id does
    centre = sized.where((key < F.lit(1 << 40) * F.least(F.lit(1.0), 4 * cells / F.col("n"))) | (F.col("n") <= 4))
    least = sized.groupBy("label", "dim").agg(F.min_by(F.struct("id", "vec", "n"), "id").alias("s")).select("label", "dim", F.col("s.id").alias("id"), F.col("s.vec").alias("vec"), F.col("s.n").alias("n"))
    centre = centre.select("label", "dim", "id", "vec", "n").unionByName(least).dropDuplicates(["label", "dim", "id"])
    salted = sized.withColumn("chunk", F.pmod(F.xxhash64(F.lit(4), "id"), F.ceil(F.col("n") / (2 * part_rows))).cast("int"))
    chunks = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / (2 * part_rows)).cast("int") - 1))
    centre = cut(centre.withColumn("chunk", chunks))
    cap, unit = max_cells, _unit

    def assign(c: pa.Table, v: pa.Table) -> pa.Table:
        out = {"label": [], "dim": [], "id": [], "weight": [], "vec": [], "cell": [], "away": [], "cvec": []}
        if v.num_rows:
            c = c.sort_by("id")
            n = int(c["n"][0].as_py())
            y = unit(c["vec"], c.num_rows)
            # greedy net among the candidates: the farthest next, as long as cells are wanted
            pick, d = [0], 2 - 2 * (y @ y[0])
            while len(pick) < min(cap, -(-n // part_rows)) and d.max() > 1e-9:
                pick.append(int(d.argmax()))
                d = np.minimum(d, 2 - 2 * (y @ y[pick[-1]]))
            x = unit(v["vec"], v.num_rows)
            far = np.sqrt(np.maximum(2 - 2 * (x @ y[pick].T), 0))
            cell = far.argmin(1)
            names = c["vec"].to_pylist()
            out = {"label": v["label"], "dim": v["dim"], "id": v["id"], "weight": v["weight"], "vec": v["vec"], "cell": pa.array(cell, pa.int32()), "away": pa.array(far[np.arange(len(x)), cell]), "cvec": pa.array([names[pick[k]] for k in cell], pa.binary())}
        kinds = {"label": pa.string(), "dim": pa.int32(), "id": pa.int64(), "weight": pa.int64(), "vec": pa.binary(), "cell": pa.int32(), "away": pa.float64(), "cvec": pa.binary()}
        return pa.table({k: pa.array(x, kinds[k]) if isinstance(x, list) else x for k, x in out.items()})

    schema = "label string, dim int, id long, weight long, vec binary, cell int, away double, cvec binary"
    placed = cut(_fresh(centre).groupBy("label", "dim", "chunk").cogroup(salted.groupBy("label", "dim", "chunk")).applyInArrow(assign, schema))
    cell = placed.groupBy("label", "dim", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("m"), F.first("cvec").alias("cvec"))
    # at most max_cells rows a label: the label's cells travel with its chunks
    of_label = cell.groupBy("label", "dim").agg(F.array_sort(F.collect_list(F.struct("cell", "radius", "m", "cvec"))).alias("cells"), F.sum("m").alias("n"))
    of_label = of_label.withColumn("chunk", chunks)
    placed = placed.join(of_label.select("label", "dim", "n").distinct(), ["label", "dim"]).withColumn("chunk", F.pmod(F.xxhash64(F.lit(4), "id"), F.ceil(F.col("n") / (2 * part_rows))).cast("int"))

    def deal(c: pa.Table, v: pa.Table) -> pa.Table:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        names = ["label", "dim", "first", "second", "side", "id", "weight", "vec"]
        if v.num_rows:
            cells = c["cells"][0].as_py()
            y = unit(pa.chunked_array([pa.array([k["cvec"] for k in cells], pa.binary())]), len(cells))
            x = unit(v["vec"], v.num_rows)
            far = np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))
            radius = np.array([k["radius"] for k in cells])
            parts = np.array([-(-k["m"] // part_rows) for k in cells])
            base = np.cumsum(parts) - parts
            spot = {k["cell"]: i for i, k in enumerate(cells)}
            home = np.array([spot[k] for k in v["cell"].to_pylist()])
            ids = v["id"].to_numpy()
            with np.errstate(over="ignore"):
                mine = base[home] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[home]
            away = v["away"].to_numpy()
            # y of cell g within r of x: d(x, g) <= radius(g) + r, and d(x, g) <= d(x, home) + 2 r as g is nearest to y
            meets = (far <= radius[None, :] + r + _EPS) & (far <= away[:, None] + 2 * r + _EPS)
            # both ends must send: a pair of cells needs either side's centres near enough
            meets[np.arange(len(x)), home] = True
            i, g = np.nonzero(meets)
            i, g, other = np.repeat(i, parts[g]), np.repeat(g, parts[g]), np.arange(int(parts[g].sum())) + np.repeat(base[g] - (np.cumsum(parts[g]) - parts[g]), parts[g])
            # all parts of a cell that a vector meets; the smaller of two part numbers comes first
            first, second = np.minimum(mine[i], other), np.maximum(mine[i], other)
            at = pa.array(i)
            own = {"label": v["label"].take(at), "dim": v["dim"].take(at), "first": first, "second": second, "side": (mine[i] > other).astype(np.int32), "id": ids[i], "weight": v["weight"].take(at), "vec": v["vec"].take(at)}
            return pa.table({n: x.cast(t) if isinstance(x, pa.ChunkedArray) else pa.array(x, t) for (n, x), t in zip(own.items(), kinds, strict=True)})
        return pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})

    tasks = _fresh(of_label).groupBy("label", "dim", "chunk").cogroup(placed.groupBy("label", "dim", "chunk")).applyInArrow(deal, "label string, dim int, first int, second int, side int, id long, weight long, vec binary")

    def walk(t: pa.Table) -> pa.Table:
        ids, side = t["id"].to_numpy(), t["side"].to_numpy()
        inside = t["first"][0].as_py() == t["second"][0].as_py()
        links, edges = (np.zeros(len(ids), np.int64), [])
        if inside or 0 < side.sum() < len(side):
            links, edges = links_between(ids, unit(t["vec"], len(ids)), t["weight"].to_numpy(), None if inside else side, threshold)
        some = np.flatnonzero(links)
        a, b = [int(e[0]) for e in edges], [int(e[1]) for e in edges]
        return pa.table({"a": pa.array([*ids[some].tolist(), *a], pa.int64()), "b": pa.array([None] * len(some) + b, pa.int64()), "n": pa.array([*links[some].tolist(), *[None] * len(a)], pa.int64())})

    found = cut(tasks.groupBy("label", "dim", "first", "second").applyInArrow(walk, "a long, b long, n long"))
    edges = found.where("b IS NOT NULL").select("a", "b")
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    degree = one.join(counts, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    degree = degree.groupBy("id").agg(F.max("n_links").alias("n_links"))
    of_copy = own.join(degree.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.max("n_links").alias("n_links"))
    degree = degree.unionByName(of_copy).groupBy("id").agg(F.max("n_links").alias("n_links"))
    comp = connected_components(edges.union(own))
    ids = base.select("vec_id").distinct()
    out = ids.join(degree.withColumnRenamed("id", "vec_id"), "vec_id", "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
