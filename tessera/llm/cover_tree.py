"""Vectors of one label within a cosine of one another, by dual traversal of cover trees.

Equal vectors of a label are one node with a weight. A label of more than CHUNK nodes gets pivots, a sample of one in
CHUNK and of PIVOTS (or PIVOT_BYTES) in all at most: they are the upper part of a cover tree that is spread over
the cluster. Every node belongs to the cell of its nearest pivot, and a cell's covering radius is the greatest
distance from its pivot to a node of it. A node visits another cell only if its distance from that pivot is within the
threshold and the cell's radius together (the pivots' own tree is searched with the same bound); of two cells the wider one's
nodes visit the narrower. Residents and visitors of a cell are dealt into parts of about CHUNK, each part becomes a cover
tree once, and the trees of residents meet each other and those of the visitors.

A tree's levels are nested: a level's centres are centres of the next, and its radius is half the one
above; each node knows the greatest distance from its centre to a vector below it. A pair of nodes is
dropped when its centres are farther apart than the threshold and both covering radii together, and taken as a whole when
even both radii more leave it within the threshold; what is left at the bottom is confirmed by its cosine in double
precision. Unit vectors at a cosine c are sqrt(2 - 2c) apart, so the pairs are exact. Where vectors do not
cluster no bound can prune, and the work is that of all pairs of a label; ``report`` tells how
much was pruned.

A task returns one row for each vector: how many it is linked with there, and the least vector it is
tied to; pairs are not emitted, so a dense group costs rows in proportion to its size. Ties between
tasks are joined by the components operator.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose
label is null, links with nothing and is its own component; vectors of different length do not link;
repeated rows count as other vectors; an empty table gives an empty one; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop, ship
from tessera.llm.components import components

COSINE = 0.93
CHUNK = 1024
#: Pivots of all labels together, and their bytes: what the driver holds and broadcasts.
PIVOTS = 16_384
PIVOT_BYTES = 32 << 20
#: Of a distance: the root of a difference near zero is only this exact.
SLACK = 1e-6


def _away(inner: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * inner))


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


class Tree:
    """levels: for each level centres (rows of x), covering radii, each node's parent and each row's node."""

    def __init__(self, x: np.ndarray, least: float):
        n = len(x)
        self.x = x
        radius, centres, of = 2.0, np.zeros(1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        far = _away(x @ x[0])  # of each row from its node's centre
        self.levels = [(centres, np.array([far.max()]), np.zeros(1, dtype=np.int64), of)]
        while radius > least and len(centres) < n:
            radius /= 2
            new_c, new_r, new_p, new_of = [], [], [], np.empty(n, dtype=np.int64)
            order = np.argsort(of, kind="stable")
            for node, rest in enumerate(np.split(order, np.searchsorted(of[order], np.arange(1, len(centres))))):
                centre, d = int(centres[node]), far[rest]
                while True:
                    own = d <= radius
                    own[rest == centre] = True
                    new_of[rest[own]], far[rest[own]] = len(new_c), d[own]
                    new_c.append(centre)
                    new_r.append(d[own].max())
                    new_p.append(node)
                    rest = rest[~own]
                    if not len(rest):
                        break
                    centre = int(rest[0])
                    d = _away(x[rest] @ x[centre])
            centres, of = np.array(new_c), new_of
            self.levels.append((centres, np.array(new_r), np.array(new_p), of))


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, rows: int = 65_536) -> np.ndarray:
    out = np.empty(len(i))
    for k in range(0, len(i), rows):
        out[k : k + rows] = np.einsum("ij,ij->i", a[i[k : k + rows]], b[j[k : k + rows]])
    return out


class Part:
    """Some nodes of a label with their tree; it is built once and pickled from task to task."""

    def __init__(self, nid: np.ndarray, weight: np.ndarray, raw: np.ndarray, least: float):
        order = np.argsort(nid, kind="stable")
        self.nid, self.weight, self.raw = nid[order], weight[order], raw[order]
        self.tree = Tree(unit(self.raw), least)

    def __getstate__(self):
        return self.nid, self.weight, self.raw, self.tree.levels

    def __setstate__(self, state):
        self.nid, self.weight, self.raw, levels = state
        self.tree = Tree.__new__(Tree)
        self.tree.x, self.tree.levels = unit(self.raw), levels


def meet(a: Part, b: Part, cosine: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
    """Dual traversal. For the rows of a and of b how many vectors they are linked with (b may be a), edges that tie what is
    linked (pairs of places, those of b after those of a), and how many pairs of tree nodes, rows among them, were compared."""
    bound = math.sqrt(2 - 2 * cosine)
    one, two, same = a.tree, b.tree, a is b
    shift = 0 if same else len(a.nid)
    links = np.zeros(shift + len(b.nid), dtype=np.int64)
    edges: list[np.ndarray] = []
    alive, compared = np.ones((1, 1), dtype=bool), 0
    for k in range(max(len(one.levels), len(two.levels))):
        la, lb = one.levels[min(k, len(one.levels) - 1)], two.levels[min(k, len(two.levels) - 1)]
        if 0 < k < len(one.levels):
            alive = alive[la[2]]
        if 0 < k < len(two.levels):
            alive = alive[:, lb[2]]
        i, j = np.nonzero(alive)
        if not len(i):
            return links, _tied(edges), compared
        if len(i) * 8 > alive.size:
            away = _away(one.x[la[0]] @ two.x[lb[0]].T)[i, j]
        else:
            away = _away(_dots(one.x[la[0]], two.x[lb[0]], i, j))
        compared += len(i)
        reach = la[1][i] + lb[1][j]
        alive[i, j] = near = away <= bound + SLACK + reach
        whole = near & (away + reach <= bound - SLACK)
        if whole.any():
            i, j = i[whole], j[whole]
            alive[i, j] = False
            for of, levels, at, other, other_levels, weight, first in ((i, la, 0, j, lb, b.weight, True), (j, lb, shift, i, la, a.weight, False)):
                if same and not first:
                    break  # the pairs stand there in both orders
                mass = np.bincount(other_levels[3], weights=weight, minlength=len(other_levels[0]))
                gain = np.bincount(of, weights=mass[other], minlength=len(levels[0])).astype(np.int64)
                links[at : at + len(levels[3])] += gain[levels[3]]
            for of, levels, at in ((i, la, 0), (j, lb, shift)):
                taken = np.zeros(len(levels[0]), dtype=bool)
                taken[of] = True
                rows = np.nonzero(taken[levels[3]])[0]
                edges.append(np.stack([rows + at, levels[0][levels[3][rows]] + at]))
            edges.append(np.stack([la[0][i], lb[0][j] + shift]))
    la, lb = one.levels[-1], two.levels[-1]
    i, j = np.nonzero(alive)
    if len(i) * 8 > alive.size and len(la[0]) == len(one.x) and len(lb[0]) == len(two.x):
        near = (one.x[la[0]] @ two.x[lb[0]].T)[i, j] >= cosine - SLACK
        i, j = la[0][i[near]], lb[0][j[near]]
    else:
        i, j = np.nonzero(alive[la[3]][:, lb[3]])
    compared += len(i)
    size_a, size_b = (np.sqrt(np.einsum("ij,ij->i", p.raw, p.raw)) for p in (a, b))
    good = _dots(a.raw, b.raw, i, j) / (size_a[i] * size_b[j]) >= cosine
    i, j = i[good], j[good]
    np.add.at(links, i, b.weight[j])
    if not same:
        np.add.at(links, j + shift, a.weight[i])
    edges.append(np.stack([i, j + shift]))
    return links, _tied(edges), compared


def _tied(edges: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(edges, axis=1) if edges else np.empty((2, 0), dtype=np.int64)


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least place it is tied to by the pairs."""
    least = np.arange(n)
    while len(i):
        before = least.copy()
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        least = least[least]
        if (least == before).all():
            break
    return least


def links_of(a: Part, b: Part, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """nid, links and root (the least nid that the pair of parts ties it to) of the rows of both, and the pairs compared."""
    links, (i, j), compared = meet(a, b, cosine)
    if a is b:
        nid = a.nid
        links = links - a.weight  # each row met itself
    else:
        nid = np.concatenate([a.nid, b.nid])
    order = np.argsort(nid, kind="stable")
    place = np.empty(len(nid), dtype=np.int64)
    place[order] = np.arange(len(nid))
    root = nid[order][_least(len(nid), place[i], place[j])]
    return nid, links, root[place], compared


class Cells:
    """A label's pivots, their cells' covering radii and the tree above them."""

    def __init__(self, pivots: np.ndarray, radii: np.ndarray | None = None):
        self.x, self.radii = unit(pivots), radii
        self.tree = Tree(self.x, 0.25)
        if radii is not None:
            self.order = np.lexsort((np.arange(len(radii)), radii)).argsort()
            below = []  # covering radii of all nodes of the cells below, not of the pivots alone
            for centres, _, _, of in self.tree.levels:
                far = _away(np.einsum("ij,ij->i", self.x, self.x[centres[of]])) + radii
                reach = np.zeros(len(centres))
                np.maximum.at(reach, of, far)
                below.append(reach)
            self.below = below

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = x @ self.x.T
        cell = inner.argmax(axis=1)
        return cell, _away(inner[np.arange(len(x)), cell])

    def visited(self, x: np.ndarray, own: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) wherever a row may be linked with a resident of a cell that comes before its own."""
        alive = np.ones((len(x), 1), dtype=bool)
        for k, (centres, _, parent, _) in enumerate(self.tree.levels):
            if k:
                alive = alive[:, parent]
            alive = alive & (_away(x @ self.x[centres].T) <= bound + SLACK + self.below[k])
        i, j = np.nonzero(alive[:, self.tree.levels[-1][3]])
        inner = np.einsum("ij,ij->i", x[i], self.x[j])
        good = (_away(inner) <= bound + SLACK + self.radii[j]) & (self.order[j] < self.order[own[i]])
        return i[good], j[good]


def _matrix(column: pa.Array | pa.ChunkedArray, at: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of some rows, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, starts = np.asarray(column.values, dtype=np.float64), column.offsets.to_numpy()[at]
    return flat[starts[:, None].astype(np.int64) + np.arange(dim)]


def _by_label(batch: pa.RecordBatch, wanted) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
    """The places of a batch's rows for each label and length that is wanted."""
    keys: dict = {}
    for i, k in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
        if k in wanted:
            keys.setdefault(k, []).append(i)
    for k, at in keys.items():
        yield k, np.array(at)


def _pivots(nodes: DataFrame, chunk: int) -> dict[tuple[str, int], np.ndarray]:
    """By label and length, for those of more than chunk nodes: one node in chunk, fewer if PIVOTS or PIVOT_BYTES would be passed."""
    per = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).filter(F.col("n") > chunk)
    chunks, widest = per.agg(F.sum(F.ceil(F.col("n") / chunk)), F.max("dim")).first()
    if not chunks:
        return {}
    share = min(1.0, min(PIVOTS, PIVOT_BYTES / (8 * widest)) / chunks)
    per = per.withColumn("k", F.floor(F.ceil(F.col("n") / chunk) * share)).filter("k > 1")
    some = nodes.join(per, ["label", "dim"]).withColumn("h", F.xxhash64("nid", F.lit(1)))
    some = some.filter(F.pmod("h", F.lit(1 << 40)) < F.least(F.lit(1.0), 2 * F.col("k") / F.col("n")) * (1 << 40))
    order = Window.partitionBy("label", "dim").orderBy("h")
    out: dict[tuple[str, int], list] = {}
    for r in some.withColumn("at", F.row_number().over(order)).filter("at <= k").select("label", "dim", "v").collect():
        out.setdefault((r["label"], r["dim"]), []).append(r["v"])
    return {k: np.array(v) for k, v in out.items()}


def _dealt(nodes: DataFrame, chunk: int, bound: float) -> tuple[DataFrame, list[DataFrame]]:
    """Residents and visitors of cells: label, dim, cell, visitor, part, others (parts of residents, parts of visitors),
    nid, weight, v; and the tables to drop after use."""
    spark = nodes.sparkSession
    tops = spark.sparkContext.broadcast({k: Cells(v) for k, v in _pivots(nodes, chunk).items()})

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cell, far = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for key, at in _by_label(batch, tops.value):
                cell[at], far[at] = tops.value[key].nearest(unit(_matrix(batch.column("v"), at, key[1])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    ddl = "label string, dim int, nid long, weight long, v array<double>"
    columns = [c.split()[0] for c in ddl.split(", ")]
    housed = cut(nodes.select(*columns).mapInArrow(own, ddl + ", cell int, far double"), "cells")
    sizes = housed.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("r"))
    radii: dict = {}
    if tops.value:
        of = spark.createDataFrame(list(tops.value), "label string, dim int")
        for r in sizes.join(F.broadcast(of), ["label", "dim"]).collect():
            radii.setdefault((r["label"], r["dim"]), {})[r["cell"]] = r["r"]
    whole = spark.sparkContext.broadcast({k: Cells(c.x, np.array([radii[k].get(i, 0.0) for i in range(len(c.x))])) for k, c in tops.value.items()})

    def away(it: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cells, places = batch.column("cell").to_numpy(), []
            to: list[np.ndarray] = []
            for key, at in _by_label(batch, whole.value):
                for a in range(0, len(at), 256):
                    some = at[a : a + 256]
                    i, j = whole.value[key].visited(unit(_matrix(batch.column("v"), some, key[1])), cells[some], bound)
                    places.append(some[i])
                    to.append(j)
            if not places:
                continue
            places, to = np.concatenate(places), np.concatenate(to).astype(np.int32)
            names = columns if full else columns[:2]
            for a in range(0, len(places), 1000):
                rows = pa.array(places[a : a + 1000])
                yield pa.RecordBatch.from_arrays([*(batch.column(n).take(rows) for n in names), pa.array(to[a : a + 1000])], names=[*names, "cell"])

    visitors = sizes.limit(0).select("label", "dim", "cell", F.lit(0).cast("long").alias("guests"))
    if tops.value:
        counted = housed.mapInArrow(lambda it: away(it, False), "label string, dim int, cell int")
        visitors = counted.groupBy("label", "dim", "cell").agg(F.count("*").alias("guests"))
    homes = cut(sizes.join(visitors, ["label", "dim", "cell"], "left").select("label", "dim", "cell", F.expr(f"CAST(ceil(n / {chunk}) AS INT)").alias("homes"), F.expr(f"CAST(ceil(coalesce(guests, 0) / {chunk}) AS INT)").alias("guests")), "homes")
    both = housed.drop("far").withColumn("visitor", F.lit(False))
    if tops.value:
        both = both.unionByName(housed.mapInArrow(lambda it: away(it, True), ddl + ", cell int").withColumn("visitor", F.lit(True)))
    both = both.join(homes, ["label", "dim", "cell"])
    parts = F.when(F.col("visitor"), F.col("guests")).otherwise(F.col("homes"))
    return both.withColumn("part", F.pmod(F.xxhash64("nid", F.lit(2)), parts).cast("int")), [housed, homes]


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, chunk: int = CHUNK, report: dict | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row. report is filled with the number of distinct vectors, of pairs
    of them within labels (both orders), of pairs that met in a task, and of pairs of tree nodes or rows that were compared."""
    ship(df.sparkSession)
    bound = math.sqrt(2 - 2 * cosine)
    good = "v IS NOT NULL AND label IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < DOUBLE('Infinity')) AND exists(v, x -> x <> 0)"
    rows = df.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    rows = rows.withColumn("good", F.coalesce(F.expr(good), F.lit(False)))
    nodes = rows.filter("good").groupBy("label", "v").agg(F.min("id").alias("head"), F.count("*").alias("weight"))
    nodes = cut(nodes.withColumn("nid", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "nodes")
    dealt, held = _dealt(nodes, chunk, bound)

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        nid, weight = (table.column(c).to_numpy() for c in ("nid", "weight"))
        part = pickle.dumps(Part(nid, weight, _matrix(table.column("v"), np.arange(len(nid)), key[1].as_py()), bound / 4), protocol=5)
        return pa.table({"label": [key[0].as_py()], "dim": [key[1].as_py()], "cell": [key[2].as_py()], "visitor": [key[3].as_py()], "part": [key[4].as_py()], "homes": table.column("homes")[:1], "guests": table.column("guests")[:1], "tree": pa.array([part], pa.binary())}, schema=trees_schema)

    trees_schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()), ("visitor", pa.bool_()), ("part", pa.int32()), ("homes", pa.int32()), ("guests", pa.int32()), ("tree", pa.binary())])
    at = ["label", "dim", "cell", "visitor", "part"]
    trees = cut(dealt.repartition(*at).groupBy(*at).applyInArrow(build, "label string, dim int, cell int, visitor boolean, part int, homes int, guests int, tree binary"), "trees")
    drop(*held)
    # residents meet residents (a <= b), and each part of residents each part of visitors (b counts on from the residents' parts)
    other = F.explode(F.when(F.col("visitor"), F.sequence(F.lit(0), F.col("homes") - 1)).otherwise(F.sequence(F.lit(0), F.col("homes") + F.col("guests") - 1))).alias("o")
    pairs = trees.select("label", "dim", "cell", (F.col("part") + F.when(F.col("visitor"), F.col("homes")).otherwise(0)).alias("c"), "tree", other)
    pairs = pairs.select("label", "dim", "cell", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "c", "tree")

    def run(table: pa.Table) -> pa.Table:
        held = dict(zip(table.column("c").to_pylist(), table.column("tree"), strict=True))
        parts = [pickle.loads(held[c].as_py()) for c in sorted(held)]
        nid, links, root, compared = links_of(parts[0], parts[-1], cosine)
        some = (links > 0) | (root != nid)
        n, m = len(parts[0].nid), len(parts[-1].nid)
        return pa.table(
            {"nid": [None, *nid[some].tolist()], "links": [compared, *links[some].tolist()], "root": [n * n if len(parts) == 1 else n * m, *root[some].tolist()]},
            schema=pa.schema([("nid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]),
        )

    meetings = ["label", "dim", "cell", "a", "b"]
    made = cut(pairs.repartition(*meetings).groupBy(*meetings).applyInArrow(run, "nid long, links long, root long"), "found")
    if report is not None:
        per = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        met = made.filter("nid IS NULL").agg(F.sum("links"), F.sum("root")).first()
        report.update(vectors=per[0] or 0, pairs=per[1] or 0, met=met[1] or 0, compared=met[0] or 0)
    found = made.filter("nid IS NOT NULL")
    roots = components(found.select(F.col("nid").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("nid").agg(F.sum("links").alias("links"))
    least = cut(roots.join(nodes.select(F.col("nid").alias("node"), "head"), "node").groupBy("root").agg(F.min("head").alias("component")), "least")
    of = roots.join(least, "root").select(F.col("node").alias("nid"), "component")
    whole = nodes.join(links, "nid", "left").join(of, "nid", "left")
    whole = cut(whole.select(F.col("label").alias("_label"), F.col("v").alias("_v"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "head").alias("component_id")), "whole")
    drop(trees, made, roots, least, nodes)
    out = rows.withColumn("_key", F.when(F.col("good"), F.col("label"))).join(whole, (F.col("_key") == F.col("_label")) & (F.col("v") == F.col("_v")), "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
