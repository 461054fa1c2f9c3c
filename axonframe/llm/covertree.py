"""Exact cosine threshold links by dual traversal of cover trees.

The top level of a large group's tree is spread over tasks: centers drawn from the
group have a cell each, of the vectors nearest to them, with a covering radius. A
vector goes to another cell only if the radius and the bisecting plane let one of its
vectors be near enough; within a cell trees of all levels are traversed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, stored
from .components import connected_components

THRESHOLD = 0.93
#: Vectors that a cover tree holds. Groups with more get cells; of a crowded cell each pair of blocks is a task.
BLOCK = 4096
#: Cells of a group at most.
MOST_CELLS = 1024
#: A node of at most so many points has no children: its points are compared as they are.
LEAF = 48
#: Pairs of points that two nodes hold at most to be compared as they are: one product of matrices is quicker than going on.
DIRECT = 1 << 12
#: Distances are widened by this against rounding when node pairs are pruned.
SLACK = 1e-7


@dataclass
class Node:
    center: int
    points: np.ndarray
    #: Greatest distance from the center to a point of the node.
    radius: float
    children: list


class CoverTree:
    """Unit vectors in nested levels: the centers of a level cover the points of
    their parent within half its radius, are further apart than that, and a center
    stays a center in all levels below."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.root = self._node(0, np.arange(len(x)), self._distances(0, np.arange(len(x))))

    def _distances(self, center: int, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[points] @ self.x[center])))

    def _node(self, center: int, points: np.ndarray, distances: np.ndarray) -> Node:
        root = Node(center, points, float(distances.max()), [])
        todo = [(root, distances)]
        while todo:
            node, distances = todo.pop()
            if len(node.points) <= LEAF or node.radius < 1e-7:
                continue
            for c, members, far in self._cover(node, distances, node.radius / 2):
                child = Node(c, members, float(far.max()), [])
                node.children.append(child)
                todo.append((child, far))
        return root

    def _cover(self, node: Node, distances: np.ndarray, radius: float):
        """Centers in turn, each with the points within ``radius`` that no center before it has."""
        near = distances <= radius
        yield node.center, node.points[near], distances[near]
        left = node.points[~near]
        while len(left):
            # a batch of points not covered: the first is a center, and each later one if no center of the batch covers it
            batch = left[:64]
            gram = np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[batch] @ self.x[batch].T)))
            centers: list[int] = []
            for i in range(len(batch)):
                if not centers or gram[i, centers].min() > radius:
                    centers.append(i)
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[left] @ self.x[batch[centers]].T)))
            inside = d <= radius
            inside[np.array(centers), np.arange(len(centers))] = True
            first = np.where(inside.any(1), inside.argmax(1), -1)
            order = np.argsort(first, kind="stable")
            cuts = np.searchsorted(first[order], np.arange(len(centers) + 1))
            for k, i in enumerate(centers):
                at = order[cuts[k] : cuts[k + 1]]
                yield int(batch[i]), left[at], d[at, k]
            left = left[first < 0]


def linked(a: CoverTree, b: CoverTree, threshold: float):
    """Index pairs (of a, of b) with a dot product of at least ``threshold``, in blocks of bounded size.

    A pair of nodes goes on only if their centers are no further apart than the
    threshold's distance and both covering radii. A node without children meets the
    other's children. Small pairs of nodes meet in an exact comparison.
    """
    reach = float(np.sqrt(2 - 2 * threshold))

    def compare(left: np.ndarray, right: np.ndarray):
        step = max(1, (1 << 20) // max(1, len(right)))
        for at in range(0, len(left), step):
            i, j = np.nonzero(a.x[left[at : at + step]] @ b.x[right].T >= threshold)
            if len(i):
                yield left[at : at + step][i], right[j]

    todo = [(a.root, b.root)]
    while todo:
        p, q = todo.pop()
        if not p.children and not q.children or len(p.points) * len(q.points) <= DIRECT:
            yield from compare(p.points, q.points)
            continue
        ps, qs = p.children or [p], q.children or [q]
        cp, cq = np.array([n.center for n in ps]), np.array([n.center for n in qs])
        rp, rq = np.array([n.radius for n in ps]), np.array([n.radius for n in qs])
        sizes, leaf = np.array([len(n.points) for n in qs]), np.array([not n.children for n in qs])
        for i, node in enumerate(ps):
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (b.x[cq] @ a.x[cp[i]])))
            near = np.flatnonzero(d <= reach + rp[i] + rq + SLACK)
            # all that is small enough is compared at once, the rest goes on
            small = (sizes[near] * len(node.points) <= DIRECT) | (leaf[near] & (not node.children))
            if small.any():
                yield from compare(node.points, np.concatenate([qs[j].points for j in near[small]]))
            todo += [(node, qs[j]) for j in near[~small]]


def unit(vectors) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows or vanishes."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _task(threshold: float):
    """Links within a block, or between two blocks: per vector their number, weighted by copies, and an edge to the least vector of its task-wide component."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = unit(frame["embedding"])
        ids, copies, side = frame["node"].to_numpy(), frame["copies"].to_numpy(), frame["side"].to_numpy()
        two = frame["left"].iloc[0] != frame["right"].iloc[0]
        one = np.flatnonzero(side == 0)
        other = np.flatnonzero(side == 1) if two else one
        links, forest = np.zeros(len(x), dtype=np.int64), Forest(len(x))
        if len(one) and len(other):
            tree = CoverTree(x[one])
            for i, j in linked(tree, CoverTree(x[other]) if two else tree, threshold):
                i, j = one[i], other[j]
                differ = i != j
                i, j = i[differ], j[differ]
                np.add.at(links, i, copies[j])
                if two:
                    np.add.at(links, j, copies[i])
                forest.join(i, j)
        on = np.flatnonzero(links)
        return pd.DataFrame({"node": ids[on], "links": links[on], "root": ids[forest.all_roots()[on]]})

    return run


def _nearest(key, frame: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
    """The cell of each vector, that of the nearest center, and its distance."""
    centers = centers.sort_values("cell")
    d = unit(frame["embedding"]) @ unit(centers["center"]).T if len(frame) else np.zeros((0, 1))
    at = d.argmax(axis=1) if len(frame) else np.zeros(0, dtype=int)
    far = np.sqrt(np.maximum(0.0, 2 - 2 * d[np.arange(len(at)), at]))
    return frame[["label", "dims", "part", "node", "copies", "embedding"]].assign(cell=centers["cell"].to_numpy()[at], far=far)


def _guests(threshold: float):
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK

    def run(key, frame: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        """The later cells that hold vectors which each vector may link with: none if it is
        too far from their covering radius, or too much nearer to its own center than to theirs."""
        if not len(frame):
            return frame[["label", "dims", "node", "copies", "embedding", "cell"]].assign(guests=[])
        cells = cells.sort_values("cell")
        names, radius = cells["cell"].to_numpy(), cells["radius"].to_numpy()
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (unit(frame["embedding"]) @ unit(cells["center"]).T)))
        near = (d <= reach + radius) & (d - frame["far"].to_numpy()[:, None] <= 2 * reach) & (names > frame["cell"].to_numpy()[:, None])
        return frame[["label", "dims", "node", "copies", "embedding", "cell"]].assign(guests=[names[n] for n in near])

    return run


def spread(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, most_cells: int = MOST_CELLS) -> DataFrame:
    """Vectors (label, node, copies, embedding, code) once for each task that they have a part in.

    A task, named by label, dims, cell, left and right, compares the vectors of one
    block of a cell, or those of side 0 with those of side 1: blocks of a crowded
    cell with each other, or with blocks of guests from other cells.
    """
    classes = classes.withColumn("dims", F.size("embedding"))
    by = ["label", "dims"]
    counts = classes.groupBy(*by).agg(F.count("*").alias("n"), F.min("code").alias("first"))
    counts = stored(counts.withColumn("cells", F.least(F.lit(most_cells), F.ceil(4 * F.col("n") / block)).cast("int")), "groups")
    large = counts.where(F.col("n") > block)
    names = [*by, "node", "copies", "embedding", "cell"]
    own = classes.join(counts.where(F.col("n") <= block).select(*by), by).withColumn("cell", F.lit(-1).cast("long")).select(*names, F.array().cast("array<long>").alias("guests"))
    if large.head(1):
        of = classes.join(large, by)
        # about as many as wanted, chosen by hash, and one at least
        centers = of.where((F.pmod("code", F.lit(1 << 32)) < F.col("cells") / F.col("n") * float(1 << 32)) | (F.col("code") == F.col("first")))
        centers = stored(centers.select(*by, F.col("node").alias("cell"), F.col("embedding").alias("center")), "centers")
        parts = F.ceil(F.col("n") / block).cast("int")
        every_part = large.select(*by, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        dealt = of.withColumn("part", F.pmod(F.xxhash64("code"), parts).cast("int")).select(*by, "part", "node", "copies", "embedding")
        kinds = f"label {dict(classes.dtypes)['label']}, dims int"
        key = [*by, "part"]
        placed = dealt.groupBy(*key).cogroup(centers.join(every_part, by).groupBy(*key)).applyInPandas(_nearest, f"{kinds}, part int, node long, copies long, embedding array<double>, cell long, far double")
        placed = stored(placed, "cells")
        cells = placed.groupBy(*by, "cell").agg(F.max("far").alias("radius")).join(centers, [*by, "cell"])
        cells = stored(cells, "radii")
        more = placed.groupBy(*key).cogroup(cells.join(every_part, by).groupBy(*key)).applyInPandas(_guests(threshold), f"{kinds}, node long, copies long, embedding array<double>, cell long, guests array<long>")
        own = own.unionByName(more)
    own = stored(own, "placed")
    guests = own.select(*by, "node", "copies", "embedding", F.explode("guests").alias("cell"))
    whole = [*by, "cell"]
    blocks = own.groupBy(*whole).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(guests.groupBy(*whole).agg(F.ceil(F.count("*") / block).cast("int").alias("guest_blocks")), whole, "left").na.fill(0, ["guest_blocks"])
    blocks = stored(blocks, "blocks")
    place = lambda left, right, side: F.struct(left.cast("int").alias("left"), right.cast("int").alias("right"), side.cast("int").alias("side"))
    at = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: place(F.least(k, F.col("at")), F.greatest(k, F.col("at")), F.col("at") > k))
    with_guests = F.transform(F.sequence(F.lit(1), F.col("guest_blocks")), lambda k: place(F.col("at"), -k, F.lit(0)))
    theirs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: place(k, -1 - F.col("at"), F.lit(1)))
    home = own.join(blocks, whole).withColumn("at", at.cast("int")).withColumn("p", F.when(F.col("guest_blocks") > 0, F.concat(pairs, with_guests)).otherwise(pairs))
    away = guests.join(blocks, whole).withColumn("at", F.pmod(F.xxhash64("node"), F.col("guest_blocks")).cast("int")).withColumn("p", theirs)
    rows = home.select(*whole, "node", "copies", "embedding", F.explode("p").alias("p")).unionByName(away.select(*whole, "node", "copies", "embedding", F.explode("p").alias("p")))
    return rows.select(*whole, "p.left", "p.right", "p.side", "node", "copies", "embedding")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, most_cells: int = MOST_CELLS) -> DataFrame:
    """Cosine links between ``vectors`` (vec_id, embedding, label) of equal label and dimension.

    Returns a row for each row of ``vectors``: vec_id, n_links, component_id, kept.
    Vectors that are null, empty, zero or hold null or non-finite components, and
    those without label, link with nothing and are their own component. Equal
    vectors of a label become one with a count before anything is compared, and
    each counts the others as links. A null vec_id keeps its row, counts as a link
    of others but names no component; repeated vec_ids are vectors of their own
    that share a component with their namesakes. Other columns are ignored; an
    empty table gives an empty table.
    """
    x = F.col("embedding")
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, number) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "label")
    rows = rows.withColumn("fit", fit)
    # 128 bits stand for a vector and its label
    keys = {"code": F.xxhash64("embedding", "label"), "code2": F.xxhash64("label", F.lit("second"), "embedding")}
    valid = rows.where("fit").withColumns(keys)
    classes = valid.groupBy("code", "code2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    dealt = spread(classes, threshold, block, most_cells)
    found = stored(dealt.groupBy("label", "dims", "cell", "left", "right").applyInPandas(_task(threshold), "node long, links long, root long"), "links")
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        classes.select("node", "low", "copies", "code", "code2").join(counted, "node", "left").join(groups, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    named = stored(named, "named")
    least = stored(named.groupBy("component").agg(F.min("low").alias("component_id")), "least")
    named = named.join(least, "component").select("code", "code2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked_rows = valid.select("vec_id", "code", "code2").join(named, ["code", "code2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
