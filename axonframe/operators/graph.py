"""Operators over connections: rows of (src, dst, ...), an ordinal being the place in order of (src, dst)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import stored
from .events import prefix_sums

#: Sources of a block when offsets are summed.
BLOCK = 1024
#: Bytes of a table of nodes that goes to all executors, at most.
MOST_BROADCAST = 16 << 20
#: Maps that the edges of a source are held in while they are looked up.
BUCKETS = 64


def square_torus(spark: SparkSession, side: int) -> DataFrame:
    """Each node of a side x side torus with its right, left, lower and upper neighbour, each once and never itself."""
    n, r, c = side * side, F.floor(F.col("id") / side), F.col("id") % side
    around = F.array(r * side + (c + 1) % side, r * side + (c + side - 1) % side, ((r + 1) % side) * side + c, ((r + side - 1) % side) * side + c)
    nodes = spark.range(n).select(F.col("id").alias("src"), F.array_remove(F.array_distinct(around), F.col("id")).alias("to"))
    return nodes.select("src", F.posexplode("to").alias("position", "dst"))


def draw(src: Column, k: Column, seed: int, n: int) -> Column:
    """A node for the k-th draw of a source: one step of a linear congruential generator, the same in any engine."""
    mixed = (src * 7919 + k * 104729 + seed * 15485863) % 2147483647
    return ((mixed * 48271) % 2147483647) % n


def random_fixed_outdegree(spark: SparkSession, nodes: int, fanout: int, seed: int, skip: DataFrame | None = None) -> DataFrame:
    """``fanout`` different targets of each source, none itself: the first different ones among its draws, then the lowest left.

    ``skip`` (src, dst) has pairs that may not be drawn.
    """
    fanout = min(fanout, nodes - 1)
    tries = 4 * fanout + 8
    drawn = spark.range(nodes).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("k"))
    drawn = drawn.select("src", draw(F.col("src"), F.col("k"), seed, nodes).alias("dst"), "k").where("src <> dst")
    if skip is not None:
        drawn = drawn.join(skip.select("src", "dst"), ["src", "dst"], "left_anti")
    first = drawn.groupBy("src", "dst").agg(F.min("k").alias("k"))
    # sources with too few: of so many lowest targets enough are left, after all drawn ones
    got = spark.range(nodes).select(F.col("id").alias("src")).join(first.groupBy("src").count(), "src", "left").where(f"coalesce(count, 0) < {fanout}")
    most = F.lit(fanout + 1)
    if skip is not None:
        got = got.join(skip.groupBy("src").agg(F.count_distinct("dst").alias("skipped")), "src", "left")
        most = most + F.coalesce("skipped", F.lit(0))
    left = got.select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.least(most, F.lit(nodes)).cast("long") - 1)).alias("dst")).where("src <> dst")
    if skip is not None:
        left = left.join(skip.select("src", "dst"), ["src", "dst"], "left_anti")
    first = first.unionByName(left.join(first.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("k", F.col("dst") + tries))
    return first.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy("k"))).where(F.col("rank") <= fanout).select("src", "dst")


def small_world_torus(spark: SparkSession, side: int, fanout: int, seed: int) -> DataFrame:
    """The torus and ``fanout`` random targets more for each node."""
    torus = square_torus(spark, side).select("src", "dst")
    return torus.unionByName(random_fixed_outdegree(spark, side * side, fanout, seed, torus))


def row_offsets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each node its out-degree and the ordinal its edges start at."""
    degree = nodes.select("node").join(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    return prefix_sums(degree, "node", F.floor(F.col("node") / BLOCK), "degree").select("node", "degree", (F.col("degree_sum") - F.col("degree")).alias("offset"))


def ordinals(edges: DataFrame) -> DataFrame:
    """``edges`` with their ordinal: the offset of the source and the rank of the target in it, so no task sorts all.

    The edges are stored first, as they are read twice.
    """
    edges = stored(edges, "edges")
    starts = row_offsets(edges, edges.select(F.col("src").alias("node")).distinct())
    rank = F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1
    return edges.withColumn("_rank", rank).join(starts.select(F.col("node").alias("src"), "offset"), "src").withColumn("ordinal", F.col("offset") + F.col("_rank")).drop("_rank", "offset")


def neighbors(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Targets of each source in order; of more than ``most`` only the first ones are gathered."""
    if most is not None:
        edges = edges.withColumn("_rank", F.row_number().over(W.partitionBy("src").orderBy("dst"))).where(F.col("_rank") <= most)
    return edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("targets"))


def predecessors(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_list("src")).alias("sources"))


def nth(edges: DataFrame, n: int, by: str = "src", of: str = "dst") -> DataFrame:
    """The ``n``-th (from 0) neighbour of each node that has so many, or predecessor with ``by`` and ``of`` changed over."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(of))
    return edges.withColumn("_rank", rank).where(F.col("_rank") == n + 1).select(F.col(by).alias("node"), F.col(of).alias("other"))


def in_network(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` (src, dst) with whether src is a parent of dst, and whether either node has any edge."""
    known = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    parent = edges.select("src", "dst").distinct().withColumn("is_parent", F.lit(True))
    out = pairs.join(parent, ["src", "dst"], "left").withColumn("is_parent", F.coalesce("is_parent", F.lit(False)))
    for side in ("src", "dst"):
        out = out.join(known.select(F.col("node").alias(side), F.lit(True).alias(f"{side}_known")), side, "left").withColumn(f"{side}_known", F.coalesce(f"{side}_known", F.lit(False)))
    return out.select("src", "dst", "is_parent", "src_known", "dst_known")


def linked(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``nodes`` (node, ...) with whether each has any edge, as ``name``."""
    known = edges.select(F.col("src").alias("node")).distinct().unionByName(edges.select(F.col("dst").alias("node")).distinct()).distinct()
    return nodes.join(known.withColumn(name, F.lit(True)), "node", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def grid(sources: DataFrame, targets: DataFrame, edges: DataFrame, *values: str) -> DataFrame:
    """All pairs of ``sources`` (src, part, ...) and ``targets`` (dst, part, ...) that share a part, with ``edge``: the struct of
    ``values`` of the edge from one to the other, null if there is none. No pair may be there twice in ``edges`` (src, dst, ...).

    There are many more pairs than edges, so edges go to the pairs and pairs are never shuffled: edges within a part are
    gathered at their source, in ``BUCKETS`` maps by target, and looked up as the targets are joined to it.
    """
    count = targets.count() * 8 * len(targets.columns)
    few = F.broadcast if count <= MOST_BROADCAST else lambda table: table
    bucket = F.pmod("dst", F.lit(BUCKETS)).cast("int")
    inside = edges.join(few(targets.select("dst", "part").distinct()), "dst").join(sources.select("src", "part").distinct(), ["src", "part"])
    maps = inside.groupBy("src", "part", bucket.alias("bucket")).agg(F.map_from_entries(F.collect_list(F.struct("dst", F.struct(*values)))).alias("m"))
    held = maps.groupBy("src", "part").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "m"))).alias("_held"))
    pairs = sources.join(held, ["src", "part"], "left").join(few(targets), "part")
    return pairs.withColumn("edge", F.try_element_at(F.try_element_at("_held", bucket), F.col("dst"))).drop("_held")


def from_adjacency(rows: DataFrame, nodes: int | None = None) -> DataFrame:
    """Edges (src, dst, position) of adjacency lists (node, targets): row i lists the targets of i.

    A target that is there twice, or is no node, is an error when the edges are read. ``nodes`` is their
    number; without it the rows are counted.
    """
    n = rows.count() if nodes is None else nodes
    checked = F.when(F.size(F.array_distinct("targets")) < F.size("targets"), F.raise_error(F.concat(F.lit("a target is listed twice for node "), F.col("node").cast("string"))))
    checked = checked.when(F.exists("targets", lambda t: t.isNull() | (t < 0) | (t >= n)), F.raise_error(F.concat(F.lit("a target of this node is no node: "), F.col("node").cast("string"))))
    # the test's result is used as a key, so that it can't be optimized away
    tested = rows.where(F.size("targets") > 0).withColumn("targets", F.when(F.coalesce(checked.cast("boolean"), F.lit(True)), F.col("targets")))
    return tested.select(F.col("node").cast("long").alias("src"), F.posexplode("targets").alias("position", "dst")).select("src", F.col("dst").cast("long").alias("dst"), "position")


def from_callback(edges: DataFrame, values, names: tuple[str, ...] = ("weight", "delay")) -> DataFrame:
    """``edges`` (src, dst, ...) with the columns ``names`` that ``values(src, dst)`` gives for arrays of numbers of nodes.

    The function is called once for a batch of edges, wherever they are, and again if a task is: it must depend on nothing else.
    """
    kinds = edges.select("src", "dst", *[F.lit(0.0).alias(n) for n in names]).schema

    def run(batches):
        for frame in batches:
            found = values(frame["src"].to_numpy(), frame["dst"].to_numpy())
            found = found if isinstance(found, tuple) else (found,)
            if len(found) != len(names):
                raise ValueError(f"a callback gave {len(found)} values, not {len(names)}")
            yield frame.assign(**{n: np.broadcast_to(np.asarray(v, dtype=float), len(frame)) for n, v in zip(names, found)})

    return edges.select("src", "dst").mapInPandas(run, kinds)


def keep_first(edges: DataFrame, by: str = "doc_order") -> DataFrame:
    """One edge of each pair, the first in the document."""
    w = W.partitionBy("src", "dst").orderBy(by)
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicate_pairs(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1")


def runs(edges: DataFrame, value: str) -> DataFrame:
    """Stretches of one source's edges, in order of target, that have the same ``value``: first ordinal and length."""
    w = W.partitionBy("src").orderBy("ordinal")
    marked = edges.withColumn("_new", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1)))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy("src", "run", value).agg(F.min("ordinal").alias("first_ordinal"), F.count("*").alias("n"))


def shares(edges: DataFrame, proportions: dict[str, float], total: Column) -> DataFrame:
    """Synapse of each edge by its ordinal: contiguous shares, ends rounded half away from zero, the last taking the rest."""
    whole, cum, out = sum(proportions.values()), 0.0, None
    names = list(proportions)
    for name in names[:-1]:
        cum += proportions[name]
        test = F.col("ordinal") < F.round(F.lit(cum / whole) * total)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return edges.withColumn("synapse", F.lit(names[-1]) if out is None else out.otherwise(F.lit(names[-1])))


def _div(a: Column, b: Column | int) -> Column:
    """Whole quotient of longs, exact beyond 2**53."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def k2_code(row: Column, col: Column, k: int, levels: int) -> Column:
    """Digits, base k*k, of the quadrants from the whole matrix down to the cell."""
    if (k * k) ** levels > 1 << 63:
        raise ValueError(f"{levels} levels of {k} x {k} parts don't fit a long")
    code = F.lit(0).cast("long")
    for level in reversed(range(levels)):
        side = k**level
        code = code * (k * k) + (_div(row.cast("long"), side) % k) * k + _div(col.cast("long"), side) % k
    return code


def k2_masks(edges: DataFrame, k: int, levels: int) -> DataFrame:
    """For each level and each quadrant with edges the bits of its k*k parts that have any.

    Edges are dealt out by their quadrant of a middle level, so a task has all of a
    quadrant (of a bounded number of cells) and works out all levels below it, each
    from the quadrants of the level under it. The few quadrants above meet once more.
    """
    cut, parts = levels // 2, k * k
    coded = edges.select(k2_code(F.col("src"), F.col("dst"), k, levels).alias("code"))
    dealt = coded.withColumn("_top", _div(F.col("code"), parts ** (levels - cut))).repartition("_top").sortWithinPartitions("code").select("code")

    def run(batches):
        rest = np.zeros(0, dtype=np.int64)
        for batch in batches:
            codes = np.concatenate([rest, batch.column("code").to_numpy()])
            tops = codes // parts ** (levels - cut)
            whole = int(np.searchsorted(tops, tops[-1])) if len(codes) else 0
            yield from masks(codes[:whole])
            rest = codes[whole:]
        yield from masks(rest)

    def masks(codes):
        codes = np.unique(codes)
        for level in range(levels, 0, -1):
            if not len(codes):
                return
            prefix, first = np.unique(codes // parts, return_index=True)
            mask = np.bitwise_or.reduceat(np.int64(1) << codes % parts, first)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prefix), level, dtype=np.int32)), pa.array(prefix), pa.array(mask)], ["level", "prefix", "mask"])
            codes = prefix

    found = stored(dealt.mapInArrow(run, "level int, prefix long, mask long"), "masks")
    upper = found.where(F.col("level") <= cut).groupBy("level", "prefix").agg(F.bit_or("mask").alias("mask"))
    return found.where(F.col("level") > cut).unionByName(upper)


def get_bit(words: Column, i: Column | int) -> Column:
    """Bit ``i`` of an array of longs, 64 bits each, the lowest first."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.call_function("shiftrightunsigned", F.get(words, _div(i.cast("long"), 64).cast("int")), (i % 64).cast("int")).bitwiseAND(1)


def rank1(words: Column, i: Column | int) -> Column:
    """Ones among the first ``i`` bits of an array of longs."""
    i = (F.lit(i) if isinstance(i, int) else i).cast("long")
    whole = _div(i, 64).cast("int")
    below = F.aggregate(F.slice(words, 1, whole), F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w).cast("long"))
    mask = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), (i % 64).cast("int")))
    return below + F.when(i % 64 > 0, F.bit_count(F.get(words, whole).bitwiseAND(mask)).cast("long")).otherwise(F.lit(0).cast("long"))


def within_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Nodes that ``start`` (node) reaches in so many steps at most, with the least number of steps; each step's result is stored."""
    edges = stored(edges.select("src", "dst"), "edges")
    seen = stored(start.select(F.col("node").cast("long"), F.lit(0).alias("hops")).distinct(), "hop")
    front = seen
    for h in range(1, hops + 1):
        front = edges.join(front, edges.src == front.node).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").select("node", F.lit(h).alias("hops"))
        front = stored(front, "hop")
        seen = seen.unionByName(front)
    return seen
