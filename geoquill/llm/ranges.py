"""Near copies of embeddings by an exact metric range join.

Vectors of one label (and length) lie on the unit sphere, where a cosine of c is a distance of sqrt(2 - 2c), the radius
r. Equal vectors are one node with a weight. A cell of many nodes is dealt among pivots, taken from a bounded sample so
that any two are further than 2r apart; each node is at home at its nearest pivot. By the triangle inequality a node x
can have a partner at home at pivot q only if |x q| - |x home| <= 2r, and if |x q| is within r of the distances that
q's home nodes have; only there is it copied to. Cells that gather many more than their own nodes that way (on
spread-out vectors all distances are much alike, so the bounds exclude little) are merged into one rest cell; a split
is kept if it takes a tenth of the comparisons away. Cells join independently: a node finds all its partners in its
home cell, so links are counted there and need no further exchange.

Within a cell nodes are dealt by their distance to the pivot into rings, r / 4 wide, and large rings into blocks. By
the triangle inequality again, rings more than r apart aren't compared, and rings whose distances add up to r or less
are linked whole: counted by their weight and joined by a node of theirs, without a comparison. So a tight group of
near copies, however large, takes work in proportion to its size. All other pairs of blocks are products of matrices
in a task each, which gives the number of links of each node and a spanning forest, never the pairs.

Edge cases: a null label, vectors that are null, empty, zero, or hold null or non-finite components link with nothing:
no links, a component of their own. Equal rows and rows of one id on several vectors are vectors each, and count; an id
joins nothing by itself. A null id has links, but no component id of its own: a component's id is its smallest one that
isn't null. An empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, quoted
from .graph import components, joined

#: Rounding of distances, far more than doubles have here.
SLACK = 1e-6
FOUND = "node long, links long, peer long"


def units(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    m = np.stack(lists.to_numpy(zero_copy_only=False)).astype(float)
    m /= np.abs(m).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def apart(sample: np.ndarray, count: int, least: float) -> list[int]:
    """Rows of a sample, the first and then always the one furthest from those chosen, while it is over `least` away."""
    out = [0]
    near = distances(sample, sample[:1])[:, 0]
    while len(out) < count and near.max() > least:
        out.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[out[-1:]])[:, 0])
    return out


def chosen(sizes: DataFrame, members: DataFrame, turn: int, pivots: int, sample: int, radius: float) -> DataFrame:
    """(cell, pivots): from about `sample` nodes of each cell, by a hash; the pivots' order is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, found = batch.column(0).to_pylist(), []
            for k in range(len(batch)):
                v = batch.column(1)[k].values.field("v")
                found.append(v.take(pa.array(apart(units(v), pivots, 2 * radius))).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["cell", "pivots"])

    drawn = members.filter("home").join(sizes.select("cell", "h"), "cell").filter(F.pmod(F.xxhash64("node", F.lit(turn)), F.col("h")) < sample)
    return drawn.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("node", F.col("v").cast("array<double>").alias("v")))).alias("s")).mapInArrow(run, "cell string, pivots array<array<double>>")


def measured(members: DataFrame, sizes: DataFrame, turn: int, pivots: int, sample: int, radius: float, rows: int) -> DataFrame:
    """Members of the cells of `sizes` with the distances to the cell's pivots, and which is nearest."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return left.append_column("near", pa.array([0] * len(left), pa.int32())).append_column("d", pa.array([[0.0]] * len(left), pa.list_(pa.float64()))).drop(["salt"])
        p = units(right.column("pivots")[0].values)
        d = distances(units(left.column("v").combine_chunks()), p)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), len(p)).cast(pa.list_(pa.float64()))
        return left.append_column("near", pa.array(d.argmin(axis=1).astype(np.int32))).append_column("d", flat).drop(["salt"])

    salts = F.ceil(F.col("n") / rows)
    dealt = members.join(sizes.select("cell", "n"), "cell").withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), salts)).drop("n")
    known = chosen(sizes, members, turn, pivots, sample, radius).join(sizes.select("cell", "n"), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "pivots")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema) + ", near int, d array<double>"
    return dealt.groupBy("cell", "salt").cogroup(known.groupBy("cell", "salt")).applyInArrow(run, schema)


def split(members: DataFrame, sizes: DataFrame, turn: int, pivots: int, sample: int, radius: float, rows: int, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of the cells of `sizes`: members of their parts, where a split is worth it, and the cells where it isn't."""
    known = cut(measured(members, sizes, turn, pivots, sample, radius, rows), "ranges-measured", made)
    rings = known.filter("home").groupBy("cell", "near").agg(F.min(F.col("d")[F.col("near")]).alias("low"), F.max(F.col("d")[F.col("near")]).alias("high"))
    rings = rings.groupBy("cell").agg(F.collect_list(F.struct("near", "low", "high")).alias("rings"))
    d = F.col("d")
    may = lambda q: (q["near"] == F.col("near")) & F.col("home") | (d[q["near"]] - d[F.col("near")] <= 2 * radius + SLACK) & (d[q["near"]] >= q["low"] - radius - SLACK) & (d[q["near"]] <= q["high"] + radius + SLACK)
    # where a node goes, in bits' stead a short list of pivots
    there = cut(known.join(rings, "cell").withColumn("at", F.transform(F.filter("rings", may), lambda q: q["near"])).drop("rings"), "ranges-there", made)
    parts = there.select("cell", "home", "near", F.explode("at").alias("q")).groupBy("cell", "q").agg(F.count("*").alias("n"), F.count_if(F.col("home") & (F.col("near") == F.col("q"))).alias("h"))
    alone = parts.groupBy("cell").agg(F.collect_list(F.when(F.col("n") <= 2 * F.col("h"), F.col("q"))).alias("alone"), F.sum(F.when(F.col("n") <= 2 * F.col("h"), F.col("n") * F.col("h"))).alias("cost"))
    homes = F.transform("at", lambda q: F.when(F.array_contains("alone", q), q).otherwise(-1))
    placed = there.join(alone, "cell").withColumn("q", F.explode(F.array_distinct(homes)))
    own = F.when(F.array_contains("alone", F.col("near")), F.col("near")).otherwise(-1) == F.col("q")
    placed = cut(placed.select("cell", "q", "node", (F.col("home") & own).alias("home"), "weight", "v", F.when(F.col("q") >= 0, d[F.col("q")]).alias("ring")), "ranges-parts", made)
    cost = placed.groupBy("cell", "q").agg(F.count("*").alias("n"), F.count_if("home").alias("h")).groupBy("cell").agg(F.sum(F.col("n") * F.col("h")).alias("cost"))
    worth = cut(sizes.join(cost, "cell", "left").select("cell", F.coalesce(F.col("cost") <= 0.9 * F.col("n") * F.col("h"), F.lit(False)).alias("worth")), "ranges-worth", made)
    parts = placed.join(worth.filter("worth").select("cell"), "cell").select(F.concat_ws(".", "cell", "q").alias("cell"), "node", "home", "weight", "v", "ring")
    return parts, worth.filter("not worth").select("cell")


def compared(pair: pa.Table, cosine: float) -> pa.Table:
    """Number of links of the nodes at home in a pair of blocks, and for every node linked the smallest of its part."""
    v, home, node, weight = units(pair.column("v").combine_chunks()), pair.column("home").to_numpy(), pair.column("node").to_numpy(), pair.column("weight").to_numpy()
    side = pair.column("side").to_numpy()
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)  # side 0: a block with itself
    links, a, b = np.zeros(len(v), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start in range(0, len(left), 512):
        rows = left[start : start + 512]
        hit = v[rows] @ v[right].T >= cosine
        if side[0] == 0:
            hit[np.arange(len(rows)), start + np.arange(len(rows))] = False
        hit &= home[rows][:, None] | home[right][None, :]
        links[rows] += hit @ weight[right]
        if side[0]:
            links[right] += weight[rows] @ hit
        i, j = np.nonzero(hit)
        if len(i):
            x, y = joined(node[rows[i]], node[right[j]])  # at most one link for each node goes on
            a.append(x), b.append(y)
    links[~home] = 0
    x, y = joined(np.concatenate(a), np.concatenate(b))
    peer = node.copy()
    order = np.argsort(node, kind="stable")
    peer[order[np.searchsorted(node[order], x)]] = y
    keep = (links > 0) | (peer != node)
    return pa.table({"node": node[keep], "links": links[keep], "peer": peer[keep]})


def found(members: DataFrame, cosine: float, rows: int, made: list[str]) -> DataFrame:
    """(node, links, peer) of cells: parts of the number of links, and links of spanning forests."""
    radius = math.sqrt(2 - 2 * cosine)
    width = radius / 4 - SLACK
    sizes = members.groupBy("cell").agg(F.count("*").alias("n"))
    # a cell of one block has one ring; without a pivot (-1) nothing is known of a distance
    ring = F.when((F.col("n") <= rows) | F.col("ring").isNull(), -1).otherwise(F.floor(F.col("ring") / width)).cast("int")
    ringed = members.join(sizes, "cell").withColumn("ring", ring).drop("n")
    rings = ringed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.count_if("home").alias("h"), F.sum("weight").alias("w"), F.min("node").alias("first")).withColumn("blocks", F.ceil(F.col("n") / rows))
    rings = cut(rings, "ranges-rings", made)
    other = rings.select("cell", *[F.col(c).alias(f"{c}2") for c in ("ring", "h", "w", "first", "blocks")])
    pairs = rings.join(other, "cell").filter("h > 0 or h2 > 0")  # a cell has few rings
    sure = (F.col("ring") >= 0) & (F.col("ring2") >= 0) & (F.col("ring") + F.col("ring2") <= 2)
    far = (F.col("ring") >= 0) & (F.col("ring2") >= 0) & ((F.abs(F.col("ring") - F.col("ring2")) - 1) * width > radius + SLACK)
    whole = pairs.filter(sure).groupBy("cell", "ring").agg(F.sum("w2").alias("w"), F.collect_set("first2").alias("firsts"))
    linked = ringed.filter("home").join(whole, ["cell", "ring"])
    # a node is in one of the rings that its own is linked with, if it is its own
    itself = F.when(F.col("ring") <= 1, F.col("weight")).otherwise(0)
    counted = linked.select("node", (F.col("w") - itself).alias("links"), F.explode("firsts").alias("peer"), F.array_min("firsts").alias("once"))
    counted = counted.select("node", F.when(F.col("peer") == F.col("once"), F.col("links")).otherwise(0).alias("links"), "peer")
    # pairs of blocks, each once
    block = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    tasks = pairs.filter(~sure & ~far & (F.col("ring") <= F.col("ring2"))).withColumn("b", block("blocks")).withColumn("b2", block("blocks2")).filter("ring < ring2 or b <= b2")
    tasks = tasks.withColumn("task", F.concat_ws(" ", "cell", "ring", "b", "ring2", "b2"))
    same = (F.col("ring") == F.col("ring2")) & (F.col("b") == F.col("b2"))
    one = tasks.select("cell", "ring", "b", "task", F.when(same, 0).otherwise(1).alias("side"))
    two = tasks.filter(~same).select("cell", F.col("ring2").alias("ring"), F.col("b2").alias("b"), "task", F.lit(2).alias("side"))
    dealt = ringed.join(rings.select("cell", "ring", "blocks"), ["cell", "ring"]).withColumn("b", F.pmod(F.xxhash64("node", F.lit("block")), "blocks"))
    sent = dealt.join(one.union(two), ["cell", "ring", "b"]).select("task", "side", "node", "home", "weight", "v")
    return counted.union(sent.groupBy("task").applyInArrow(lambda t: compared(t, cosine), FOUND))


def near(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93, rows: int = 2048, pivots: int = 32, sample: int = 256, rounds: int = 8) -> DataFrame:
    """A row for each vector: vec_id (the key), n_links, component_id, kept. Cells of over `rows` nodes are split by up
    to `pivots` of a sample of about `sample` nodes, again and again while that is worth it, `rounds` times at most (what
    is left is compared all the same); `rows` is also the size of a block."""
    radius, made = math.sqrt(2 - 2 * cosine), []
    c = quoted(vector)
    bad = lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
    usable = F.coalesce(quoted(label).isNotNull() & ~F.exists(c, bad) & F.exists(c, lambda v: v != 0), F.lit(False))
    given = vectors.select(quoted(key).cast("long").alias("id"), quoted(label).cast("string").alias("label"), c.alias("v"), usable.alias("usable"))
    able = given.filter("usable")
    nodes = able.groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("weight"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "ranges-nodes", made)
    opened = nodes.select(F.concat_ws("/", F.size("v"), "label").alias("cell"), "node", F.lit(True).alias("home"), "weight", "v", F.lit(None).cast("double").alias("ring"))
    closed: list[DataFrame] = []
    for turn in range(rounds):
        sizes = cut(opened.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("h")), "ranges-sizes", made)
        large: Column = (F.col("n") > rows) & (F.col("h") > 0)
        if sizes.filter(large).isEmpty():
            break
        wide = sizes.filter(large)
        parts, left = split(opened.join(wide.select("cell"), "cell", "left_semi"), wide, turn, pivots, sample, radius, rows, made)
        closed += [opened.join(wide.select("cell"), "cell", "left_anti"), opened.join(left, "cell", "left_semi")]
        opened = cut(parts, "ranges-open", made)
    members = opened
    for part in closed:
        members = members.union(part)
    partial = cut(found(cut(members, "ranges-members", made), cosine, rows, made), "ranges-found", made)
    counts = partial.groupBy("node").agg(F.sum("links").alias("links"))
    kept: list[str] = []
    parts = components(partial.select(F.col("node").alias("a"), F.col("peer").alias("b")), kept)
    known = nodes.join(counts, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = known.groupBy("component").agg(F.min("low").alias("lowest"))
    known = cut(known.join(lowest, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("lowest").alias("component_id")), "ranges-known")
    drop(vectors.sparkSession, made + kept)
    told = able.join(known, ["label", "v"]).select("id", "n_links", "component_id")
    alone = given.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return told.union(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
