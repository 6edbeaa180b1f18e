"""Clusters of mutually similar vectors by Markov clustering on a sparse similarity graph.

1. ``neighbours.answers`` gives each distinct vector its nearest others within the limit and, per block, the
   links that keep groups connected; vectors without any are in no cluster.
2. The graph is coarsened once: every node joins its nearest neighbour's tree, and trees become nodes.
3. Markov clustering on the coarse graph: the column-stochastic matrix is squared (a join on the inner index),
   inflated, pruned and normalised again until its columns have settled; a column's strongest row is its
   attractor, and attractors define the *flow clusters*.
4. Flow clusters become the nodes of a smaller graph, which is clustered by flow in the same way, until nothing links
   two of them: then a cluster is a greatest set joined by similarity. Only flow puts nodes together, level by level.

Everything stays distributed; lineage is cut by checkpoints, which are deleted as soon as the next is written.
A row of the matrix that most columns hold (an attractor near the end) is a hot key of the squaring's join: columns that have
settled no longer take part on that side, and what is left is split by AQE's skew join, as the other side has one row a key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from orrery.functions.vectors import is_valid_vector, l2_squared
from orrery.llm import neighbours as nn
from orrery.llm.cells import fit
from orrery.operators.knn import nearest_centroid
from orrery.session import cut, release, tidy


#: Rows up to which the one side of a join is broadcast, so that the other isn't shuffled.
FEW = 1 << 16


@dataclass(frozen=True)
class Markov:
    """inflation: power of the entries. entries: entries a column keeps. least: share under which an entry is pruned.
    settled: a column has settled when its strongest entry holds this share. patience: squaring ends when all columns have,
    or when so many of them in turn found no further one. apart: by how much a hash of the row may raise
    an entry at the start, as columns shared by equal attractors would stay open for ever. decay: similarity exp(-decay * distance / limit) of an edge. jumps: doublings of the nearest-neighbour
    pointers when trees are formed."""

    inflation: float = 2.0
    entries: int = 4
    least: float = 0.01
    settled: float = 0.9
    patience: int = 6
    apart: float = 0.3
    decay: float = 4.0
    jumps: int = 2


def similarity_graph(tables: list[tuple[DataFrame, str, str, int]], p: nn.Similar) -> DataFrame:
    """(``node``, ``near``, ``far``, ``links``) of every vector with a similar one; tables never mix.

    ``tables`` holds (table, id column, vector column, bit), the bit telling the tables' nodes apart.
    """
    routers, rows = {}, None
    for df, id_col, vector_col, bit in tables:
        routers[bit] = fit(df, vector_col, p.shape(), p.k)
        part = nn.stored_rows(df, id_col, vector_col, space=bit, bit=bit)
        rows = part if rows is None else rows.unionByName(part)
    found = cut(nn.answers(rows, routers, p, graph=True).select("node", "near", F.transform("far", lambda d: d.cast("float")).alias("far"), "links"))
    best = found.groupBy("node").agg(
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("far", "near"))))), 1, p.k).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"),
    )
    graph = cut(best.select("node", F.transform("hits", lambda h: h["near"]).alias("near"), F.transform("hits", lambda h: h["far"]).alias("far"), "links"))
    release(found)
    return graph


def trees(graph: DataFrame, jumps: int) -> DataFrame:
    """(``node``, ``root``): each node's tree of nearest-neighbour pointers, named by its root.

    Two nodes nearest to each other root a tree at the smaller; longer pointer cycles cannot arise, as of equal
    distances the smaller node is the nearest. Trees deeper than 2 ** jumps fall into several, which stay linked.
    """
    to = graph.select("node", F.coalesce(F.get("near", F.lit(0)), F.get("links", F.lit(0))).alias("to"))
    back = to.select(F.col("node").alias("to"), F.col("to").alias("back"))
    up = to.join(back, "to", "left").select("node", F.when(F.col("back") == F.col("node"), F.least("node", "to")).when(F.col("back").isNull(), F.col("node")).otherwise(F.col("to")).alias("root"))
    up = cut(up)
    for _ in range(jumps):
        above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
        up = cut(up.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
    return up


def coarse_edges(graph: DataFrame, roots: DataFrame, p: nn.Similar, m: Markov) -> DataFrame:
    """(``a``, ``b``, ``w``), both ways: the summed similarities between different trees."""
    near = F.zip_with("near", "far", lambda n, d: F.struct(n.alias("to"), F.exp(-m.decay * d / p.limit).cast("float").alias("w")))
    link = F.transform("links", lambda n: F.struct(n.alias("to"), F.lit(math.exp(-m.decay)).cast("float").alias("w")))
    edges = graph.join(roots, "node").select(F.col("root").alias("a"), F.explode(F.concat(near, link)).alias("e")).select("a", F.col("e.to").alias("node"), F.col("e.w").cast("double").alias("w"))
    edges = edges.join(roots, "node").where(F.col("root") != F.col("a"))
    return _both_ways(edges.select("a", F.col("root").alias("b"), "w"))


def _both_ways(edges: DataFrame) -> DataFrame:
    """Weights (``a``, ``b``, ``w``) added up per pair, whatever the direction, and given in both."""
    pairs = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _columns(entries: DataFrame, m: Markov) -> DataFrame:
    """(``j``, ``rows`` of (v, i), strongest first, summing to 1) from entries (``j``, ``i``, ``v``): pruned and normalised."""
    kept = entries.groupBy("j").agg(F.slice(F.sort_array(F.collect_list(F.struct("v", "i")), asc=False), 1, m.entries).alias("rows"))
    total = F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["v"].cast("double"))
    kept = kept.withColumn("total", total).withColumn("rows", F.filter("rows", lambda r: r["v"] >= m.least * F.col("total")))
    total = F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["v"].cast("double"))
    return kept.withColumn("total", total).select("j", F.transform("rows", lambda r: F.struct((r["v"] / F.col("total")).cast("float").alias("v"), r["i"].alias("i"))).alias("rows"))


def _squared(matrix: DataFrame, m: Markov, few: bool = False) -> DataFrame:
    """The matrix's square, inflated, pruned and normalised; columns that have settled keep their strongest row alone and
    aren't shuffled. ``few`` tells that the others are few, and are taken to the matrix where it lies."""
    done = F.col("rows")[0]["v"] >= m.settled
    left = matrix.where(~done).select("j", F.explode("rows").alias("l")).select("j", F.col("l.i").alias("k"), F.col("l.v").alias("share"))
    left = F.broadcast(left) if few else left
    right = matrix.select(F.col("j").alias("k"), F.col("rows"))
    product = left.join(right, "k").select("j", F.transform("rows", lambda r: F.struct(r["i"].alias("i"), (r["v"] * F.col("share")).cast("float").alias("v"))).alias("part"))
    kept = matrix.where(done).select("j", F.array(F.struct(F.lit(1.0).cast("float").alias("v"), F.col("rows")[0]["i"].alias("i"))).alias("rows"))
    entries = product.repartition("j").select("j", F.explode("part").alias("e")).groupBy("j", F.col("e.i").alias("i")).agg(F.sum("e.v").alias("v"))
    return _columns(entries.withColumn("v", F.pow("v", m.inflation)), m).unionByName(kept)


def flow(edges: DataFrame, m: Markov) -> DataFrame:
    """(``j``, ``attractor``, ``flow``) of every node of the graph (``a``, ``b``, ``w``), both ways, by Markov clustering.

    No node with an edge stays alone: one that is its own attractor and nobody else's goes where its strongest
    edge leads, of two such nodes to the larger. Of equally strong edges a hash decides, alike at both ends.
    """
    loops = edges.groupBy("a").agg(F.max("w").alias("v")).select(F.col("a").alias("j"), F.col("a").alias("i"), "v")
    entries = edges.select(F.col("a").alias("j"), F.col("b").alias("i"), F.col("w").alias("v")).unionByName(loops)
    apart = 1 + m.apart * F.pmod(F.xxhash64("i"), F.lit(1 << 16)) / F.lit(float(1 << 16))
    matrix = cut(_columns(entries.withColumn("v", F.col("v") * apart), m))
    least, waited, open_ = None, 0, FEW
    while waited < m.patience:
        seen = Observation()
        new = cut(_squared(matrix, m, open_ * m.entries <= FEW).observe(seen, F.count_if(F.col("rows")[0]["v"] < m.settled).alias("open")))
        release(matrix)
        matrix, open_ = new, seen.get["open"]
        if not open_:
            break
        waited = waited + 1 if least is not None and open_ >= least else 0
        least = open_ if least is None else min(least, open_)
    own = matrix.select("j", F.col("rows")[0]["i"].alias("attractor"), F.col("rows")[0]["v"].alias("flow"))
    held = own.where("attractor != j").select(F.col("attractor").alias("j")).distinct().withColumn("held", F.lit(True))
    seen = Observation()
    own = own.join(held, "j", "left").withColumn("alone", (F.col("attractor") == F.col("j")) & F.col("held").isNull()).drop("held")
    own = cut(own.observe(seen, F.count_if("alone").alias("alone")))
    release(matrix)
    small = F.broadcast if seen.get["alone"] <= FEW else lambda df: df
    pair = F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))
    out = edges.join(small(own.where("alone").select(F.col("j").alias("a"))), "a", "left_semi").groupBy("a").agg(F.max(F.struct("w", pair.alias("pair"), "b"))["b"].alias("to"))
    there = own.select(F.col("j").alias("to"), F.col("attractor").alias("theirs"), F.col("alone").alias("both"))
    moved = small(out).join(there, "to").select(F.col("a").alias("j"), F.when(F.col("both"), F.greatest("a", "to")).otherwise(F.col("theirs")).alias("moved"))
    done = cut(own.join(small(moved), "j", "left").select("j", F.coalesce("moved", "attractor").alias("attractor"), "flow"))
    release(own)
    return done


def contracted(edges: DataFrame, named: DataFrame) -> DataFrame:
    """The edges (``a``, ``b``, ``w``) between the clusters that (``j``, ``attractor``) makes of the nodes."""
    at = lambda end, name: named.select(F.col("j").alias(end), F.col("attractor").alias(name))
    ends = edges.where("a < b").join(at("a", "x"), "a").join(at("b", "y"), "b").where(F.col("x") != F.col("y"))
    return _both_ways(ends.select(F.col("x").alias("a"), F.col("y").alias("b"), "w"))


def levels(edges: DataFrame, m: Markov) -> tuple[DataFrame, DataFrame]:
    """The flow clusters (``j``, ``attractor``, ``flow``) of the graph, and (``j``, ``top``) after clustering these by
    flow again until no edge is left between two. ``edges`` are deleted."""
    first, top = None, None
    while True:
        found = flow(edges, m)
        step = found.select(F.col("j").alias("top"), F.col("attractor").alias("above"))
        if first is None:
            first, top = found, found.select("j", F.col("attractor").alias("top"))
        else:
            new = cut(top.join(step, "top", "left").select("j", F.coalesce("above", "top").alias("top")))
            release(top)
            top = new
        rest = cut(contracted(edges, found))
        release(edges)
        if found is not first:
            release(found)
        edges = rest
        tidy(edges.sparkSession)
        if edges.isEmpty():
            release(edges)
            return first, top


def clustered(tables: list[tuple[DataFrame, str, str, int]], p: nn.Similar = nn.Similar(k=6), m: Markov = Markov()) -> tuple[DataFrame, DataFrame]:
    """Clusters of the valid vectors of each table.

    The first result, (``node``, ``root``, ``attractor``, ``flow``, ``label``), names each node's flow cluster and,
    in ``label``, the smallest node of its cluster; nodes without a similar other are missing. The second is the
    similarity graph. ``p.limit`` must be given.
    """
    graph = similarity_graph(tables, p)
    tidy(graph.sparkSession)
    roots = trees(graph, m.jumps)
    edges = cut(coarse_edges(graph, roots, p, m))
    tidy(graph.sparkSession)
    flows, tops = levels(edges, m)
    up = flows.select(F.col("j").alias("attractor"), F.col("attractor").alias("second"))
    flows = flows.join(up, "attractor", "left").select("j", F.coalesce("second", "attractor").alias("attractor"), "flow").join(tops, "j")
    named = roots.join(flows.withColumnRenamed("j", "root"), "root", "left").select("node", "root", F.coalesce("attractor", "root").alias("attractor"), F.coalesce("flow", F.lit(1.0)).alias("flow"), F.coalesce("top", "root").alias("top"))
    named = cut(named)
    least = named.groupBy("top").agg(F.min("node").alias("label"))
    return named.join(least, "top").select("node", "root", "attractor", "flow", "label"), graph


def cluster_members(named: DataFrame, members: DataFrame, least: int = 3) -> DataFrame:
    """(``bit``, ``cluster_key``, ``member_id``) of clusters with at least ``least`` members, copies counted."""
    full = cut(members.join(named.select("node", "label"), "node", "left").select("id", F.coalesce("label", "node").alias("label")))
    few = full.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") < least).select("label")
    kept = full.join(few, "label", "left_anti")
    return kept.select(F.col("label").bitwiseAND(F.lit(1).cast("long")).alias("bit"), F.shiftright("label", 1).alias("cluster_key"), F.col("id").alias("member_id"))


def described(named: DataFrame, members: DataFrame, stored: DataFrame, centroids: DataFrame, p: nn.Similar, *, bit: int = 0, least: int = 3, typical: int = 3, id_col: str = "id", vector_col: str = "data", centroid_id: str = "centroid_id", centroid_col: str = "vector") -> DataFrame:
    """(``cluster_key``, ``size``, ``typical_ids``, ``centroid_id``, ``distance``) of each cluster of one table.

    ``size`` counts members, copies included. ``typical_ids`` are the members of strongest flow into their
    attractor, attractors and tree roots first, then smaller ids. ``centroid_id`` is the valid centroid nearest to
    the most typical member, of equally near ones the smaller, null without any.
    """
    own = named.where(F.col("node").bitwiseAND(F.lit(1).cast("long")) == bit)
    full = members.join(own, "node", "left").select("id", F.coalesce("label", "node").alias("label"), F.coalesce("flow", F.lit(1.0)).alias("flow"), (F.col("node") == F.coalesce("attractor", "node")).alias("attracts"), (F.col("node") == F.coalesce("root", "node")).alias("heads"))
    sizes = full.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    order = Window.partitionBy("label").orderBy(F.desc("attracts"), F.desc("heads"), F.desc("flow"), "id")
    best = full.withColumn("place", F.row_number().over(order)).where(F.col("place") <= typical)
    lists = best.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("best"))
    found = cut(sizes.join(lists, "label").select(F.shiftright("label", 1).alias("cluster_key"), "size", F.transform("best", lambda b: b["id"]).alias("typical_ids")))
    valid = stored.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(is_valid_vector(F.col("v"), p.dimension))
    heads = valid.join(found.select(F.col("typical_ids")[0].alias("id")), "id", "left_semi").groupBy("id").agg(F.first("v").alias("v"))
    fixed = centroids.select(F.col(centroid_id).cast("long").alias("centroid_id"), F.col(centroid_col).alias("c")).where(F.col("centroid_id").isNotNull() & is_valid_vector(F.col("c"), p.dimension)).groupBy("centroid_id").agg(F.first("c").alias("c"))
    near = nearest_centroid(heads, fixed.withColumnRenamed("c", "centroid"), "id", "v").select("id", F.struct("distance", "centroid_id").alias("m"))
    return found.withColumn("id", F.col("typical_ids")[0]).join(near, "id", "left").select("cluster_key", "size", "typical_ids", F.col("m.centroid_id").alias("centroid_id"), F.col("m.distance").alias("distance"))


def flow_clusters(named: DataFrame, members: DataFrame, bit: int = 0, typical: int = 3) -> DataFrame:
    """(``attractor_id``, ``cluster_key``, ``size``, ``typical_ids``) of every flow cluster of one table.

    Markov clustering divides what similarity joins in long or loose chains, so a cluster (``cluster_key``, its
    smallest id) may hold several. ``size`` counts members, copies included; ``typical_ids`` are those of
    strongest flow, the attractor and roots of trees first. Vectors without a similar other are in none.
    """
    full = members.join(named.where(F.col("node").bitwiseAND(F.lit(1).cast("long")) == bit), "node")
    order = Window.partitionBy("attractor").orderBy((F.col("node") == F.col("attractor")).desc(), (F.col("node") == F.col("root")).desc(), F.desc("flow"), "id")
    best = full.withColumn("place", F.row_number().over(order)).where(F.col("place") <= typical)
    lists = best.groupBy("attractor").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("best"))
    sizes = full.groupBy("attractor").agg(F.count("*").alias("size"), F.min("label").alias("label"))
    return sizes.join(lists, "attractor").select(F.shiftright("attractor", 1).alias("attractor_id"), F.shiftright("label", 1).alias("cluster_key"), "size", F.transform("best", lambda b: b["id"]).alias("typical_ids"))
