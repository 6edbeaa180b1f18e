import os
import tracemalloc
from dataclasses import replace

import numpy as np
import pytest

from orrery.llm import cells, clusters, collisions, neighbours, subset

DIM = 8
P = neighbours.Similar(k=3, limit=4.0, dimension=DIM, cell_rows=20, block_rows=64)


def grouped(seed=0, groups=6, per=25, lone=20):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 12, (groups, DIM))
    x = np.concatenate([c + r.normal(0, 0.45, (per, DIM)) for c in centres] + [r.normal(0, 30, (lone, DIM))]).astype(np.float32)
    return x[r.permutation(len(x))]


def brute(q_ids, q, ids, x, k, limit, same):
    out = set()
    for i, v in zip(q_ids, q.astype(float)):
        d = ((x.astype(float) - v) ** 2).sum(1)
        order = [j for j in np.lexsort((ids, d)) if not (same and ids[j] == i)][:k]
        out |= {(int(i), rank, int(ids[j])) for rank, j in enumerate(order, 1) if limit is None or d[j] <= limit}
    return out


def test_block_equals_brute_force():
    x = grouped()
    ids = np.arange(len(x))
    for limit in (4.0, None):
        qi, bi, _ = collisions.Block(x, ids, collisions.Collisions()).search(x, ids, 3, limit)
        got, want = set(zip(qi.tolist(), bi.tolist())), {(a, c) for a, _, c in brute(ids, x, ids, x, 3, limit, True)}
        assert len(got & want) >= 0.97 * len(want) and len(got) <= len(want) + 5


def test_collisions_are_counted_bitwise():
    r = np.random.default_rng(2)
    for n in (1, 63, 64, 130, 700):
        x, q = r.normal(0, 1, (n, DIM)).astype(np.float32), r.normal(0, 1, (40, DIM)).astype(np.float32)
        block, half = collisions.Block(x, np.arange(n), collisions.Collisions()), 0.4
        got = set(zip(*(a.tolist() for a in block.collide(q @ block.a, half))))
        inside = (np.abs((q @ block.a)[:, None] - (x @ block.a)[None]) <= half).sum(2)
        step = ((x @ block.a).max(0) - (x @ block.a).min(0)) / block.c.steps
        wider = (np.abs((q @ block.a)[:, None] - (x @ block.a)[None]) <= half + step * 1.01 + 1e-5).sum(2)
        enough = lambda c: set(zip(*(a.tolist() for a in np.nonzero(c >= block.c.threshold))))
        assert enough(inside) <= got <= enough(wider)
    masks = [r.integers(0, 1 << 63, (3, 2), dtype=np.uint64) for _ in range(16)]
    bits = sum(np.unpackbits(m.view(np.uint8), axis=1, bitorder="little").astype(int) for m in masks)
    for threshold in (1, 7, 10, 16):
        assert (np.unpackbits(collisions.at_least(masks, threshold).view(np.uint8), axis=1, bitorder="little") == (bits >= threshold)).all()


def test_bridges_join_groups_that_lists_miss():
    x = np.array([[0.0] * 8] * 3 + [[1.0] + [0.0] * 7] * 3, dtype=np.float32) + np.random.default_rng(1).normal(0, 1e-3, (6, 8)).astype(np.float32)
    ids = np.arange(6)
    block = collisions.Block(x, ids, collisions.Collisions())
    qi, bi, _ = block.search(x, ids, 2, 2.0)
    label = collisions.components(6, qi, bi)
    assert len(set(label)) == 2
    at, other, _ = collisions.bridges(block, x, np.arange(6), label, label, 2.0)
    assert len(at) == 1 and label[at[0]] != label[other[0]]


@pytest.fixture(scope="module")
def rows():
    x = grouped(3)
    rows = [(i + 1, v) for i, v in enumerate(x.tolist())]
    rows += [(1_000 + i, x[5].tolist()) for i in range(7)]  # more copies than k + 1
    return rows


DIRTY = [(None, [0.0] * DIM), (9_001, None), (9_002, []), (9_003, [1.0] * 3), (9_004, [float("nan")] * DIM), (9_005, [float("inf")] + [0.0] * (DIM - 1)), (9_006, [None] + [0.0] * (DIM - 1))]


def listed(df):
    return {(r["query_id"], r["rank"], r["neighbour_id"]) for r in df.collect()}


@pytest.mark.parametrize("p", [P, replace(P, block_rows=2), replace(P, region_cells=2, spread=0.5), replace(P, region_cells=2, wave_cells=3, spread=0.5), replace(P, limit=None, spread=5.0)])
def test_most_similar(spark, vectors, rows, p):
    q = [(i + 1, rows[i * 4][1]) for i in range(20)] + [(1, rows[0][1])]
    requests = spark.createDataFrame(q + DIRTY, f"query_id long, query array<float>")
    found = neighbours.most_similar(vectors(rows + rows[:9] + DIRTY).repartition(3), requests, p).cache()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32)
    want = brute(ids, x, ids, x, 3, p.limit, True)
    got = listed(found.where("origin = 'stored'"))
    assert len(got & want) >= 0.97 * len(want) and len(got) <= len(want) * 1.03
    assert {g for g in got if g[0] >= 1_000} == {w for w in want if w[0] >= 1_000}  # copies, exactly
    asked = brute(np.arange(1, 21), np.array([v for _, v in q[:20]], dtype=np.float32), ids, x, 3, p.limit, False)
    assert len(listed(found.where("origin = 'request'")) & asked) >= 0.95 * len(asked)
    pairs = neighbours.similar_pairs(found)
    assert pairs.count() == pairs.distinct().count()


def test_layout_does_not_matter_and_empty(spark, vectors, rows):
    a = listed(neighbours.most_similar(vectors(rows), None, P))
    assert a == listed(neighbours.most_similar(vectors(rows[::-1]).repartition(5), None, P))
    assert neighbours.most_similar(vectors([]), None, P).count() == 0
    with pytest.raises(Exception, match="62 bits"):
        neighbours.most_similar(vectors([(1 << 62, [0.0] * DIM)]), None, P).count()


def components(ids, x, limit):
    n2 = ((x[:, None].astype(float) - x[None]) ** 2).sum(-1)
    a, b = np.nonzero(n2 <= limit)
    label = collisions.components(len(x), a, b)
    return {(int(min(ids[label == g])), int(i)) for g in set(label) if (label == g).sum() >= 3 for i in ids[label == g]}


def test_clusters_equal_components(spark, vectors, rows):
    chain = [(5_000 + i, [100.0 + 1.9 * i] + [0.0] * (DIM - 1)) for i in range(30)]  # a long thin cluster
    pair = [(6_000 + i, [500.0] * DIM) for i in range(2)]
    many = [(7_000 + i, [300.0] * DIM) for i in range(5)]  # copies alone make a cluster
    every = rows + chain + pair + many
    centroids = spark.createDataFrame([(1, [float(i)] + [0.0] * (DIM - 1)) for i in range(1)] + [(2, [0.5] + [0.0] * (DIM - 1)), (3, [1.0] + [0.0] * (DIM - 1)), (9, [99.0] * DIM), (4, [])], "centroid_id int, vector array<double>")
    tables = [(vectors(every + DIRTY), "id", "data", 0), (centroids, "centroid_id", "vector", 1)]
    named, _ = clusters.clustered(tables, P)
    parts = [neighbours.members(df, i, v, P, bit) for df, i, v, bit in tables]
    got = {tuple(r) for r in clusters.cluster_members(named, parts[0].unionByName(parts[1])).collect()}
    ids, x = np.array([r[0] for r in every]), np.array([r[1] for r in every], dtype=np.float32)
    assert {g[1:] for g in got if g[0] == 0} == components(ids, x, 4.0)
    assert {g[1:] for g in got if g[0] == 1} == {(1, 1), (1, 2), (1, 3)}


def strings_of_beads(step=1.7, beads=40, per=12, seed=4):
    """Tight groups with many nearer others each, every one joined to the next only by pairs of nearly the limit."""
    r = np.random.default_rng(seed)
    way = r.normal(0, 1, (beads, DIM))
    centres = np.cumsum(way / np.linalg.norm(way, axis=1)[:, None] * step, axis=0)
    x = np.concatenate([c + r.normal(0, 0.03, (per, DIM)) for c in centres] + [r.normal(0, 0.03, (per, DIM)) + 60]).astype(np.float32)
    return np.arange(1, len(x) + 1), x


def graph_groups(vectors, ids, x, p):
    """Components of three or more by the edges of the similarity graph, as (smallest id, id)."""
    rows = clusters.similarity_graph([(vectors(list(zip(ids.tolist(), x.tolist()))), "id", "data", 0)], p).collect()
    assert all(len(r["near"]) <= p.k for r in rows) and {n for r in rows for n in [*r["near"], *r["links"]]} <= {r["node"] for r in rows}
    edges = np.array([(r["node"] >> 1, n >> 1) for r in rows for n in [*r["near"], *r["links"]]]) - 1
    label = collisions.components(len(x), edges[:, 0], edges[:, 1])
    return {(int(min(ids[label == g])), int(i)) for g in set(label) if (label == g).sum() >= 3 for i in ids[label == g]}


def test_links_survive_the_cut_of_merged_lists(vectors):
    ids, x = strings_of_beads()
    p = neighbours.Similar(k=3, limit=4.0, dimension=DIM, cell_rows=20, block_rows=64, spread=5.0)
    assert graph_groups(vectors, ids, x, p) == components(ids, x, 4.0)


@pytest.mark.parametrize("more", [{"block_rows": 2}, {"block_rows": 64}, {"region_cells": 2}, {"region_cells": 3, "wave_cells": 4}])
def test_tight_groups_in_cells_of_their_own_are_compared(vectors, more):
    r = np.random.default_rng(6)
    ids, x = strings_of_beads(step=1.9, beads=2, per=20)
    x = np.concatenate([x[:40] + s for s in r.normal(0, 30, (10, DIM)).astype(np.float32)])
    p = replace(P, **more)
    assert graph_groups(vectors, np.arange(1, len(x) + 1), x, p) == components(np.arange(1, len(x) + 1), x, 4.0)


def test_spanning_joins_what_pairs_join():
    label = collisions.components(6, np.array([0]), np.array([1]))
    a, b, d = np.array([0, 1, 2, 3, 1]), np.array([1, 2, 3, 1, 3]), np.array([0.1, 1.0, 2.0, 3.0, 3.0])
    assert sorted(collisions.spanning(label, a, b, d)) == [1, 2]


def graph(spark, pairs):
    return spark.createDataFrame([(a, b, w) for x, y, w in pairs for a, b in ((x, y), (y, x))], "a long, b long, w double")


def test_flow_divides_and_levels_join(spark):
    dense = lambda at: [(at + i, at + j, 1.0) for i in range(6) for j in range(i)]
    pairs = [*dense(0), *dense(10), *dense(20), (5, 10, 0.05), (15, 20, 0.05), (30, 31, 1.0)]
    flows, tops = clusters.levels(graph(spark, pairs), clusters.Markov())
    first, top = ({r["j"]: r[1] for r in df.collect()} for df in (flows, tops))
    groups = lambda named: {frozenset(j for j in named if named[j] == a) for a in named.values()}
    assert groups(first) == {frozenset(range(s, s + 6)) for s in (0, 10, 20)} | {frozenset((30, 31))}
    assert groups(top) == {frozenset(j for j in first if j < 30), frozenset((30, 31))}


def test_a_ring_of_equal_edges_ends(spark):
    _, tops = clusters.levels(graph(spark, [(i, (i + 1) % 40, 1.0) for i in range(40)]), clusters.Markov())
    assert len({r["top"] for r in tops.collect()}) == 1 and tops.count() == 40


def test_flow_clusters(spark, vectors, rows):
    named, _ = clusters.clustered([(vectors(rows + DIRTY), "id", "data", 0)], P)
    found = clusters.flow_clusters(named, neighbours.members(vectors(rows + DIRTY), "id", "data", P)).collect()
    members = neighbours.members(vectors(rows + DIRTY), "id", "data", P).join(named, "node")
    assert sum(r["size"] for r in found) == members.count() and all(1 <= len(r["typical_ids"]) <= 3 for r in found)
    assert len({r["attractor_id"] for r in found}) == len(found)


def test_a_hot_column_is_split(spark):
    """Most columns hold one row of the matrix; the join on it is split, not left to one task."""
    from pyspark.sql import functions as F

    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        part = lambda i: F.array(F.struct(F.lit(0.5).alias("v"), i.alias("i")), F.struct(F.lit(0.5).alias("v"), F.col("id").alias("i")))
        matrix = spark.range(60_000, numPartitions=4).select(F.col("id").alias("j"), part(F.lit(7).cast("long")).alias("rows"))
        squared = clusters._squared(matrix, clusters.Markov())
        assert squared.count() == 60_000
        squared.collect()
        assert "skew=true" in squared._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_clusters_of_nothing(spark, vectors):
    named, _ = clusters.clustered([(vectors([]), "id", "data", 0)], P)
    assert named.count() == 0


def test_farthest_first():
    x = np.array([[0.0, 0], [0.1, 0], [10, 0], [0, 10], [0, 10]])
    at, radii = subset.farthest_first(x, np.arange(5), 5)
    assert len(at) == 4 and radii[0] == np.inf and (np.diff(radii) <= 0).all()
    assert {int(i) for i in at[:3]} in ({0, 2, 3}, {1, 2, 3})


def test_varied_subset(spark, vectors, rows):
    p = subset.Varied(share=0.1, partition_rows=64)
    got = subset.varied_subset(vectors(rows + DIRTY), p, P).collect()
    distinct = len({tuple(v) for _, v in rows})
    assert len(got) == round(0.1 * distinct) and len({r["id"] for r in got}) == len(got)
    where = {i: np.array(v) for i, v in rows}
    chosen = np.array([where[r["id"]] for r in got])
    cover = lambda c: max(((c - v) ** 2).sum(1).min() for v in where.values())
    random = [np.array([where[i] for i in np.random.default_rng(s).choice(list(where), len(got), replace=False)]) for s in range(5)]
    assert cover(chosen) <= min(cover(c) for c in random)
    assert subset.varied_subset(vectors([]), p, P).count() == 0
    assert subset.varied_subset(vectors([(4, [1.0] * DIM), (3, [1.0] * DIM)]), p, P).select("id").collect()[0]["id"] == 3


def test_recall_at_a_tenth(spark):
    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("the test tables aren't here")
    table = spark.read.parquet(f"{data}/vectors.parquet")
    valid = {r["id"]: r["data"] for r in table.collect() if r["data"] is not None and len(r["data"]) == 64 and all(v is not None and np.isfinite(v) for v in r["data"])}
    ids = np.array(sorted(valid))
    x = np.array([valid[i] for i in ids], dtype=np.float32)
    want = {(a, c) for a, _, c in brute(ids, x, ids, x, 10, 8.0, True)}
    got = {(r["query_id"], r["neighbour_id"]) for r in neighbours.most_similar(table).collect()}
    assert len(got & want) >= 0.999 * len(want)


def test_hot_copies_leave_the_task_once():
    seen = neighbours._Seen(3)
    ends, ids = seen.wanted([b"a", b"b"], np.array([0, 3, 4]), np.array([5, 6, 7, 1]))
    assert ids.tolist() == [5, 6, 7, 1]
    ends, ids = seen.wanted([b"a", b"b"], np.array([0, 3, 4]), np.array([2, 8, 9, 3]))
    assert ends.tolist() == [0, 1, 2] and ids.tolist() == [2, 3]


def test_waves_cover_all_regions():
    starts = np.array([0, 4, 5, 9, 10])
    c = cells.Cells(*([np.zeros((4, 2), np.float32), np.zeros(4), starts] + [np.zeros((10, 2), np.float32)] + [np.zeros(10, int)] * 6))
    assert c.waves(6) == [(0, 2), (2, 4)] and c.waves(100) == [(0, 4)] and c.waves(1) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert len(c.wave(2, 4).centres) == 5


def test_subset_covers_like_central_greedy(spark):
    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("the test tables aren't here")
    table = spark.read.parquet(f"{data}/vectors.parquet")
    valid = {r["id"]: r["data"] for r in table.collect() if r["data"] is not None and len(r["data"]) == 64 and all(v is not None and np.isfinite(v) for v in r["data"])}
    x = np.unique(np.array(list(valid.values()), dtype=np.float32), axis=0).astype(float)
    chosen = np.array([valid[r["id"]] for r in subset.varied_subset(table).collect()], dtype=float)
    cover = lambda c: np.sqrt(np.min((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None], axis=1).max())
    greedy, _ = subset.farthest_first(x, np.arange(len(x)), len(chosen))
    assert len(chosen) == round(0.02 * len(x)) and cover(chosen) <= 1.05 * cover(x[greedy])


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_routing_holds_few_rows_against_all_cells(monkeypatch):
    r = np.random.default_rng(5)
    centres, x = (r.normal(0, 4, (n, DIM)).astype(np.float32) for n in (2_000, 6_000))
    one = np.ones(len(centres), int)
    c = cells.Cells(centres.mean(axis=0)[None], np.full(1, np.inf), np.array([0, len(centres)]), centres, np.full(len(centres), 9.0, np.float32), one, one, one, one, one)
    found, mb = peak_mb(lambda: c.visits(x, 0.14, 1.0, True))
    assert mb < 120  # 301 when a whole batch is compared at once
    monkeypatch.setattr(cells, "PAIRS_AT_ONCE", 1 << 40)
    assert all(np.array_equal(a, b) for a, b in zip(found, c.visits(x, 0.14, 1.0, True)))


def test_equal_rows_are_found_without_copies_of_all(monkeypatch):
    r = np.random.default_rng(8)
    x = r.normal(0, 1, (40_000, 64)).astype(np.float32)
    x[30_000:] = x[r.integers(0, 30_000, 10_000)]
    key = np.stack([np.arange(len(x)) % 2, np.zeros(len(x), int)], axis=1)
    packed = neighbours._Packed(neighbours.pa.chunked_array([neighbours._pack(p) for p in np.array_split(x, 7)]), 64)
    (first, label), mb = peak_mb(lambda: neighbours._same(packed, key))
    assert mb < 1.5 * x.nbytes / 1e6 and (packed[first[label]] == x).all() and (key[first[label]] == key).all()
    whole = np.unique(np.concatenate([x.view(np.int32).astype(int), key], axis=1), axis=0)
    assert len(first) == len(whole) and len(set(first.tolist())) == len(first) and (np.diff(np.sort(label)) <= 1).all()
    monkeypatch.setattr(neighbours, "_ODD", np.zeros_like(neighbours._ODD))  # all rows have one hash
    again, at = neighbours._same(packed[:3_000], key[:3_000])
    assert len(again) == 3_000 and (again[at] == np.arange(3_000)).all()


def test_a_block_is_answered_in_little_memory():
    r = np.random.default_rng(9)
    centres = r.normal(0, 3, (100, 64)).astype(np.float32)
    x = (centres[r.integers(0, 100, 30_000)] + r.normal(0, 0.6, (30_000, 64))).astype(np.float32)
    one, p = np.ones(100, int), neighbours.Similar(k=6)
    c = cells.Cells(centres.mean(axis=0)[None], np.full(1, np.inf), np.array([0, 100]), centres, np.full(100, 6.0, np.float32), one, one, 0 * one, one, one)
    pa = neighbours.pa
    n = lambda v: pa.array(np.full(len(x), v), pa.int64())
    batch = pa.RecordBatch.from_arrays([n(0), n(3), n(0), pa.array(np.arange(len(x))), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 64), pa.int32()), pa.array(x.ravel()))], names=["space", "role", "bit", "id", "data"])
    table = pa.Table.from_batches(list(neighbours._route(iter([batch.slice(s, 5_000) for s in range(0, len(x), 5_000)]), {0: c}, p, True, True)))
    _, mb = peak_mb(lambda: neighbours._answer(table, p, True))
    assert table.num_rows == len(x) and mb < 4 * x.nbytes / 1e6


def test_a_written_table_leaves_no_shuffle_files(spark):
    from pathlib import Path

    from pyspark.sql import functions as F

    from orrery.session import CLEANUP, cut

    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*")}
    before, asked = files(), spark.conf.get(CLEANUP)
    kept = cut(spark.range(50_000).groupBy(F.pmod(F.xxhash64("id"), F.lit(7)).alias("k")).count())
    assert not files() - before and spark.conf.get(CLEANUP) == asked
    assert kept.count() == 7


def test_settled_columns_are_kept_whether_the_others_are_few_or_not(spark):
    rows = [(1, [(1.0, 9)]), (2, [(0.95, 9), (0.05, 1)]), (3, [(0.5, 1), (0.5, 2)]), (9, [(1.0, 9)])]
    matrix = spark.createDataFrame(rows, "j long, rows array<struct<v: float, i: long>>")
    want = {1: [(1.0, 9)], 2: [(1.0, 9)], 9: [(1.0, 9)]}
    for few in (False, True):
        squared = clusters._squared(matrix, clusters.Markov(), few)
        got = {r["j"]: [tuple(e) for e in r["rows"]] for r in squared.collect()}
        assert {j: got[j] for j in want} == want and got[3][0][1] == 9 and len(got) == 4
        plan = squared._jdf.queryExecution().executedPlan().toString()
        assert "Union" in plan.split("Exchange")[0]  # settled columns join in after the last shuffle
