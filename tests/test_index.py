import shutil

import numpy as np
import pytest

from orrery import api
from orrery.operators import evaluate, index, knn, search
from orrery.schema import IndexConfig, InvalidInput, NotFound, SearchRequest, with_ordinals


def cluster_rows(groups=5, per=40, dim=16, seed=2):
    r = np.random.default_rng(seed)
    x = np.concatenate([c * 20 + np.arange(dim) * 0.1 + r.uniform(-0.5, 0.5, (per, dim)) for c in range(groups)]).astype(np.float32)
    return x, [(i, v, None if i % 2 else 1_600_000_000 + i) for i, v in enumerate(x.tolist())]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("index")
    x, rows = cluster_rows()
    config = IndexConfig(16, f"{root}/index", f"{root}/shards", max_k=150)
    return x, api.Indexer(config, spark).build_from_records(rows)


def test_defaults_and_builders():
    c = IndexConfig(8)
    assert (c.default_k, c.default_n_probe, c.max_k, c.max_n_probe) == (10, 20, 10_000, 10_000)
    assert c.with_index_dir("a").with_shards_dir("b") == IndexConfig(8, "a", "b")
    r = SearchRequest((1.0,)).with_k(3).with_n_probe(2).with_include_vectors(True)
    assert (r.k, r.n_probe, r.include_vectors) == (3, 2, True)
    assert c.clamp(99_999, 99_999) == (10_000, 10_000)


def test_structure(built):
    x, ix = built
    assert evaluate.structure_violations(ix.index).first().asDict() == {"dimensions": 0, "shards": 0, "rows": len(x), "sizes": 0}
    ids = [r["centroid_id"] for r in ix.index.centroids.orderBy("centroid_id").collect()]
    assert ids == list(range(len(ids)))
    assert {(r["id"], r["external_id"]) for r in ix.index.postings.select("id", "external_id").collect()} == {(i, i) for i in range(len(x))}
    assert ix.index.postings.where("timestamp is null or timestamp = 0").count() == 0


def test_self_hit_order_and_vectors(built):
    x, ix = built
    got = ix.search(SearchRequest(tuple(x[17].tolist()), 5, 50, True))
    assert got[0].external_id == 17 and got[0].distance < 1e-9 and np.allclose(got[0].vector, x[17])
    assert [g.distance for g in got] == sorted(g.distance for g in got) and len(got) == 5
    assert ix.search(SearchRequest(tuple(x[17].tolist()), 5, 50))[0].vector is None


def test_all_probes_equal_exact_and_recall_grows(spark, built):
    x, ix = built
    q = spark.createDataFrame([(i, x[i * 9].tolist()) for i in range(20)], "query_id long, query array<float>")
    base = spark.createDataFrame(list(zip(range(len(x)), x.tolist())), "external_id long, values array<float>")
    truth = knn.exact_batch(base, q, 10)
    every = ix.search_batch(q, 10, 10_000)
    assert {(r["query_id"], r["rank"], r["external_id"]) for r in every.collect()} == {(r["query_id"], r["rank"], r["external_id"]) for r in truth.collect()}
    averages = [np.mean([r["recall"] for r in evaluate.recall(truth, ix.search_batch(q, 10, n)).collect()]) for n in (1, 3, 15)]
    assert averages == sorted(averages) and averages[-1] >= 0.7
    assert [r["recall"] for r in evaluate.first_recall(truth, every, (1, 10, 100), 10).orderBy("rank").collect()] == [1.0, 1.0]
    assert evaluate.intersection(truth, every, 10).first()[0] == 1.0


def test_limits_and_errors(spark, built, tmp_path):
    x, ix = built
    q = spark.createDataFrame([(0, x[0].tolist())], "query_id long, query array<float>")
    assert ix.search_batch(q, 100_000, 100_000).count() == 150  # cut to max_k
    for k, n in ((0, 1), (1, 0)):
        with pytest.raises(InvalidInput):
            ix.search_batch(q, k, n)
    with pytest.raises(InvalidInput):
        ix.search(SearchRequest((1.0, 2.0)))
    with pytest.raises(InvalidInput):
        ix.search_batch(spark.createDataFrame([(0, [1.0])], "query_id long, query array<float>"))
    with pytest.raises(InvalidInput):
        index.load(spark, IndexConfig(5, ix.config.index_dir, ix.config.shards_dir))
    with pytest.raises(FileNotFoundError):
        index.load(spark, IndexConfig(16, str(tmp_path / "none"), str(tmp_path)))
    fresh = api.Indexer(IndexConfig(2, f"{tmp_path}/i", f"{tmp_path}/s"), spark)
    for rows in ([], [(1, [1.0], None)], [(1, [1.0, float("nan")], None)], [((1 << 64) - 1_001, [1.0, 2.0], None)]):
        with pytest.raises(InvalidInput):
            fresh.build_from_records(rows)


def test_selective_scan(built):
    _, ix = built
    row = ix.index.centroids.orderBy("centroid_id").first()
    got = ix.index.posting_scan(row["shard_id"], [row["centroid_id"]])
    assert got.count() == row["n_vectors"]
    with pytest.raises(NotFound):
        ix.index.posting_scan(row["shard_id"], [10_000])
    with pytest.raises(NotFound):
        ix.index.posting_scan(10_000)


def test_missing_shard(spark, tmp_path):
    x, rows = cluster_rows(3, 30)
    config = IndexConfig(16, f"{tmp_path}/index", f"{tmp_path}/shards")
    ix = api.Indexer(config, spark).build_from_records(rows)
    shard = ix.index.centroids.first()["shard_id"]
    shutil.rmtree(f"{tmp_path}/shards/lists/shard_id={shard}")
    q = spark.createDataFrame([(0, x[0].tolist())], "query_id long, query array<float>")
    loaded = index.load(spark, config)
    with pytest.raises(NotFound):
        search.search(loaded, q, 5, 100)
    assert search.search(loaded, q, 5, 100, on_missing_shard="skip").count() <= 5


def test_arrays_and_async(spark, tmp_path):
    import asyncio

    x, _ = cluster_rows(2, 10)
    ix = api.build(x, spark, str(tmp_path))
    d, i = ix.search_sync(x[:3], 30, 100)
    assert d.shape == i.shape == (3, 30) and d.dtype == np.float32 and i.dtype == np.int64
    assert i[:, 0].tolist() == [0, 1, 2] and (i[:, 20:] == -1).all() and np.isinf(d[:, 20:]).all()
    ix.nprobe = 100
    assert (ix.search(x[:3], 5)[1] == asyncio.run(ix.search_async(x[:3], 5, 100))[1]).all()
    again = api.load(f"{tmp_path}/index", f"{tmp_path}/shards", 16, spark)
    assert again.dimension == again.d == 16 and (again.search_sync(x[:3], 5, 100)[1] == i[:, :5]).all()


def test_sql_functions(spark, built):
    x, ix = built
    api.register_sql(spark, ix)
    assert spark.sql("SELECT l2_squared(array(1D, 2D), array(3D, 2D)) d").first()["d"] == 4.0
    query = ", ".join(f"{v}D" for v in x[3].astype(float))
    got = spark.sql(f"SELECT * FROM ann_search(array({query}), 3, 100)").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and got[0]["external_id"] == 3


def test_single_vector_and_ordinals(spark, tmp_path):
    ix = api.build(np.array([[1.0, 2, 3, 4]]), spark, str(tmp_path))
    assert ix.search_sync(np.array([[1.1, 2.1, 3.1, 4.1]]), 3, 10)[1].tolist() == [[0, -1, -1]]
    df = spark.createDataFrame([(i * 3, [float(i)]) for i in range(50)], "external_id long, values array<float>").repartition(5)
    assert [(r["id"], r["external_id"]) for r in with_ordinals(df).orderBy("id").collect()] == [(i, i * 3) for i in range(50)]


def test_search_opens_only_the_probed_shards(spark, built):
    x, ix = built
    one = ix.index.centroids.orderBy("centroid_id").first()
    q = spark.createDataFrame([(0, [float(v) for v in one["centroid"]])], "query_id long, query array<float>")
    found = ix.search_batch(q, 3, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "centroid_id" in plan.split("PushedFilters: [")[1].split("]")[0] and found.count() == 3


def test_searches_in_blocks_agree(spark, built, monkeypatch):
    x, ix = built
    q = spark.createDataFrame([(i, x[i * 7].tolist()) for i in range(25)] + [(30, x[3].tolist()), (31, x[3].tolist())], "query_id long, query array<float>")
    base = spark.createDataFrame(list(zip(range(len(x)), x.tolist())) + [(900 + i, x[3].tolist()) for i in range(12)], "external_id long, values array<float>")
    every = lambda: [sorted(map(tuple, df.collect())) for df in (knn.exact_batch(base, q, 5), ix.search_batch(q, 5, 4), knn.probes(q, ix.index.centroids, 3), knn.nearest_centroid(base, ix.index.centroids, "external_id", "values"))]
    whole = every()
    monkeypatch.setattr(knn, "BLOCK_BYTES", 700)
    parts = every()
    for a, b in zip(whole, parts):
        assert [r[:3] for r in a] == [r[:3] for r in b] or np.allclose(np.array(a, float), np.array(b, float))
    tied = [r for r in whole[0] if r[0] == 30]
    assert [r[2] for r in tied] == [3, 900, 901, 902, 903]  # of equal distances the smaller id


def test_exact_assignment_is_selectable(spark, tmp_path):
    x = np.random.default_rng(8).normal(0, 1, (400, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "external_id long, values array<float>")
    ix = index.fit(rows, IndexConfig(4, f"{tmp_path}/i", f"{tmp_path}/s"), k=130, hierarchy=False)
    best = knn.nearest_centroid(ix.postings, ix.centroids, "external_id", "values").withColumnRenamed("centroid_id", "best")
    assert best.join(ix.postings, "external_id").where("best != centroid_id").count() == 0
