import numpy as np
import pytest

from orrery.functions.kernels import nearest
from orrery.operators import kmeans as km
from orrery.schema import InvalidInput


def clusters(groups=4, per=60, dim=8, apart=25.0, seed=1):
    r = np.random.default_rng(seed)
    return np.concatenate([c * apart + np.arange(dim) * 0.1 + r.uniform(-0.5, 0.5, (per, dim)) for c in range(groups)])


def inertia(x, c, label):
    return float(((x - c[label]) ** 2).sum())


def test_heuristics():
    assert [km.suggest_nlist(n) for n in (1, 50, 9_999, 10_000, 99_999, 100_000, 1_000_000)] == [1, 7, 99, 200, 634, 1_268, 4_000]
    assert [km.suggest_iterations(n) for n in (1, 9_999, 10_000, 100_000, 1_000_000)] == [300, 300, 100, 50, 20]
    assert [km.batch_size(n) for n in (3, 50, 500, 1_000_000)] == [3, 10, 22, 256]


@pytest.mark.parametrize("fit", [km.full_batch, km.mini_batch])
def test_recovers_clusters_and_is_optimal(fit):
    x = clusters()
    c, label = fit(x, 4, 100, seed=42)
    assert (label == nearest(x, c)).all() and label.min() >= 0 and label.max() < 4
    assert all(len(set(label[g * 60 : g * 60 + 60])) == 1 for g in range(4)) or inertia(x, c, label) < 1.5 * inertia(x, *km.full_batch(x, 4, 100, seed=7))


@pytest.mark.parametrize("fit", [km.full_batch, km.mini_batch])
def test_edges(fit):
    with pytest.raises(InvalidInput):
        fit(np.zeros((0, 3)), 2, 5)
    assert len(fit(np.arange(15.0).reshape(5, 3), 10, 5)[0]) == 10  # more clusters than rows
    c, label = fit(np.array([[1.0, 2, 3]] * 3 + [[10.0, 20, 30]] * 2), 2, 50)
    assert inertia(np.array([[1.0, 2, 3]] * 3 + [[10.0, 20, 30]] * 2), c, label) < 600


def test_one_cluster_is_the_mean_and_same_seed_same_result():
    x = clusters(1, 30, 3)
    assert np.allclose(km.full_batch(x, 1, 10)[0][0], x.mean(0))
    assert np.array_equal(km.mini_batch(x, 3, 30, seed=5)[0], km.mini_batch(x, 3, 30, seed=5)[0])


def test_mini_batch_step():
    state = km.MiniBatch(np.array([[0.0], [10.0]]), np.array([1, 0]))
    state.update(np.array([[1.0], [3.0]]))
    assert state.centroids.ravel().tolist() == [1.0, 10.0] and state.hits.tolist() == [2, 0]


def test_hierarchy_agrees_with_brute_force():
    x = clusters(200, 50, 8, 5.0)
    c = km.seed_centroids(x, 200, np.random.default_rng(1))
    h = km.Hierarchy.fit(c)
    assert (h.assign(x) == nearest(x, c)).mean() >= 0.95


def test_distributed_assignment_and_means(spark):
    x = clusters(3, 40, 5)
    df = spark.createDataFrame(list(zip(range(len(x)), x.tolist())), "id long, values array<float>").repartition(3)
    c, _ = km.full_batch(x, 3, 20)
    got = {r["id"]: r["centroid_id"] for r in km.assign(df, c).collect()}
    want = nearest(x.astype(np.float32).astype(float), c)
    assert [got[i] for i in range(len(x))] == want.tolist()
    mean, n = km.lloyd_round(df, c)
    assert n.tolist() == np.bincount(want, minlength=3).tolist() and np.allclose(mean, km.means(x, want, 3, c)[0], atol=1e-5)
    assert np.array_equal(km.bounded_sample(df, 20, len(x), "id"), km.bounded_sample(df.repartition(7), 20, len(x), "id"))
