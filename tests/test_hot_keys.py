import numpy as np
import pytest

from orrery.operators import hot_keys as hk


@pytest.fixture(scope="module")
def skewed(spark):
    r = np.random.default_rng(3)
    rows = [(None if i % 50 == 0 else ("hot" if i % 3 else f"k{i % 7}"), int(r.integers(-(1 << 40), 1 << 40)) if i % 11 else None) for i in range(3_000)]
    return spark.createDataFrame(rows + rows[:400], "key string, v long").withColumnRenamed("v", "value"), rows + rows[:400]


def _quantile(values, share):
    values = sorted(values)
    return values[max(1, int(np.ceil(round(share * len(values), 6)))) - 1]


@pytest.mark.parametrize("s", [hk.Selection(bins=16), hk.Selection(bins=5, broadcast_rows=0, salts=4)])
def test_quantiles_equal_sorting(skewed, s):
    df, rows = skewed
    got = {(r["key"], r["share"]): r["value"] for r in hk.quantiles_per_key(df, ["key"], "value", [0.0, 0.25, 0.5, 1.0], s).collect()}
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key and v is not None]
        for share in (0.0, 0.25, 0.5, 1.0):
            assert got.pop((key, share)) == _quantile(values, share)
    assert not got


def test_ranks_with_ties_and_beyond(spark):
    df = spark.createDataFrame([("a", 5)] * 4 + [("a", 255), ("a", 256)] + [("b", 1)], "k string, v int")
    ranks = spark.createDataFrame([("a", 1), ("a", 4), ("a", 5), ("a", 6), ("a", 7), ("b", 1), ("c", 1), ("a", 0)], "k string, rank long")
    got = {(r["k"], r["rank"]): (r["value"], r["below"], r["at"]) for r in hk.select_ranks(df, ["k"], "v", ranks).collect()}
    assert got == {("a", 1): (5, 0, 4), ("a", 4): (5, 0, 4), ("a", 5): (255, 4, 1), ("a", 6): (256, 5, 1), ("b", 1): (1, 0, 1)}


def test_heavy_values_and_counts(spark):
    rows = [(0, 7, i) for i in range(50)] + [(0, 8, i) for i in range(50, 53)] + [(0, None, i) for i in range(53, 60)] + [(0, 7, 1)] * 5 + [(None, 1, 1), (1, 2, None)]
    df = spark.createDataFrame(rows, "load int, centroid int, id int")
    got = {(r["load"], r["value"], r["members"], r["of"]) for r in hk.heavy_values(df, ["load"], "centroid", "id", 0.05).collect()}
    assert got == {(0, 7, 50, 60), (None, 1, 1, 1)}
    counts = {(r["load"], r["centroid"]): r["n"] for r in hk.distinct_per_key(df, ["load", "centroid"], "id").collect()}
    assert counts == {(0, 7): 50, (0, 8): 3, (0, None): 7, (None, 1): 1}


def test_empty_table(spark):
    df = spark.createDataFrame([], "load int, centroid int, id int")
    assert hk.heavy_values(df, ["load"], "centroid", "id", 0.04).count() == 0
    assert hk.quantiles_per_key(df, ["load"], "id", [0.5]).count() == 0
    with pytest.raises(ValueError):
        hk.quantiles_per_key(df, ["load"], "id", [1.5])


def test_recorded_lists_without_postings_stand_with_0(spark, tmp_path):
    from orrery.plans.hot_keys import queries

    spark.createDataFrame([(0, 7, 1), (0, 7, 2), (0, None, 3)], "load_no int, centroid_id int, id long").write.parquet(f"{tmp_path}/postings.parquet")
    spark.createDataFrame([(0, 7, 5), (0, 8, 4), (0, None, 9)], "load_no int, centroid_id int, num_vectors long").write.parquet(f"{tmp_path}/centroid_index.parquet")
    got = {tuple(r) for r in queries()["p2_counts_recorded"](spark, str(tmp_path)).collect()}
    assert got == {(0, 7, 2, 5, 5), (0, 8, 0, 4, 4), (0, None, 1, 9, 9)}
