import os

import numpy as np
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SAMPLE = ["exact_knn_single", "centroid_means", "lloyd_fixed_iters", "hierarchical_assign", "ivf_search_nprobe_4", "search_padded", "p2_found", "p2_counts"]


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    got = entry.queries()[name](spark, DATA)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda r: tuple(None if v is None else float(v) for v in r)
    key = lambda r: tuple((v is None, v or 0.0) for v in r)
    assert sorted(map(plain, got.collect()), key=key) == sorted(map(plain, want), key=key)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
def test_every_50th_row_is_asked(spark):
    ids = {r["vec_id"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()}
    truth, found = (entry.queries()[f"{name}_every_50th"](spark, DATA).collect() for name in ("exact_knn_batch", "ivf_search_all_probes_equals_exact"))
    assert {r["query_id"] for r in truth} == ids and {tuple(r) for r in truth} == {tuple(r) for r in found}


def test_recall_of_the_built_index(spark, tmp_path):
    x = np.random.default_rng(5).normal(0, 1, (2_000, 64)).tolist()  # no clusters, so that few probes find little
    spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    truth, found = ({(r["query_id"], r["external_id"]) for r in entry.queries()[n](spark, str(tmp_path)).collect()} for n in ("exact_knn_batch_every_50th", "ivf_build_minibatch"))
    assert len({q for q, _ in found}) == 40 and len(truth & found) >= 0.9 * len(truth)
