import struct

import numpy as np
import pytest

from orrery import api
from orrery.operators import evaluate
from orrery.schema import IndexConfig, InvalidInput
from orrery.sources import files, generate
from orrery.streaming.search import search_stream


def test_vecs_and_npy(spark, tmp_path):
    x = np.arange(35, dtype=np.float32).reshape(7, 5)
    files.write_vecs(f"{tmp_path}/a.fvecs", x)
    files.write_vecs(f"{tmp_path}/a.ivecs", x.astype(np.int32))
    np.save(f"{tmp_path}/a.npy", x)
    for kind in ("fvecs", "ivecs", "npy"):
        rows = files.read(spark, kind, f"{tmp_path}/a.{kind}").orderBy("id").collect()
        assert [r["id"] for r in rows] == list(range(7)) and [list(r["values"]) for r in rows] == x.tolist()
    assert files.read(spark, "fvecs", f"{tmp_path}/a.fvecs", maxRows="3").count() == 3
    (tmp_path / "bad.fvecs").write_bytes(struct.pack("<iff", 3, 1, 2))
    with pytest.raises(Exception, match="records of 3"):
        files.read(spark, "fvecs", f"{tmp_path}/bad.fvecs").count()


def test_vecbin(spark, tmp_path):
    rows = [(i, [float(i)] * 8, 0) for i in range(300)]
    data = files.encode_batch(rows[:250]) + files.encode_batch(rows[250:]) + files.encode_batch([(1 << 40, [0.5] * 8, 1 << 33)])
    assert sum(map(len, files.decode_batches(data))) == 301
    with pytest.warns(UserWarning):
        assert sum(map(len, files.decode_batches(data[:-3]))) == 300
    with pytest.raises(InvalidInput):
        list(files.decode_batches(data[:-3], strict=True))
    with pytest.raises(InvalidInput):
        list(files.decode_batches(files.encode_batch([((1 << 64) - 1_001, [1.0], 0)])))
    (tmp_path / "v.bin").write_bytes(data)
    assert files.read(spark, "vecbin", f"{tmp_path}/v.bin").count() == 301
    config = IndexConfig(8, f"{tmp_path}/i", f"{tmp_path}/s")
    ix = api.Indexer(config, spark).build_from_vector_file(f"{tmp_path}/v.bin")
    assert ix.search(ix.search_request([7.0] * 8).with_n_probe(100))[0].external_id == 7


def shard_bytes(shard, lists, dim):
    body, entries = b"", b""
    start = struct.calcsize(files.SHARD_HEADER) + len(lists) * struct.calcsize(files.SHARD_ENTRY)
    pad = lambda b: b + b"\0" * (-len(b) % 8)
    for cid, rows in lists.items():
        block = pad(np.zeros(dim, "<f4").tobytes()) + b"".join(pad(struct.pack(files.SHARD_ROW, *meta) + np.asarray(v, "<f4").tobytes()) for meta, v in rows)
        entries += struct.pack(files.SHARD_ENTRY, cid, len(rows), 0, start + len(body), len(block))
        body += block
    return struct.pack(files.SHARD_HEADER, shard, 1, dim, len(lists), struct.calcsize(files.SHARD_HEADER), start) + entries + body


def test_shard_files(spark, tmp_path):
    lists = {100: [((100, 1_001, 1_234_567_890), [0.123456789, -0.987654321, 1234.5678])], 250: [], 500: [((101, 1_002, 5), [1, 2, 3]), ((102, 1_003, 6), [4, 5, 6])]}
    path = tmp_path / "shard_3.bin"
    path.write_bytes(shard_bytes(3, lists, 3))
    rows = files.read(spark, "ivfshard", str(path)).collect()
    assert sorted((r["centroid_id"], r["id"], r["external_id"], r["timestamp"]) for r in rows) == [(100, 100, 1_001, 1_234_567_890), (500, 101, 1_002, 5), (500, 102, 1_003, 6)]
    assert np.allclose(next(r["values"] for r in rows if r["id"] == 100), [0.123456789, -0.987654321, 1234.5678], atol=1e-4)
    assert files.read(spark, "ivfshard", str(path), centroidIds="500,250", shardId="3").count() == 2
    for options in ({"centroidIds": "7"}, {"shardId": "4"}):
        with pytest.raises(Exception, match="7|shard 3"):
            files.read(spark, "ivfshard", str(path), **options).count()


def test_written_shards_are_read_back(spark, tmp_path):
    rows = [(s, c, i * 10 + c, i + 1_000, 7, [float(i), float(c), 0.5]) for s, lists in ((0, (1, 2)), (4, (3,))) for c in lists for i in range(5 * c)]
    postings = spark.createDataFrame(rows, "shard_id int, centroid_id int, id long, external_id long, timestamp long, values array<float>")
    centroids = spark.createDataFrame([(c, s, 5 * c if c != 9 else 0, [float(c)] * 3) for c, s in ((1, 0), (2, 0), (9, 0), (3, 4))], "centroid_id int, shard_id int, n_vectors long, centroid array<double>")
    for _ in range(2):  # again over the first
        written = files.write_shards(postings.repartition(3), centroids, str(tmp_path))
        assert {r["file"].rsplit("_", 1)[1]: r["rows"] for r in written.collect()} == {"0.bin": 15, "4.bin": 15}
    got = files.read(spark, "ivfshard", str(tmp_path)).select("shard_id", "centroid_id", "id", "external_id", "timestamp", "values").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows))
    assert files.read(spark, "ivfshard", f"{tmp_path}/shard_0.bin", centroidIds="9,2").count() == 10


def test_written_vecbin_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 2.0], i * 3) for i in range(700)], "external_id long, values array<float>, timestamp long").repartition(3)
    files.write_vecbin(df, f"{tmp_path}/v")
    assert sorted(map(tuple, files.read(spark, "vecbin", f"{tmp_path}/v").collect())) == sorted(map(tuple, df.collect()))
    files.write_vecbin(df.limit(0), f"{tmp_path}/none")
    assert files.read(spark, "vecbin", f"{tmp_path}/none").count() == 0


def test_generators_and_assembly(spark):
    a = generate.uniform(spark, 50, 4, 1)
    assert a.orderBy("external_id").collect() == a.repartition(7).orderBy("external_id").collect()
    assert all(-1 <= v < 1 for r in a.collect() for v in r["values"])
    base, queries, truth = generate.normal(spark, 60, 6, 5, 3)
    assert truth.count() == 15
    ib, iq = base.selectExpr("external_id AS id", "values"), queries.selectExpr("query_id AS id", "query AS values")
    gt = truth.groupBy("query_id").agg({"external_id": "collect_list"}).toDF("id", "values")
    assert {tuple(r) for r in generate.assemble(ib, iq, gt, 60, 5, 3)[2].select("query_id", "external_id").collect()} == {tuple(r) for r in truth.select("query_id", "external_id").collect()}
    assert generate.assemble(ib, iq, gt, 20, 5, 3)[2].where("external_id >= 20").count() == 0
    with pytest.raises(InvalidInput):
        generate.assemble(ib, iq, gt, 60, 5, 4)


def test_stream_and_sweep(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((80, 6)).astype(np.float32)
    ix = api.Indexer(IndexConfig(6, f"{tmp_path}/i", f"{tmp_path}/s"), spark).build_from_records([(i, v, None) for i, v in enumerate(x.tolist())])
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(6)], "query_id long, query array<float>")
    q.write.parquet(f"{tmp_path}/q")
    search_stream(spark.readStream.schema(q.schema).parquet(f"{tmp_path}/q"), ix.index, f"{tmp_path}/out", f"{tmp_path}/cp", 3, 100).awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.where("rank = 1 and query_id = external_id").count() == 6 and got.count() == 18
    truth = ix.search_batch(q, 3, 100)
    results = evaluate.sweep(lambda n: ix.search_batch(q, 3, n), truth, 6, 3, [1, 100], 0.01)
    assert results[1]["recalls"]["R@1"] == 1.0 and results[1]["intersection"] == 1.0
    evaluate.save_results(results, f"{tmp_path}/r")
    assert (tmp_path / "r" / "results.md").read_text().startswith("| nprobe")
