import os
import math

import pytest

from orrery.llm import mixing, packing, quality, sample
from orrery.llm.examples import EXAMPLES
from orrery.llm.tokens import Coder, Tokenizer, counted


def taken(df):
    return {r["record"] for r in df.collect()}


def test_sample_grows_only(spark):
    rows = [(e, b, e * 10 + b, "x") for b in range(4) for e in range(b * 90, b * 90 + 150)]
    make = lambda r: spark.createDataFrame(r, "external_id long, load_no int, id long, hash string")
    before, rate = set(), 0.07
    for upto in range(1, 5):
        part = [r for r in rows if r[1] < upto]
        got = taken(sample.frozen_sample(make(part), rate))
        assert before <= got
        assert got == taken(sample.frozen_sample(make(part[::-1] + part[:40]).repartition(5), rate))
        before = got
    first = {}
    for e, b, _, _ in rows:
        first[e] = min(b, first.get(e, 9))
    for b in range(4):
        arrived = [e for e in first if first[e] == b]
        assert len([e for e in before if first[e] == b]) == math.ceil(round(rate * len(arrived), 6))


def test_sample_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (None, 0, 6), (2, 0, 7), (2, 0, 7), (2, 1, 8), (3, 0, None)], "external_id long, load_no int, id long")
    got = {r["record"]: (r["batch"], r["versions"], r["selected"]) for r in sample.batch_records(df, 1.0).collect()}
    assert got == {1: (None, 1, False), 2: (0, 2, True), 3: (0, 0, True)}
    assert taken(sample.frozen_sample(df, 0.0)) == set()
    assert sample.batch_records(df.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        sample.batch_records(df, 2.0)


@pytest.fixture(scope="module")
def coder():
    t = Tokenizer()
    with open(t.path, "rb") as f:
        return Coder(f.read(), t.pattern)


@pytest.mark.parametrize("text", ["", "one", "word " * 500, "ñandú 😀 " * 200, "x" * 3_000, "😀" * 300, "\n\n\t " * 100, "a" + " " * 150_000 + "b"])
def test_pieces_are_whole_and_fit(coder, text):
    parts = coder.pieces(text, 64)
    assert "".join(text[s : s + n] for s, n, _ in parts) == text
    assert all(len(t) <= 64 and len(coder.encode(text[s : s + n])) == len(t) for s, n, t in parts)
    assert (len(parts) > 1) == (len(coder.encode(text)) > 64)


def test_packing(spark, coder):
    texts = [(i, "word " * (1 + i * 7 % 60)) for i in range(300)] + [(900, "long text, " * 700), (901, None), (902, ""), (None, "lost"), (903, "same"), (904, "same")]
    df = spark.createDataFrame([(*r, 0) for r in texts], "doc_id long, text string, tokens int")
    p = packing.Packing(capacity=128, window=8, task_containers=20)
    rows = packing.packed(df, p=p).collect()
    held = {}
    for r in rows:
        held[r["container"]] = held.get(r["container"], 0) + r["tokens"]
    assert max(held.values()) <= 128 and sum(held.values()) / (128 * len(held)) > 0.95
    want = {i: t for i, t in texts if i is not None and t}
    for i, text in want.items():
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert "".join(text[r["start"] : r["start"] + r["chars"]] for r in own) == text and own[0]["pieces"] == len(own)
        assert (len(own) > 1) == (len(coder.encode(text)) > 128)
    assert {r["doc_id"] for r in rows} == set(want)
    assert packing.packed(df.limit(0), p=p).count() == 0


def test_hilbert_neighbours_touch():
    import numpy as np

    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    along = cells[np.argsort(key)]
    assert (abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_mix(spark):
    rows = [(i, f" Big{'' if i % 2 else ' '}", "word " * (1 + i % 9)) for i in range(900)] + [(1_000 + i, "small", "word " * 5) for i in range(30)] + [(2_000, None, "a"), (2_001, "other", "b c"), (2_002, "small", None), (2_003, "big", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, copies int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small ", 0.48, 4), ("absent", 0.02, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(df, targets, m=mixing.Mixing(size=1.0))
    r = {x["source"]: x for x in report.collect()}
    assert {s for s in r if r[s]["falls_short"]} == {"small", "absent"}
    assert r["small"]["used_most"] == 4 and r["small"]["used_tokens"] == 4 * r["small"]["tokens"]
    total = r["big"]["tokens"] + r["small"]["tokens"]
    assert abs(r["big"]["used_tokens"] - 0.5 * total) < 0.02 * total and r["big"]["used_most"] == 1
    got = mixed.collect()
    assert len({(x["doc_id"], x["copy"]) for x in got}) == len(got) and sum(x["tokens"] for x in got) == r["big"]["used_tokens"] + r["small"]["used_tokens"]
    assert abs(sum(x["actual_share"] for x in r.values()) - 1) < 1e-9
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(6), targets, m=mixing.Mixing(size=1.0))[0].collect()))
    assert [x["actual_share"] for x in mixing.mix(df.limit(0), targets)[1].collect()] == [0.0] * 3


def test_token_counts(spark, coder):
    df = spark.createDataFrame([(1, "Hello there", 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, tokens int")
    assert {r["doc_id"]: r["tokens"] for r in counted(df).collect()} == {1: len(coder.encode("Hello there")), 2: 0, 3: 0}


@pytest.mark.parametrize("bin_rows", [7, 200_000])
def test_mix_is_cut_back_to_the_targets(spark, bin_rows):
    rows = [(i, "big", "word " * (1 + i % 9)) for i in range(900)] + [(1_000 + i, "small", "word " * 5) for i in range(30)] + [(2_000, "big", "word " * 900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 4), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(df, targets, m=mixing.Mixing(bin_rows=bin_rows))
    r = {x["source"]: x for x in report.collect()}
    assert r["small"]["used_tokens"] == r["small"]["goal_tokens"] == 4 * r["small"]["tokens"]
    for s in ("big", "small"):
        assert abs(r[s]["actual_share"] - r[s]["reachable_share"]) < 0.02 and abs(r[s]["reachable_share"] - r[s]["target_share"] / 0.9) < 0.001
    tiny = mixing.mix(df, spark.createDataFrame([("big", 0.999, 1), ("small", 0.001, 1), ("absent", 0.0, 1)], targets.schema))[1]
    assert sum(x["used_tokens"] for x in tiny.collect()) > 0


@pytest.fixture(scope="module")
def common(spark):
    words = {"en": "the and a to of it is i was in for that this with on but not have my he they we".split(), "de": ["der", "die", "und", "ist", "nicht", "ich", None]}
    return spark.createDataFrame([(lang, w) for lang, own in words.items() for w in own], "lang string, word string")


@pytest.mark.parametrize("most_words", [0, 5_000])
def test_statistics(spark, common, most_words):
    texts = [(1, "The lamp is on.\nNot bad\n\n(it is 20 cm!)"), (2, None), (3, " \n"), (4, "...."), (5, "1 2 3"), (6, "x" * 200_000), (7, "😀"), (8, "a\n" + " " * 200_000 + "\nb."), (8, "Ja."), (None, "I")]
    df = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, lines int, common int")
    rows = quality.statistics(df, common, most_words=most_words).collect()
    assert len(rows) == len(texts) and all(v == v and v is not None for r in rows for v in list(r)[1:])
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["word_count"] == 10 and got[1]["punctuated_lines"] == pytest.approx(2 / 3)
    assert got[1]["mean_word_length"] == pytest.approx(2.9) and got[1]["symbol_ratio"] == pytest.approx(4 / 29)
    assert got[1]["common_share"] == pytest.approx(6 / 9)
    assert [got[i]["empty"] for i in (2, 3, 4)] == [True, True, False]


def test_fit_raises_the_likelihood_and_keeps_the_layout(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.3, (300, 4)), r.normal(3, 1, (100, 4)), r.normal(-4, 0.5, (50, 4))])
    m = quality.Mixture()
    fitted, likelihoods = quality.seeded(x, 6, np.zeros(4), np.ones(4), m), []
    for _ in range(12):
        sums = fitted.sums(x)
        likelihoods.append(sums[-1])
        fitted = fitted.moved(sums, 1e-6)
    assert (np.diff(likelihoods) > -1e-6).all() and likelihoods[-1] > likelihoods[0] + 100
    assert fitted.weights.sum() == pytest.approx(1) and np.allclose(fitted.shares(x)[0].sum(1), 1)


def test_quality(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the test tables aren't here")
    words = spark.read.parquet(f"{data}/common_words.parquet")
    rows = [(i, text, kind) for i, (kind, text) in enumerate((k, t) for k, own in EXAMPLES.items() for t in own)]
    df = spark.createDataFrame([*rows, *rows[:5], (-1, None, ""), (-2, "  ", ""), (-3, None, "")], "doc_id long, text string, kind string")
    got = quality.assessed(df, words).collect()
    assert len(got) == len(rows) + 8
    found = {r["doc_id"]: r for r in got}
    assert found[-1]["is_prose"] is None and found[-2]["word_count"] == 0 and found[-2]["kind"] is None
    assert sum(found[i]["is_prose"] == (kind == "prose") for i, _, kind in rows) / len(rows) > 0.9
    assert quality.assessed(df.limit(0), words).count() == 0


def test_packing_and_mix_are_registered_whole(spark):
    from orrery.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the test tables aren't here")
    made = queries.queries()
    mixed, packed = made["p7_mix"](spark, data), made["p6_packed"](spark, data)
    assert mixed.count() > 0 and mixed.select("doc_id", "copy").distinct().count() == mixed.count()
    assert packed.groupBy("container").sum("tokens").where("`sum(tokens)` > 2048").count() == 0
    texts = spark.read.parquet(f"{data}/documents.parquet").where("length(text) > 0").select("doc_id")
    assert packed.select("doc_id").distinct().count() == texts.count()
