"""Per-document text statistics, and a Gaussian mixture on them that tells prose from lists, tables and junk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.examples import EXAMPLES, RATE
from orrery.session import cut, ship

KINDS = ("prose", "list", "table", "junk")

#: The statistics that come out, and those that the mixture is fitted on besides.
STATISTICS = ("word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_share")
FURTHER = ("punctuated_odds", "common_odds", "digit_ratio", "line_count", "words_per_line", "lettered", "repetition", "odd_lines", "separators", "longest", "turns", "open_lines")
NAMES = (*STATISTICS, *FURTHER)

# Blanks within a line, blanks, what isn't blank; possessive where a run could be gone through again and again.
IN_LINE, BLANK, SOLID = r"[ \t\x0B\f\r\p{Z}]", r"[\s\p{Z}]", r"[^\s\p{Z}]"
LINES = rf"(?:^|\n){IN_LINE}*+{SOLID}"
ENDED = rf"[.!?…][\"'”»)’\]]*+{IN_LINE}*+(?:\n|\z)"
ODD = rf"(?:^|\n){IN_LINE}*+[^\s\p{{Z}}\p{{L}}]"
OPEN = rf"[\p{{L}}\p{{N}},;]{IN_LINE}*+(?:\n|\z)"
LETTERED = r"[^\s\p{Z}\p{L}]*+\p{L}[^\s\p{Z}]*+"
SEPARATORS = r"[^\s\p{Z}\p{L}\p{N}.,!?'’…-]|\t"
TURNS = r"\p{Ll}(?=\p{Lu})|\p{L}(?=\p{N})|\p{N}(?=\p{L})"


@dataclass(frozen=True)
class Mixture:
    """components: numbers of components tried on one half of the sample, of which the other half decides. sample_rows:
    bound of that sample, which also seeds the fit over all documents. sample_rounds: of expectation-maximization on it. rounds: most rounds over all
    documents. gain: rise of the mean log likelihood under which they end. ridge: added to variances of standardized
    statistics. spread: starting variance. most_words: common words up to which each language's are a constant set in
    the plan; more are joined."""

    components: tuple[int, ...] = (32, 64, 96)
    sample_rows: int = 10_000
    sample_rounds: int = 12
    rounds: int = 25
    gain: float = 0.01
    ridge: float = 0.02
    spread: float = 0.5
    most_words: int = 5_000
    seed: int = 3


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _odds(part: Column, whole: Column) -> Column:
    """Log odds of a share, drawn to even where there is little to count: none of two says less than none of a hundred."""
    return F.log((part + 1) / (whole - part + 1))


def _among(words: list[str]):
    return lambda w: w.isin(*words)


def common_shares(documents: DataFrame, common_words: DataFrame, most_words: int) -> DataFrame:
    """``documents`` (``letters``, ``key``) with ``common``: words of the one language that has most of them."""
    words = common_words.select(F.col("lang").cast("string").alias("lang"), F.lower("word").alias("word")).where(F.col("word").isNotNull()).distinct()
    few = words.limit(most_words + 1).collect()  # bounded
    if len(few) <= most_words:
        sets: dict[str | None, list[str]] = {}
        for r in few:
            sets.setdefault(r["lang"], []).append(r["word"])
        counts = [F.size(F.filter("letters", _among(sorted(own)))) for own in sets.values()]
        return documents.withColumn("common", F.greatest(F.lit(0), F.lit(0), *counts) if counts else F.lit(0))
    each = documents.select("key", F.explode("letters").alias("word")).groupBy("key", "word").agg(F.count("*").alias("n"))
    per = each.join(words, "word").groupBy("key", "lang").agg(F.sum("n").alias("n")).groupBy("key").agg(F.max("n").alias("common"))
    return documents.join(per, "key", "left").withColumn("common", F.coalesce("common", F.lit(0)))


def statistics(documents: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = Mixture().most_words) -> DataFrame:
    """(``doc_id``, ``empty``, STATISTICS, FURTHER) of every document, over whole texts; null texts count as empty.

    A word is a run without blanks. symbol_ratio: of the characters other than blanks, those that are neither
    letters nor digits. punctuated_lines: of the lines that aren't blank, those that end in one of .!?…, closing
    quotes and brackets aside. common_share: of the runs of letters, those among the common words of the one
    language that has most of them. All are 0 where there is nothing to count. Everything is counted by built-in functions.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = documents.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("t"), F.monotonically_increasing_id().alias("key"))
    first = first.select("doc_id", "t", "key", F.regexp_extract_all("t", F.lit(rf"{SOLID}+"), F.lit(0)).alias("words"), F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), F.lit(0)).alias("letters"))
    first = common_shares(first, common_words, most_words)
    length = lambda pattern: F.length(F.regexp_replace("t", pattern, "")).cast("double")
    counted = first.select(
        "doc_id", "t", "common", F.size("words").cast("double").alias("n"), F.size("letters").cast("double").alias("letters"), F.size(F.array_distinct("letters")).cast("double").alias("kinds"),
        F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)).alias("widest"), length(rf"{BLANK}+").alias("solid"),
        length(r"[^\p{L}\p{N}]+").alias("alnum"), length(r"[^\p{N}]+").alias("digits"), _count(F.col("t"), LINES).alias("lines"),
    )
    n, text = F.col("n"), F.col("t")
    return counted.select(
        "doc_id", (n == 0).alias("empty"), n.alias("word_count"), _share(F.col("solid"), n).alias("mean_word_length"), _share(F.col("solid") - F.col("alnum"), F.col("solid")).alias("symbol_ratio"),
        _share(_count(text, ENDED), F.col("lines")).alias("punctuated_lines"), _share(F.col("common").cast("double"), F.col("letters")).alias("common_share"),
        _odds(_count(text, ENDED), F.col("lines")).alias("punctuated_odds"), _odds(F.col("common").cast("double"), F.col("letters")).alias("common_odds"),
        _share(F.col("digits"), F.col("solid")).alias("digit_ratio"), F.log1p("lines").alias("line_count"), F.log1p(_share(n, F.col("lines"))).alias("words_per_line"), _share(_count(text, LETTERED), n).alias("lettered"),
        F.when(F.col("letters") > 3, 1 - F.log("kinds") / F.log("letters")).otherwise(0.0).alias("repetition"), _share(_count(text, ODD), F.col("lines")).alias("odd_lines"),
        F.log1p(_share(_count(text, SEPARATORS), n)).alias("separators"), F.log1p(F.col("widest").cast("double")).alias("longest"), F.log1p(_share(_count(text, TURNS), n)).alias("turns"),
        _share(_count(text, OPEN), F.col("lines")).alias("open_lines"),
    )


#: What the mixture takes of NAMES: the shares as odds, lengths as logarithms.
LOGGED = ("word_count", "mean_word_length")
USED = tuple(c for c in NAMES if c not in ("punctuated_lines", "common_share"))


def _used(table: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([np.log1p(table.column(c).to_numpy()) if c in LOGGED else table.column(c).to_numpy() for c in USED], axis=1)


@dataclass(frozen=True)
class Fitted:
    """A mixture on standardized statistics; ``kinds`` has each component's shares of the kinds of text."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    kinds: np.ndarray | None = None
    _whiten: np.ndarray = field(init=False)
    _level: np.ndarray = field(init=False)

    def __post_init__(self):
        factor = np.linalg.inv(np.linalg.cholesky(self.covariances))
        shift = np.einsum("kij,kj->ki", factor, self.means)
        k, d = self.means.shape
        object.__setattr__(self, "_whiten", np.concatenate([factor.reshape(k * d, d), -shift.reshape(-1, 1)], axis=1).T.copy())
        object.__setattr__(self, "_level", np.log(self.weights) + np.log(np.einsum("kii->ki", factor)).sum(1) - 0.5 * d * np.log(2 * np.pi))

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Responsibilities of the components for standardized rows, and the sum of log likelihoods."""
        out, total, (k, d) = np.empty((len(x), len(self.means))), 0.0, self.means.shape
        for s in range(0, len(x), 1_024):
            z = np.concatenate([x[s : s + 1_024], np.ones((len(x[s : s + 1_024]), 1))], axis=1) @ self._whiten
            part = self._level - 0.5 * (z * z).reshape(-1, k, d).sum(2)
            top = part.max(axis=1, keepdims=True)
            e = np.exp(part - top)
            out[s : s + 1_024] = e / e.sum(axis=1, keepdims=True)
            total += float((top[:, 0] + np.log(e.sum(axis=1))).sum())
        return out, total

    def standard(self, table: pa.RecordBatch | pa.Table) -> np.ndarray:
        return (_used(table) - self.centre) / self.scale

    def by_kind(self, table: pa.RecordBatch | pa.Table) -> np.ndarray:
        return self.shares(self.standard(table))[0] @ self.kinds

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Responsibilities, sums and products of standardized rows, component by component, then the log likelihood."""
        r, likelihood = self.shares(x)
        k, d = self.means.shape
        products = np.stack([(r[:, j, None] * x).T @ x for j in range(k)])
        return np.concatenate([r.sum(0), (r.T @ x).ravel(), products.ravel(), [likelihood]])

    def moved(self, sums: np.ndarray, ridge: float) -> Fitted:
        """The mixture after a round; a component that hardly any row falls to keeps its place."""
        k, d = self.means.shape
        n, s1, s2 = sums[:k], sums[k : k + k * d].reshape(k, d), sums[k + k * d : -1].reshape(k, d, d)
        held = n > 1
        safe = np.maximum(n, 1e-9)
        means = np.where(held[:, None], s1 / safe[:, None], self.means)
        covariances = np.where(held[:, None, None], s2 / safe[:, None, None] - np.einsum("ki,kj->kij", means, means) + np.eye(d) * ridge, self.covariances)
        return Fitted(self.centre, self.scale, (n + 0.1) / (n + 0.1).sum(), means, covariances)


def seeded(x: np.ndarray, k: int, centre: np.ndarray, scale: np.ndarray, m: Mixture) -> Fitted:
    """Components of equal spread at rows drawn in proportion to the squared distance to those before."""
    r = np.random.default_rng(m.seed)
    chosen = [x[r.integers(len(x))]]
    left = ((x - chosen[0]) ** 2).sum(1)
    while len(chosen) < k and left.sum() > 0:
        chosen.append(x[r.choice(len(x), p=left / left.sum())])
        left = np.minimum(left, ((x - chosen[-1]) ** 2).sum(1))
    means = np.array(chosen)
    return Fitted(centre, scale, np.full(len(means), 1 / len(means)), means, np.stack([np.eye(x.shape[1]) * m.spread] * len(means)))


def chosen_start(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, m: Mixture) -> Fitted:
    """Seeds from the sample, as many as make the other half of it likeliest when they are fitted on one half."""
    best, most = None, -np.inf
    for k in m.components:
        fitted = seeded(x[::2], min(k, len(x[::2])), centre, scale, m)
        for _ in range(m.sample_rounds):
            fitted = fitted.moved(fitted.sums(x[::2]), m.ridge)
        likelihood = fitted.shares(x[1::2])[1]
        if best is None or likelihood > most:
            best, most = k, likelihood
    return seeded(x, min(best, len(x)), centre, scale, m)


def fit(measured: DataFrame, examples: pa.Table, labels: list[str], m: Mixture = Mixture()) -> Fitted | None:
    """The mixture, fitted by expectation-maximization over all documents that aren't empty; None if there are none.

    It starts at seeds from a sample of bounded size. In every round tasks add up their rows' responsibilities,
    sums and products, which are added by position across tasks; the driver gets one sum per position only.
    Afterwards a component's shares of the kinds are those of the inspected examples that it is responsible for,
    each counting for as many texts as it stands for; a component that none falls to has the kind of the nearest.
    """
    texts = measured.where(~F.col("empty"))
    logged = [F.log1p(c) if c in LOGGED else F.col(c) for c in USED]
    first = texts.agg(F.count("*"), *(F.avg(c) for c in logged), *(F.stddev_pop(c) for c in logged)).first()
    if not first[0]:
        return None
    size = len(USED)
    centre, scale = np.array(first[1 : size + 1]), np.maximum(np.array(first[size + 1 :]), 1e-3)
    key = F.xxhash64("doc_id", *NAMES)
    share = min(1.0, m.sample_rows / first[0])
    part = texts.withColumn("h", key).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + (share >= 1)).orderBy("h").limit(2 * m.sample_rows)
    got = part.select(*NAMES).toArrow()  # bounded
    x = (_used(got) - centre) / scale
    if not len(x):
        x = np.zeros((1, size))
    fitted = chosen_start(x, centre, scale, m)
    spark, before = measured.sparkSession, -np.inf
    for _ in range(m.rounds):
        shared = spark.sparkContext.broadcast(fitted)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    sums = shared.value.sums(shared.value.standard(batch))
                    total = sums if total is None else total + sums
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "x"])

        added = texts.select(*NAMES).mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow().sort_by("at")["x"].to_numpy()
        fitted = fitted.moved(added, m.ridge)
        shared.unpersist()
        now = added[-1] / first[0]
        if now - before < m.gain:
            break
        before = now
    return named(fitted, examples, labels)


def named(fitted: Fitted, examples: pa.Table, labels: list[str]) -> Fitted:
    at = fitted.standard(examples)
    weight = np.array([RATE[k] for k in labels])
    is_kind = np.stack([[k == kind for k in labels] for kind in KINDS], axis=1).astype(float)
    votes = fitted.shares(at)[0].T @ (is_kind * weight[:, None])
    for c in np.flatnonzero(votes.sum(1) < 0.5):
        votes[c] = is_kind[int(((at - fitted.means[c]) ** 2).sum(1).argmin())]
    return Fitted(fitted.centre, fitted.scale, fitted.weights, fitted.means, fitted.covariances, votes / votes.sum(1, keepdims=True))


def inspected(common_words: DataFrame, m: Mixture) -> tuple[pa.Table, list[str]]:
    """Statistics and kinds of the inspected examples; fewer than 200."""
    rows = [(i, kind, text) for i, (kind, text) in enumerate((k, t) for k, texts in EXAMPLES.items() for t in texts)]
    frame = common_words.sparkSession.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string").coalesce(1)
    got = statistics(frame, common_words, most_words=m.most_words).toArrow().sort_by("doc_id")
    return got, [k for _, k, _ in rows]


def assessed(documents: DataFrame, common_words: DataFrame, m: Mixture = Mixture()) -> DataFrame:
    """(``doc_id``, STATISTICS, ``kind``, ``prose_share``, ``is_prose``) of every document.

    ``kind`` is the kind with the greatest posterior probability, ``prose_share`` that of prose, ``is_prose``
    whether it exceeds one half. Null, empty and blank texts have statistics of 0 and null for these three.
    Repeated rows each get their result; an empty table gives an empty result; other columns are ignored.
    """
    ship(documents.sparkSession)
    measured = cut(statistics(documents, common_words, most_words=m.most_words))
    fitted = fit(measured, *inspected(common_words, m), m)
    shared = documents.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            empty = batch.column("empty").to_numpy(zero_copy_only=False)
            shares = np.zeros((batch.num_rows, len(KINDS)))
            if shared.value is not None and batch.num_rows:
                shares = shared.value.by_kind(batch)
            kind = pa.array(np.array(KINDS, dtype=object)[shares.argmax(1)], pa.string(), mask=empty)
            prose, is_prose = pa.array(shares[:, 0], mask=empty), pa.array(shares[:, 0] > 0.5, mask=empty)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in STATISTICS), kind, prose, is_prose], names=["doc_id", *STATISTICS, "kind", "prose_share", "is_prose"])

    fields = [T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in STATISTICS), T.StructField("kind", T.StringType()), T.StructField("prose_share", T.DoubleType()), T.StructField("is_prose", T.BooleanType())]
    return measured.mapInArrow(run, T.StructType(fields)).withColumn("word_count", F.col("word_count").cast("long"))
