"""Filling containers of fixed capacity with texts, neighbours along a space-filling curve together."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.tokens import Coder, Tokenizer, vocabulary
from orrery.session import cut, ship

DIMENSIONS, BITS = 3, 10
ITEMS = "doc_id long, piece int, pieces int, start long, chars long, tokens long, curve long"
PACKED = "container long, doc_id long, piece int, pieces int, start long, chars long, tokens long"


@dataclass(frozen=True)
class Packing:
    """capacity: tokens of a container. window: containers' worth of neighbouring items filled together; what fills
    none well waits for the next window. full: share from which a container is closed. task_containers: containers
    that a task fills at least, so that the few unfilled ones at its end don't count. most_tasks: bound of the tasks."""

    capacity: int = 2_048
    window: int = 64
    full: float = 0.995
    task_containers: int = 1_000
    most_tasks: int = 20_000
    seed: int = 3


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates of ``bits`` bits (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Curve:
    """Projects the hashed bag of a text's tokens to few dimensions and gives its place on the curve."""

    def __init__(self, seed: int, buckets: int = 1 << 12):
        self.buckets = buckets
        self.weights = np.random.default_rng(seed).standard_normal((buckets, DIMENSIONS))

    def places(self, texts: list[np.ndarray]) -> np.ndarray:
        at = np.zeros((len(texts), DIMENSIONS))
        for i, tokens in enumerate(texts):
            if len(tokens):
                bag = np.unique((tokens * 2_654_435_761) % self.buckets)
                at[i] = self.weights[bag].sum(0) / np.sqrt(len(bag))
        spread = 0.5 * (1 + np.tanh(0.8 * at))
        return hilbert(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def items(documents: DataFrame, tokenizer: Tokenizer, p: Packing) -> DataFrame:
    """The texts, or the pieces of texts longer than a container, with tokens and places on the curve."""
    spark = documents.sparkSession
    ship(spark)
    words = vocabulary(spark, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, curve = Coder(words.value, tokenizer.pattern), Curve(p.seed)
        for batch in batches:
            rows, bags = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                parts = coder.pieces(text, p.capacity)
                for k, (start, chars, tokens) in enumerate(parts):
                    rows.append((doc_id, k, len(parts), start, chars, len(tokens)))
                    bags.append(tokens)
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), pa.array(curve.places(bags), pa.int64())], names=["doc_id", "piece", "pieces", "start", "chars", "tokens", "curve"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    return texts.mapInArrow(run, ITEMS)


def fill(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items by falling size, each into the fullest container that it fits (best fit decreasing)."""
    held: list[list[int]] = []
    spaces: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(spaces, (int(sizes[i]), -1))
        if at < len(spaces):
            space, c = spaces.pop(at)
        else:
            space, c = capacity, len(held)
            held.append([])
        held[c].append(i)
        if space > sizes[i]:
            insort(spaces, (space - int(sizes[i]), c))
    return held


def _pack(batches: Iterator[pa.RecordBatch], p: Packing) -> Iterator[pa.RecordBatch]:
    """Containers of one task's stretch of the curve; at most a window of items waits in memory."""
    from pyspark import TaskContext

    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 32
    names = ["doc_id", "piece", "pieces", "start", "chars", "tokens"]
    waiting: pa.Table | None = None

    def close(end: bool) -> pa.RecordBatch | None:
        nonlocal waiting, number
        sizes = waiting["tokens"].to_numpy()
        held = fill(sizes, p.capacity)
        done = [c for c in held if end or sizes[c].sum() >= p.full * p.capacity]
        if not done:  # no container is full enough: the better half goes, so that the window moves on
            done = sorted(held, key=lambda c: -sizes[c].sum())[: max(1, len(held) // 2)]
        at = np.concatenate(done)
        ids = np.repeat(np.arange(len(done)) + number, [len(c) for c in done])
        number += len(done)
        out = waiting.take(pa.array(at)).combine_chunks().to_batches()[0]
        rest = np.ones(len(sizes), dtype=bool)
        rest[at] = False
        waiting = waiting.filter(pa.array(rest))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *out.columns], names=["container", *names])

    for batch in batches:
        for s in range(0, batch.num_rows, 2_048):
            part = pa.Table.from_batches([batch.slice(s, 2_048).select(names)])
            waiting = part if waiting is None else pa.concat_tables([waiting, part])
            while waiting.num_rows and waiting["tokens"].to_numpy().sum() >= p.window * p.capacity:
                yield close(end=False)
    if waiting is not None and waiting.num_rows:
        yield close(end=True)


def packed(documents: DataFrame, tokenizer: Tokenizer = Tokenizer(), p: Packing = Packing()) -> DataFrame:
    """(``container``, ``doc_id``, ``piece``, ``pieces``, ``start``, ``chars``, ``tokens``): every text, or every
    piece of a text with more than ``capacity`` tokens, in exactly one container of at most ``capacity`` tokens.

    Pieces are consecutive: ``start`` and ``chars`` give the characters of the text, 0-based. Null and empty texts
    have nothing to pack and are left out, as are rows with a null ``doc_id``; ``doc_id`` is taken to be unique.
    An empty table gives an empty result; other columns are ignored. Texts are tokenized whole.

    Items are range-partitioned by their places on the curve, copies of a text apart by a hash, into tasks of a
    bounded number of tokens; a task fills containers window by window along its stretch.
    """
    spark: SparkSession = documents.sparkSession
    listed = cut(items(documents, tokenizer, p))
    total = listed.agg(F.sum("tokens")).first()[0] or 0
    tasks = int(min(p.most_tasks, max(1, total // (p.capacity * p.task_containers))))
    mixed = F.xxhash64("doc_id", "piece").alias("mixed")
    along = listed.select("*", mixed).repartitionByRange(tasks, "curve", "mixed").sortWithinPartitions("curve", "mixed").drop("curve", "mixed")
    ship(spark)
    return along.mapInArrow(lambda batches: _pack(batches, p), PACKED)


def containers(filled: DataFrame) -> DataFrame:
    """(``container``, ``items``, ``tokens``) of every container."""
    return filled.groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
