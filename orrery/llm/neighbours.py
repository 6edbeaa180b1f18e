"""Most similar vectors for every vector, by collision-counting hashing over routed blocks.

The plan shuffles the vectors once:

1. Regions and cells of a few hundred rows are fitted on samples (:mod:`orrery.llm.cells`) and broadcast, in waves of
   bounded size where there are very many; neighbouring cells form *blocks* of a bounded number of rows.
2. Every vector is stored in its own cell and asked there and in every further cell that its query-centred window
   reaches; it is sent once to each block it has to do with. Of two blocks, stored vectors visit only one way: a
   visitor is found there as well as it asks, so either side learns of the pair. Exact copies within a batch
   become one row with their smallest ids before the shuffle, of copies seen often in a task only smaller ids follow,
   and all are one *class* in the block. A cell with more rows than a block holds is split by hash on both sides, so
   that no task gets an unbounded group and every (query, stored) pair of a cell still meets once.
3. Each block answers by collision counting (``collisions.Block``), cell by cell; the k best of all its blocks
   are a class's neighbours. Lists of classes become lists of ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.vectors import is_valid_vector
from orrery.llm import collisions as cc
from orrery.llm.cells import Cells, Shape, fit, runs
from orrery.session import kept_folder, ship, shuffle_partitions

#: What a row is in a block: one that others find, one that asks, one that asks in no other block.
STORED, ASKED, ONLY = 1, 2, 4
#: Rows hashed and compared at once when equal ones are looked for.
SAME_AT_ONCE = 8_192


@dataclass(frozen=True)
class Similar:
    """Parameters of the search.

    k: neighbours per vector. limit: greatest squared distance, None for none. dimension: components of a
    valid vector. cell_rows: stored classes per cell aimed at, at any number of rows. spread: half a routing window
    in units of the search radius, 1.1 standard deviations of the projection of a pair that far apart; either of a pair may come to the other.
    block_rows: most stored classes that a block holds, as estimated from the sample; fewer on small tables, so that all
    cores have work. region_cells: cells of a region aimed at. wave_cells: cells broadcast at once.
    """

    k: int = 10
    limit: float | None = 8.0
    dimension: int = 64
    cell_rows: int = 300
    spread: float = 0.14
    block_rows: int = 65_536
    region_cells: int = 2_048
    wave_cells: int = 500_000
    seed: int = 11
    collisions: cc.Collisions = field(default_factory=cc.Collisions)

    def shape(self) -> Shape:
        return Shape(dimension=self.dimension, cell_rows=self.cell_rows, block_rows=self.block_rows, least_block=min(4_096, self.block_rows), region_cells=self.region_cells, wave_cells=self.wave_cells, seed=self.seed)


def node_of(id_: F.Column, bit: int) -> F.Column:
    """A key for ids of two tables that may coincide."""
    return F.shiftleft(id_, 1).bitwiseOR(F.lit(bit).cast("long"))


def stored_rows(df: DataFrame, id_col: str, vector_col: str, space: int = 0, bit: int = 0) -> DataFrame:
    """Rows to be stored and asked. Spaces never meet; ``bit`` tells tables with coinciding ids apart."""
    return _rows(df, id_col, vector_col, space, STORED | ASKED, bit)


def asked_rows(df: DataFrame, id_col: str, vector_col: str, space: int = 0, bit: int = 1) -> DataFrame:
    """Rows to be asked only."""
    return _rows(df, id_col, vector_col, space, ASKED, bit)


def _rows(df: DataFrame, id_col: str, vector_col: str, space: int, role: int, bit: int) -> DataFrame:
    id_ = F.col(id_col).cast("long")
    return df.select(
        F.lit(space).alias("space"), F.lit(role).alias("role"), F.lit(bit).alias("bit"), _fitting(id_).alias("id"), F.col(vector_col).cast("array<float>").alias("data")
    ).where(F.col("id").isNotNull() & F.col("data").isNotNull())


def _fitting(id_: F.Column) -> F.Column:
    fits = id_.isNull() | ((id_ >= -(1 << 62)) & (id_ < 1 << 62))
    return F.when(fits, id_).otherwise(F.raise_error(F.lit("ids must lie within 62 bits")).cast("long"))


def _keyed(df: DataFrame, id_col: str, vector_col: str, p: Similar) -> DataFrame:
    data = F.col(vector_col).cast("array<float>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), data.alias("data")).where(F.col("id").isNotNull())
    return rows.select("id", "data", F.xxhash64("data").alias("h1"), F.xxhash64(F.lit(p.seed), "data").alias("h2"))


def members(df: DataFrame, id_col: str, vector_col: str, p: Similar, bit: int = 0) -> DataFrame:
    """(``id``, ``node``) of every valid row, once per id; ``node`` names the class by its smallest id."""
    rows = _keyed(df, id_col, vector_col, p).where(is_valid_vector(F.col("data"), p.dimension)).select("h1", "h2", "id")
    slim = rows.repartition("h1", "h2").distinct()  # one shuffle serves all three steps
    nodes = slim.groupBy("h1", "h2").agg(node_of(F.min("id"), bit).alias("node"))
    return slim.join(nodes, ["h1", "h2"]).select("id", "node")


def further_copies(df: DataFrame, id_col: str, vector_col: str, p: Similar) -> DataFrame:
    """(``id``, ``first``) of ids beyond the k + 1 smallest of their class, with its k smallest in order.

    A class is gone through in hash bins of its ids, so that no task gets all copies of one vector.
    """
    bins = shuffle_partitions(df.sparkSession)
    keyed = _keyed(df, id_col, vector_col, p)
    large = keyed.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > p.k + 1).select("h1", "h2")
    ids = keyed.join(large, ["h1", "h2"], "left_semi").where(is_valid_vector(F.col("data"), p.dimension)).select("h1", "h2", "id", F.pmod(F.xxhash64("id"), F.lit(bins)).alias("bin")).distinct()
    place = F.row_number().over(Window.partitionBy("h1", "h2", "bin").orderBy("id"))
    least = ids.withColumn("place", place).where(F.col("place") <= p.k + 1).groupBy("h1", "h2").agg(F.slice(F.sort_array(F.collect_list("id")), 1, p.k + 1).alias("least"))
    least = least.where(F.size("least") > p.k).select("h1", "h2", F.slice("least", 1, p.k).alias("first"), F.element_at("least", -1).alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return ids.join(least, ["h1", "h2", "bin"]).where(F.col("id") > F.col("last")).select("id", "first")


def _pack(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, dtype=np.float32)
    width = x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(x)])


def _unpack(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    parts = _Packed(column, dimension).parts
    return np.concatenate(parts) if len(parts) != 1 else parts[0]


class _Packed:
    """The rows of a packed column, left in its chunks; only those asked for are copied."""

    def __init__(self, column: pa.ChunkedArray | pa.Array, dimension: int):
        self.parts, self.shape = [], (len(column), dimension)
        for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
            ends = np.frombuffer(c.buffers()[1], dtype=np.int32)[c.offset : c.offset + len(c) + 1]
            self.parts.append(np.frombuffer(c.buffers()[2], dtype=np.float32, count=(ends[-1] - ends[0]) // 4, offset=int(ends[0])).reshape(-1, dimension))
        self.ends = np.cumsum([0, *(len(p) for p in self.parts)])

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, at: slice | np.ndarray) -> np.ndarray:
        at = np.arange(len(self))[at] if isinstance(at, slice) else at
        out, part = np.empty((len(at), self.shape[1]), np.float32), np.searchsorted(self.ends, at, side="right") - 1
        for n in np.unique(part):
            mine = np.flatnonzero(part == n)
            out[mine] = self.parts[n][at[mine] - self.ends[n]]
        return out


ROUTED = "block long, place long, flag int, bit int, ids array<long>, home int, cells array<int>, v binary"


def _vectors(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entries are valid vectors, and these as a matrix."""
    ends = column.offsets.to_numpy()
    values = column.values
    fine = np.asarray(values.is_valid().to_numpy(zero_copy_only=False)) if values.null_count else None
    flat = values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    ok = np.flatnonzero((np.diff(ends) == dimension) & column.is_valid().to_numpy(zero_copy_only=False))
    at = ends[ok][:, None] + np.arange(dimension)
    x = flat[at]
    good = np.isfinite(x).all(axis=1)
    if fine is not None:
        good &= fine[at].all(axis=1)
    return ok[good], np.ascontiguousarray(x[good]) + np.float32(0)


def _words(parts: tuple[np.ndarray | _Packed, ...], at: slice | np.ndarray) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(p[at]).view(np.uint32) for p in parts], axis=1)


def _same(*parts: np.ndarray | _Packed) -> tuple[np.ndarray, np.ndarray]:
    """First row and class of equal rows, the parts side by side; classes are in the order of a hash.

    Rows are never copied as a whole: two hashes tell them apart, and each row is compared with the first of its class.
    """
    n, step = len(parts[0]), SAME_AT_ONCE
    hashed = np.zeros((2, n), np.uint64)
    for s in range(0, n, step):
        words = _words(parts, slice(s, s + step)).astype(np.uint64)
        for out, odd in zip(hashed, _ODD.reshape(2, -1)):
            out[s : s + step] = words @ odd[: words.shape[1]]
    order = np.lexsort(hashed)
    new = (hashed[:, order[1:]] != hashed[:, order[:-1]]).any(axis=0)
    label = np.empty(n, int)
    label[order] = np.r_[0, np.cumsum(new)][:n]
    first = order[np.r_[True, new][:n]]
    if all((_words(parts, slice(s, s + step)) == _words(parts, first[label[s : s + step]])).all() for s in range(0, n, step)):
        return first, label
    raw = _words(parts, slice(None))  # different rows of one hash
    _, first, label = np.unique(raw.view(np.dtype((np.void, 4 * raw.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, label


def _least(label: np.ndarray, ids: np.ndarray, classes: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` smallest distinct ids of each class, as ends and values."""
    order = np.lexsort((ids, label))
    label, ids = label[order], ids[order]
    new = np.r_[True, (label[1:] != label[:-1]) | (ids[1:] != ids[:-1])] if len(ids) else np.zeros(0, bool)
    label, ids = label[new], ids[new]
    keep = cc._place(label) < most
    return np.r_[0, np.cumsum(np.bincount(label[keep], minlength=classes))], ids[keep]


class _Seen:
    """The (k + 1)-th smallest id so far of classes that a task has met more often, to leave out copies beyond."""

    def __init__(self, most: int):
        self.most, self.ids = most, {}

    def wanted(self, keys: list[bytes], ends: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends and ids of each class without those that can't be among its smallest; a class without any is skipped."""
        keep = np.ones(len(ids), bool)
        for i in np.flatnonzero((np.diff(ends) > 1) | np.array([k in self.ids for k in keys], bool)):
            own = ids[ends[i] : ends[i + 1]]
            before = self.ids.get(keys[i], own[:0])
            if len(before) == self.most:
                keep[ends[i] : ends[i + 1]] = own < before[-1]
            self.ids[keys[i]] = np.unique(np.r_[before, own])[: self.most]
        counts = np.add.reduceat(keep, ends[:-1]) if len(keys) else np.zeros(0, int)
        return np.r_[0, np.cumsum(counts)], ids[keep]


def _route(batches: Iterator[pa.RecordBatch], routers: dict[int, Cells], p: Similar, graph: bool, whole: bool) -> Iterator[pa.RecordBatch]:
    """A row for each block that a vector is stored or asked in; copies are one row.

    With ``graph`` also for each block that it is only compared with for links; such cells are given as ~cell.
    ``whole`` tells that the routers hold all cells, not a wave of them.
    """
    seen = _Seen(p.k + 1)
    for batch in batches:
        ok, x = _vectors(batch.column("data"), p.dimension)
        if not len(ok):
            continue
        space, role, bit, ids = (batch.column(c).to_numpy(zero_copy_only=False)[ok].astype(np.int64) for c in ("space", "role", "bit", "id"))
        alone = np.where(role & STORED, 0, ids)  # a question is a class of its own
        key = np.stack([space, role, bit, alone], axis=1)
        first, label = _same(x, key)
        ends, least = _least(label, ids, len(first), p.k + 1)
        x, space, role, bit = x[first], space[first], role[first], bit[first]
        hashed = np.stack([x.view(np.uint32).astype(np.uint64) @ _ODD[a : a + p.dimension] for a in (0, p.dimension)] + [key[first] @ _ODD[2 * p.dimension : 2 * p.dimension + 4].astype(np.int64)], axis=1).astype(np.uint64)
        ends, least = seen.wanted([h.tobytes() for h in hashed], ends, least)
        live = np.flatnonzero(np.diff(ends) > 0)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(least, pa.int64()))
        salt = (hashed[:, 0] >> np.uint64(34)).astype(np.int64)
        for key in np.unique(space[live]):
            at, r = live[space[live] == key], routers[int(key)]
            yield _sent(x, at, role, bit, salt, lists, r, int(key), p, graph, whole)


def _sent(x: np.ndarray, at: np.ndarray, role: np.ndarray, bit: np.ndarray, salt: np.ndarray, lists: pa.ListArray, r: Cells, space: int, p: Similar, graph: bool, whole: bool) -> pa.RecordBatch:
    """The rows to be sent for the vectors ``at`` of one space, a row per vector, block and part of a split block."""
    i, cell, asked, home = r.visits(x[at], p.spread, p.limit, graph)
    block, own = r.block[cell], np.where(home >= 0, r.block[np.maximum(home, 0)], -1)[i]
    stored = (role[at] & STORED > 0)[i]
    goes = ~asked | (block == own) | (own < 0) | ~stored | ((block < own) == ((block + own) % 2 == 0))
    asked &= goes
    if not graph:
        i, cell, asked, block = i[goes], cell[goes], asked[goes], block[goes]
    order = np.lexsort((~asked, block, i))  # cells to be searched come first
    i, cell, asked, block = i[order], cell[order], asked[order], block[order]
    new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (block[1:] != block[:-1])][: len(i)])
    size = np.diff(np.r_[new, len(i)])
    row, at_home, searched = i[new], (block[new] == np.where(home >= 0, r.block[np.maximum(home, 0)], -1)[i[new]]), asked[new]
    blocks = np.bincount(row[searched], minlength=len(at))
    flag = np.where(searched, role[at[row]], ASKED) | np.where(searched & (blocks[row] == 1) & whole, ONLY, 0)
    b, q = r.stored_parts[cell[new]], r.asked_parts[cell[new]]
    kept = (flag & STORED) > 0
    copies = b + np.where(kept, q - 1, 0)
    group = np.repeat(np.arange(len(new)), copies)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(copies) - copies, copies)
    s, b, q = salt[at[row]][group], b[group], q[group]
    asks = nth < b  # asked in every stored part; stored in every asked part besides
    own_b, own_q = s % b, s % q
    other = nth - b + (nth - b >= own_q)
    place = np.where(asks, (nth << 31) + own_q, (own_b << 31) + other)
    flags = np.where(asks, (flag[group] & ~STORED) | np.where(kept[group] & (nth == own_b), STORED, 0), STORED)
    flags = np.where(b * q > 1, flags & ~ONLY, flag[group])
    cells = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(np.where(asked, cell, ~cell), pa.int32()))
    n = at[row[group]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array((np.int64(space) << 56) + block[new][group]), pa.array(place), pa.array(flags.astype(np.int32)), pa.array(bit[n].astype(np.int32)), lists.take(pa.array(n)),
            pa.array(np.where(at_home, home[row], -1)[group].astype(np.int32)), cells.take(pa.array(group)), _pack(x[n]),
        ],
        names=["block", "place", "flag", "bit", "ids", "home", "cells", "v"],
    )


#: Odd multipliers of the hash by which a split cell spreads its vectors.
_ODD = np.random.default_rng(17).integers(1, 1 << 63, size=1 << 14, dtype=np.uint64) | np.uint64(1)

FOUND = "node long, ids array<long>, near array<long>, far array<double>, links array<long>"


def _listed(column: pa.ChunkedArray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) of the lists of some rows, as 32 bits each since there are many to a row."""
    lists = column.take(pa.array(first[rows])).combine_chunks().cast(pa.list_(pa.int32()))
    return np.repeat(rows.astype(np.int32), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)


def _answer(table: pa.Table, p: Similar, graph: bool) -> pa.Table:
    """The answers of one block: per asked class the ids nearest to it, its own further copies included.

    With ``graph`` the lists are of nodes, without copies, and ``links`` makes them complete for connectedness:
    whatever pairs within the limit join in the block stays joined by the links and by the lists of the classes that
    ask in no other block, since lists of several blocks are cut again when they are merged. A link is held by its
    asked class, or by the one found where that has nothing else.
    """
    flag, bit = table["flag"].to_numpy(), table["bit"].to_numpy()
    lists = table["ids"].combine_chunks().cast(pa.list_(pa.int64()))
    ends, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
    x = _Packed(table["v"], p.dimension)
    question = np.zeros(len(bit), bool) if graph else bit == 1
    first, label = _same(x, np.stack([flag.astype(np.int64), bit.astype(np.int64), np.where(question, flat[ends[:-1] - ends[0]], 0)], axis=1))
    ends, flat = _least(np.repeat(label, np.diff(ends)), flat, len(first), p.k + 1)
    flag, home = flag[first], table["home"].to_numpy()[first]
    node = (flat[ends[:-1]] << 1) | bit[first]
    asked = np.flatnonzero(flag & ASKED)
    ask_row, ask_cell = _listed(table["cells"], first, asked)
    search, ask_cell = ask_cell >= 0, np.where(ask_cell < 0, ~ask_cell, ask_cell)
    order = np.argsort(ask_cell, kind="stable")
    ask_row, search, ask_cell = ask_row[order], search[order], ask_cell[order]
    at = np.flatnonzero(np.r_[True, ask_cell[1:] != ask_cell[:-1]][: len(ask_cell)])
    asks = dict(zip(ask_cell[at].tolist(), zip(at.tolist(), [*at[1:].tolist(), len(ask_cell)])))
    del order, ask_cell
    links: dict[int, list[int]] = {}
    found, searched = [], []
    stored = (flag & STORED) > 0
    guest = np.flatnonzero(stored & (home < 0))
    guest_row, guest_cell = _listed(table["cells"], first, guest)
    guest_row, guest_cell = guest_row[guest_cell >= 0], guest_cell[guest_cell >= 0]
    in_cell = np.r_[home[stored & (home >= 0)], guest_cell].astype(np.int32)
    in_row = np.r_[np.flatnonzero(stored & (home >= 0)), guest_row].astype(np.int32)
    for cell, places in zip(*runs(in_cell)):
        base, at = in_row[places], slice(*asks.get(int(cell), (0, 0)))
        rows = ask_row[at][search[at]]
        base = base[np.argsort(node[base])]
        block = cc.Block(x[first[base]], node[base], p.collisions)
        q = x[first[rows]]
        qi, bi, d = block.search(q, node[rows], p.k, p.limit)
        found.append((rows[qi], base[bi], d))
        if graph and p.limit is not None:
            searched.append((ask_row[at], base))
    row, near, d = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    joins = [(row, near, d)]
    if searched:
        label = cc.components(len(node), row, near)
        for rows, base in searched:
            i, j, far = cc.bridges(cc.Stored(x[first[base]]), x[first[rows]], np.arange(len(rows)), label[rows], label[base], p.limit)
            joins.append((rows[i], base[j], far))
    if not graph:
        many = np.flatnonzero(stored & (flag & ASKED > 0) & (np.diff(ends) > 1))
        row, near, d = np.r_[row, many], np.r_[near, many], np.r_[d, np.zeros(len(many))]
    order = np.lexsort((node[near], d, row))
    order = order[np.r_[True, (row[order][1:] != row[order][:-1]) | (near[order][1:] != near[order][:-1])][: len(order)]]  # met in several cells
    order = order[cc._place(row[order]) < (p.k if graph else p.k + 1)]
    row, near, d = row[order], near[order], d[order]
    if graph:
        a, b, far = (np.concatenate(c) for c in zip(*joins))
        stays = (flag[row] & ONLY) > 0
        chosen = cc.spanning(cc.components(len(node), row[stays], near[stays]), a, b, far)
        for i, j in zip(a[chosen].tolist(), b[chosen].tolist()):
            links.setdefault(i, []).append(int(node[j]))
        silent = np.bincount(row, minlength=len(node)) == 0
        ends_a, ends_b = np.r_[row, a[chosen]], np.r_[near, b[chosen]]
        alone = np.flatnonzero(silent[ends_b])
        for i, j in zip(ends_a[alone].tolist(), ends_b[alone].tolist()):
            if j not in links:
                links[j] = [int(node[i])]
        near = node[near]
    else:
        n = ends[near + 1] - ends[near]
        at = np.repeat(ends[near] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        row, near, d = np.repeat(row, n), flat[at], np.repeat(d, n)
        order = np.lexsort((near, d, row))
        order = order[cc._place(row[order]) <= p.k]
        row, near, d = row[order], near[order], d[order]
    counts = np.bincount(row, minlength=len(node))
    rows = np.flatnonzero((counts > 0) | np.isin(np.arange(len(node)), list(links)))
    stops = pa.array(np.r_[0, np.cumsum(counts[rows])].astype(np.int32))
    own = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int64()))
    return pa.table(
        [
            pa.array(node[rows], pa.int64()),
            own.take(pa.array(rows)),
            pa.ListArray.from_arrays(stops, pa.array(near, pa.int64())),
            pa.ListArray.from_arrays(stops, pa.array(d, pa.float64())),
            pa.array([links.get(int(i), []) for i in rows], pa.list_(pa.int64())),
        ],
        names=["node", "ids", "near", "far", "links"],
    )


def answers(rows: DataFrame, routers: dict[int, Cells], p: Similar, graph: bool) -> DataFrame:
    """The answers of all blocks to ``rows`` (of :func:`stored_rows` and :func:`asked_rows`), several per node.

    Where the cells are too many to be broadcast at once, rows are first written out by the waves of regions that
    they have to do with, and each wave is routed with its own cells.
    """
    spark = rows.sparkSession
    ship(spark)
    waves = [(space, wave) for space, r in routers.items() for wave in r.waves(p.wave_cells)]
    if len(waves) == len(routers):
        shared = spark.sparkContext.broadcast(routers)
        routed = rows.mapInArrow(lambda batches: _route(batches, shared.value, p, graph, True), ROUTED)
    else:
        routed = None
        folder = _by_wave(rows, routers, waves, p, graph)
        for n, (space, wave) in enumerate(waves):
            shared = spark.sparkContext.broadcast({space: routers[space].wave(*wave)})
            part = spark.read.parquet(folder).where(F.col("wave") == n)
            part = part.mapInArrow(lambda batches, shared=shared: _route(batches, shared.value, p, graph, False), ROUTED)
            routed = part if routed is None else routed.unionByName(part)
    return routed.groupBy("block", "place").applyInArrow(lambda table: _answer(table, p, graph), FOUND)


def _by_wave(rows: DataFrame, routers: dict[int, Cells], waves: list[tuple[int, tuple[int, int]]], p: Similar, graph: bool) -> str:
    """A folder with the rows, each once per wave of regions that it has to do with."""
    spark = rows.sparkSession
    lean = {space: replace(r, centres=r.centres[:0], holds=r.holds[:0], rows=r.rows[:0], asked=r.asked[:0], block=r.block[:0], stored_parts=r.stored_parts[:0], asked_parts=r.asked_parts[:0]) for space, r in routers.items()}
    shared = spark.sparkContext.broadcast((lean, waves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean, waves = shared.value
        for batch in batches:
            ok, x = _vectors(batch.column("data"), p.dimension)
            space = batch.column("space").to_numpy()[ok]
            for n, (s, (first, past)) in enumerate(waves):
                at = np.flatnonzero(space == s)
                i, region, _, _ = lean[s].regions_in_reach(x[at], p.spread, p.limit, graph)
                mine = np.unique(i[(region >= first) & (region < past)])
                if len(mine):
                    out = batch.take(pa.array(ok[at[mine]]))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(len(mine), n), pa.int32())], names=[*out.schema.names, "wave"])

    folder = kept_folder(spark, "waves")
    from pyspark.sql import types as T

    rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("wave", T.IntegerType())])).write.partitionBy("wave").parquet(folder)
    return folder


def merged(found: DataFrame, keep: int) -> DataFrame:
    """Per node the ``keep`` nearest of all its blocks, as ``hits`` of (``far``, ``near``) in order."""
    pairs = F.arrays_zip("far", "near")
    best = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(pairs)))), 1, keep)
    return found.groupBy("node").agg(F.first("ids").alias("ids"), best.alias("hits"))


def most_similar(stored: DataFrame, requests: DataFrame | None = None, p: Similar = Similar(), *, id_col: str = "id", vector_col: str = "data", request_id_col: str = "query_id", request_col: str = "query") -> DataFrame:
    """The ``k`` nearest stored vectors of every stored vector and every request.

    Result: ``origin`` ('stored' or 'request'), ``query_id``, ``rank`` (from 1), ``neighbour_id``, ``distance``
    (squared). A stored vector doesn't list its own id; of equal distances the smaller id comes first.
    Rows whose vector isn't valid (null, of another length, with null, NaN or infinite components) or whose id
    is null are left out on both sides; rows of one id must carry one vector and count once; copies under other
    ids are neighbours at distance 0. With ``limit`` farther neighbours are left out, so lists may be shorter or
    missing; without, only blocks in reach of a query's window are searched. Empty tables give an empty result.
    Columns other than those named are ignored, whatever they are called. Ids must lie within 62 bits.
    """
    routers = {0: fit(stored, vector_col, p.shape(), p.k, requests, request_col)}
    everything = stored_rows(stored, id_col, vector_col)
    if requests is not None:
        everything = everything.unionByName(asked_rows(requests, request_id_col, request_col))
    lists = merged(answers(everything, routers, p, graph=False), p.k + 1)
    is_request = F.col("node").bitwiseAND(F.lit(1).cast("long")) == 1
    each = lists.select(F.when(is_request, "request").otherwise("stored").alias("origin"), F.explode("ids").alias("query_id"), "hits")
    rest = further_copies(stored, id_col, vector_col, p)
    rest = rest.select(F.lit("stored").alias("origin"), F.col("id").alias("query_id"), F.transform("first", lambda i: F.struct(F.lit(0.0).alias("far"), i.alias("near"))).alias("hits"))
    each = each.unionByName(rest)
    others = F.filter("hits", lambda h: (F.col("origin") == "request") | (h["near"] != F.col("query_id")))
    listed = each.select("origin", "query_id", F.posexplode(F.slice(others, 1, p.k)).alias("at", "hit"))
    return listed.select("origin", "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.near").alias("neighbour_id"), F.col("hit.far").alias("distance"))


def similar_pairs(listed: DataFrame) -> DataFrame:
    """(``origin``, ``left_id``, ``right_id``): stored pairs of which one lists the other, smaller id first; requests as asked."""
    swap = (F.col("origin") == "stored") & (F.col("query_id") > F.col("neighbour_id"))
    return listed.select(
        "origin",
        F.when(swap, F.col("neighbour_id")).otherwise(F.col("query_id")).alias("left_id"),
        F.when(swap, F.col("query_id")).otherwise(F.col("neighbour_id")).alias("right_id"),
    ).distinct()
