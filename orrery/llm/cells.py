"""A coarse quantizer of two levels: regions, and cells of a few hundred rows within each, at any number of rows.

Region centres are fitted on the driver on a sample of some rows per region of two thousand cells; the cells of a
region are fitted by one task on the region's part of a hash sample, so that nothing but centres comes back. A vector
belongs to the nearest cell of its nearest region. Its *window* of half width w reaches a centre when the border
between that centre's and its own cell is within w; the same rule holds between regions and between the cells of a
region, a vector that comes to another region taking the nearest cell there for its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.vectors import is_valid_vector
from orrery.session import ship

#: Rows compared with all centres at once, which bounds the memory taken.
ROWS_AT_ONCE = 1_024
#: Entries of a matrix of rows and cells of a region held at once; some seven matrices of that size exist together.
PAIRS_AT_ONCE = 1 << 21


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of a sample held in memory: rows drawn at random, then a few rounds of means."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        label = nearest(x, c)
        n = np.bincount(label, minlength=len(c))
        total = np.stack([np.bincount(label, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c[n > 0] = (total[n > 0] / n[n > 0, None]).astype(np.float32)
    return c[n > 0] if rounds else c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    norms = np.einsum("ij,ij->i", c, c)
    return np.concatenate([(norms[None] - 2 * (x[s : s + ROWS_AT_ONCE] @ c.T)).argmin(axis=1) for s in range(0, len(x), ROWS_AT_ONCE)] or [np.zeros(0, int)])


def runs(label: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct labels, ascending, and the places of each."""
    order = np.argsort(label, kind="stable")
    parts = [x for x in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(x)]
    return np.array([label[x[0]] for x in parts], dtype=int), parts


def halved(centres: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """A block for each centre: centres are halved along their widest direction until a part has at most ``most`` rows."""
    block, todo, number = np.zeros(len(centres), int), [np.arange(len(centres))], 0
    while todo:
        at = todo.pop()
        if len(at) == 1 or rows[at].sum() <= most:
            block[at] = number
            number += 1
            continue
        x = centres[at] - centres[at].mean(axis=0)
        along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
        order = at[np.argsort(along, kind="stable")]
        half = np.clip(np.searchsorted(np.cumsum(rows[order]), rows[order].sum() / 2) + 1, 1, len(at) - 1)
        todo += [order[:half], order[half:]]
    return block


def _compared(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Squared distances without the rows' own norms, the nearest centre, by how much others are farther, and how far
    each lies from that nearest."""
    norms = np.einsum("ij,ij->i", c, c)
    d = norms[None] - 2 * (x @ c.T)
    home = d.argmin(axis=1)
    best = d[np.arange(len(x)), home]
    used, at = np.unique(home, return_inverse=True)
    apart = np.sqrt(np.maximum(norms[used][:, None] + norms[None] - 2 * (c[used] @ c.T), 0))[at]
    return best, home, d - best[:, None], apart


@dataclass(frozen=True)
class Shape:
    """dimension: components of a valid vector. cell_rows: rows per cell aimed at. cell_sample, region_sample: sampled rows that
    a cell's or region's centre is fitted on. region_cells: cells of a region aimed at. block_rows: most rows of neighbouring
    cells that a block holds, as estimated from the sample; least_block: rows it holds though there are fewer than ``blocks``
    of them. wave_cells: cells broadcast at once; more are gone through in waves of regions."""

    dimension: int = 64
    cell_rows: int = 300
    cell_sample: int = 16
    region_sample: int = 32
    region_cells: int = 2_048
    block_rows: int = 65_536
    least_block: int = 4_096
    blocks: int = 16
    wave_cells: int = 500_000
    seed: int = 11


@dataclass(frozen=True)
class Cells:
    """Region centres; the cells of region r are those from ``starts[r]`` to ``starts[r + 1]``.

    holds: per cell a radius that holds ``k`` + 1 rows, region_holds the same per region. rows, asked: estimated rows stored and
    further rows asked. block: cells that go to one task. stored_parts, asked_parts: the splits of a cell's two
    sides; only a cell that is a block alone is split.
    """

    regions: np.ndarray
    region_holds: np.ndarray
    starts: np.ndarray
    centres: np.ndarray
    holds: np.ndarray
    rows: np.ndarray
    asked: np.ndarray
    block: np.ndarray
    stored_parts: np.ndarray
    asked_parts: np.ndarray

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out, region = np.zeros(len(x), int), nearest(x, self.regions)
        for r, at in zip(*runs(region)):
            out[at] = self.starts[r] + nearest(x[at], self.centres[self.starts[r] : self.starts[r + 1]])
        return out

    def wave(self, first: int, past: int) -> Cells:
        """The same with only the cells of the regions from ``first`` to ``past``; numbers of blocks are kept."""
        a, z = self.starts[first], self.starts[past]
        starts = np.clip(self.starts, a, z) - a
        return replace(self, starts=starts, **{f: getattr(self, f)[a:z] for f in ("centres", "holds", "rows", "asked", "block", "stored_parts", "asked_parts")})

    def regrouped(self, weight: np.ndarray, most: int) -> Cells:
        """The same with blocks of cells of at most ``most`` of the weight, and heavier cells split by it."""
        local = [halved(self.centres[a:z], weight[a:z], most) for a, z in zip(self.starts[:-1], self.starts[1:])]
        block = numbered(self.regions, self.starts, weight, local, most)
        alone = np.bincount(block)[block] == 1
        return replace(self, block=block, stored_parts=np.where(alone, np.maximum(1, np.ceil(weight / most)), 1).astype(int))

    def waves(self, most: int) -> list[tuple[int, int]]:
        """Ranges of regions of at most ``most`` cells each, where a region alone doesn't exceed that."""
        out, first = [], 0
        for r in range(1, len(self.regions) + 1):
            if r == len(self.regions) or self.starts[r + 1] - self.starts[first] > most:
                out.append((first, r))
                first = r
        return out

    def regions_in_reach(self, x: np.ndarray, spread: float, limit: float | None, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, region, home, asked) of the regions a row has to do with; ``every`` as in :meth:`visits`."""
        parts = []
        for s in range(0, len(x), ROWS_AT_ONCE):
            rows = x[s : s + ROWS_AT_ONCE]
            best, home, farther, apart = _compared(rows, self.regions)
            reach = self._reach(best, rows, self.region_holds[home], limit)
            asked = farther <= (2 * spread * reach)[:, None] * apart
            near = asked
            if every and limit is not None:
                near = asked | (farther <= np.sqrt(limit) * apart + self._slack(rows))
            near[np.arange(len(rows)), home] = True
            i, region = np.nonzero(near)
            own = region == home[i]
            parts.append((i + s, region, own, own | asked[i, region]))
        return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool), np.zeros(0, bool))

    @staticmethod
    def _reach(best: np.ndarray, x: np.ndarray, holds: np.ndarray, limit: float | None) -> np.ndarray:
        own = np.sqrt(np.maximum(best + np.einsum("ij,ij->i", x, x), 0))
        return np.minimum(own + holds, 1e18 if limit is None else np.sqrt(limit))

    def _slack(self, x: np.ndarray) -> np.ndarray:
        """What rounding may hide in differences of squared distances."""
        return 1e-5 * (float(np.einsum("ij,ij->i", self.regions, self.regions).max(initial=0)) + np.einsum("ij,ij->i", x, x))[:, None]

    def visits(self, x: np.ndarray, spread: float, limit: float | None, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, asked) of the cells a row has to do with, and the home cell of each row, -1 outside this wave.

        Rows are asked in cells that their window reaches, of ``spread`` times the distance within which their
        neighbours lie. With ``every`` further cells come out, so that of two rows within the limit one always
        comes to the other's cell: the segment between them crosses the border between their regions, or their
        cells, so one is within half the limit of it. It comes to the other's region, and there, since the other
        doesn't come towards it, to all cells within the whole limit of its nearest.
        """
        i, region, own, asked = self.regions_in_reach(x, spread, limit, every)
        home = np.full(len(x), -1)
        out = []
        parts = ((r, places[s : s + step]) for r, places in zip(*runs(region)) for step in [max(1, PAIRS_AT_ONCE // max(1, self.starts[r + 1] - self.starts[r]))] for s in range(0, len(places), step))
        for r, at in parts:
            a, z = self.starts[r], self.starts[r + 1]
            if a == z:
                continue
            rows = x[i[at]]
            best, cell, farther, apart = _compared(rows, self.centres[a:z])
            reach = self._reach(best, rows, self.holds[a:z][cell], limit)
            wide = reach[:, None] if limit is None else np.float32(np.sqrt(limit))
            window = (farther <= 2 * spread * wide * apart) & asked[at][:, None]
            window[np.arange(len(rows)), cell] = asked[at]
            near = window
            if every and limit is not None:
                near = window | (farther <= np.sqrt(limit) * np.where(own[at], 1, 2)[:, None] * apart + self._slack(rows))
            home[i[at[own[at]]]] = a + cell[own[at]]
            j, c = np.nonzero(near)
            out.append((i[at[j]], a + c, window[j, c]))
        row, cell, asked = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))
        return row, cell, asked, home


def _sampled(df: DataFrame, v: F.Column, h: F.Column, share: float, dimension: int, flag: int) -> DataFrame:
    picked = df.select(v.alias("data"), h.alias("h")).where(F.pmod("h", F.lit(1 << 30)) < F.lit(math.ceil(min(1.0, share) * (1 << 30))))
    return picked.where(is_valid_vector(F.col("data"), dimension)).select("data", "h", F.lit(flag).alias("flag"))


def _matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimension)) + np.float32(0)


def _holds(x: np.ndarray, centres: np.ndarray, home: np.ndarray, share: float, k: int) -> np.ndarray:
    """Per centre a radius that holds k + 1 rows, as three sampled rows more than stand for them tell."""
    least = math.ceil((k + 1) * share) + 3
    holds = np.full(len(centres), np.inf, dtype=np.float32)
    for c, at in zip(*runs(home)):
        d = np.sort(np.sqrt(((x[at] - centres[c]) ** 2).sum(1)))
        holds[c] = d[min(least, len(d)) - 1] if share < 1 or len(d) > k else np.inf
    return holds


FITTED = "region int, centres binary, holds binary, rows binary, asked binary, block binary"


def fit(stored: DataFrame, vector_col: str, s: Shape, k: int, asked: DataFrame | None = None, asked_col: str = "query") -> Cells:
    """Regions and cells of the distinct valid vectors of a table, and where those of ``asked`` will be asked.

    Samples are taken by hash of the vector, so copies weigh nothing and the layout doesn't matter.
    """
    spark = stored.sparkSession
    ship(spark)
    total = stored.count()
    s = replace(s, block_rows=min(s.block_rows, max(s.least_block, total // s.blocks)))
    cells = max(1, total // s.cell_rows)
    regions = max(1, math.ceil(cells / s.region_cells))
    v = F.col(vector_col).cast("array<float>")
    h = F.xxhash64(F.lit(s.seed), v)
    got = _sampled(stored, v, h, s.region_sample * regions / max(total, 1), s.dimension, 1).dropDuplicates(["h"]).orderBy("h").limit(2 * s.region_sample * regions).toArrow()
    x = _matrix(got["data"], s.dimension)
    if not len(x):
        one, zero = np.ones(1, int), np.zeros(1)
        return Cells(np.zeros((1, s.dimension), np.float32), np.full(1, np.inf), np.array([0, 1]), np.zeros((1, s.dimension), np.float32), np.full(1, np.inf), zero, zero, np.zeros(1, int), one, one)
    centres = k_means(x, regions, 4, s.seed)
    share = min(1.0, s.cell_sample / s.cell_rows)
    sample = _sampled(stored, v, h, share, s.dimension, 1)
    if cells == 1:
        share, sample = 1.0, _sampled(stored, v, h, 1.0, s.dimension, 1)
    if asked is not None:
        w = F.col(asked_col).cast("array<float>")
        sample = sample.unionByName(_sampled(asked, w, F.xxhash64(F.lit(s.seed), F.struct(*asked.columns)), share, s.dimension, 0))
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = nearest(_matrix(b.column("data"), s.dimension), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column("flag"), b.column("data")], names=["region", "flag", "data"])

    def cells_of(table: pa.Table) -> pa.Table:
        every, flag = _matrix(table["data"], s.dimension), table["flag"].to_numpy()
        mine = np.unique(every[flag == 1], axis=0)
        if not len(mine):
            mine = shared.value[table["region"][0].as_py()][None]
        c = k_means(mine, max(1, round(len(mine) / share / s.cell_rows)), 4, s.seed)
        home = nearest(mine, c)
        rows = np.bincount(home, minlength=len(c)) / share
        further = np.bincount(nearest(every[flag == 0], c), minlength=len(c)) / share
        out = [c, _holds(mine, c, home, share, k), rows, further, halved(c, rows, s.block_rows)]
        kinds = [np.float32, np.float32, np.float64, np.float64, np.int64]
        return pa.table([pa.array([table["region"][0].as_py()], pa.int32()), *(pa.array([np.ascontiguousarray(o, dtype=t).tobytes()], pa.binary()) for o, t in zip(out, kinds))], names=["region", "centres", "holds", "rows", "asked", "block"])

    placed = sample.mapInArrow(place, "region int, flag int, data array<float>")
    found = placed.groupBy("region").applyInArrow(cells_of, FITTED).toArrow().sort_by("region").to_pylist()  # centres only
    parts = [[np.frombuffer(r[f], t) for r in found] for f, t in (("centres", np.float32), ("holds", np.float32), ("rows", np.float64), ("asked", np.float64), ("block", np.int64))]
    c = np.concatenate(parts[0]).reshape(-1, s.dimension)
    counts = np.array([len(p) for p in parts[1]])
    used = np.array([r["region"] for r in found])
    regional = centres[used]
    rows, further = np.concatenate(parts[2]), np.concatenate(parts[3])
    starts = np.r_[0, np.cumsum(counts)]
    block = numbered(regional, starts, rows, parts[4], s.block_rows)
    alone = np.bincount(block)[block] == 1
    split = lambda n: np.where(alone, np.maximum(1, np.ceil(n / s.block_rows)), 1).astype(int)
    return Cells(regional, _holds(x, regional, nearest(x, regional), min(1.0, s.region_sample * regions / total), k), starts, c, np.concatenate(parts[1]), rows, further, block, split(rows), split(1.5 * rows + further))


def numbered(regions: np.ndarray, starts: np.ndarray, rows: np.ndarray, local: list[np.ndarray], most: int) -> np.ndarray:
    """Numbers of blocks over all regions from those within each; small neighbouring regions become one block."""
    total = np.add.reduceat(rows, starts[:-1]) if len(rows) else np.zeros(0)
    small = np.array([b.max(initial=0) == 0 for b in local])
    out, number = [np.zeros(0, int)] * len(local), 0
    group = halved(regions[small], total[small], most) if small.any() else np.zeros(0, int)
    for r, g in zip(np.flatnonzero(small), group):
        out[r] = np.full(len(local[r]), g)
    number = int(group.max(initial=-1)) + 1
    for r in np.flatnonzero(~small):
        out[r] = local[r] + number
        number += int(local[r].max()) + 1
    return np.concatenate(out)
