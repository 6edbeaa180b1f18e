"""Collision-counting search inside one block of vectors (plain numpy, no Spark)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of one window mask handled at once, so that the masks of a step stay in a core's cache.
MASK_BYTES = 1 << 15
#: Distances of a product held at once.
LINK_CELLS = 1 << 18
#: Candidate pairs verified at once.
VERIFY_PAIRS = 1 << 14


@dataclass(frozen=True)
class Collisions:
    """The hash family and its limits.

    projections: single-projection sorted arrays per block. threshold: collisions a candidate needs.
    width: half a window in units of (search radius / sqrt(dimension)); a pair at exactly the search radius
    then collides in one projection with probability 0.87, and in at least ``threshold`` of them with 0.99.
    probes: queries of a block whose exact k-th distances tell its first radii. shares: the shares of the
    probes that those radii satisfy; the last radius is always the distance limit. steps: cuts of a sorted array.
    """

    projections: int = 16
    threshold: int = 10
    width: float = 1.5
    probes: int = 32
    shares: tuple[float, ...] = (0.5, 0.85)
    steps: int = 64
    seed: int = 7


def directions(dimension: int, c: Collisions) -> np.ndarray:
    a = np.random.default_rng(c.seed).standard_normal((dimension, c.projections))
    return (a / np.linalg.norm(a, axis=0)).astype(np.float32)


def _verify(q: np.ndarray, b: np.ndarray, qi: np.ndarray, bi: np.ndarray) -> np.ndarray:
    out = np.empty(len(qi), dtype=np.float64)
    for s in range(0, len(qi), VERIFY_PAIRS):
        diff = q[qi[s : s + VERIFY_PAIRS]] - b[bi[s : s + VERIFY_PAIRS]]
        out[s : s + VERIFY_PAIRS] = np.einsum("ij,ij->i", diff, diff)
    return out


def exact(q: np.ndarray, b: np.ndarray, qi: np.ndarray, bi: np.ndarray) -> np.ndarray:
    """Squared distances in double precision."""
    out = np.empty(len(qi), dtype=np.float64)
    for s in range(0, len(qi), VERIFY_PAIRS):
        diff = q[qi[s : s + VERIFY_PAIRS]].astype(np.float64) - b[bi[s : s + VERIFY_PAIRS]]
        out[s : s + VERIFY_PAIRS] = np.einsum("ij,ij->i", diff, diff)
    return out


def _place(group: np.ndarray) -> np.ndarray:
    """The place of each entry in its run of equal groups, from 0."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=int)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))


def _first(group: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k smallest distances of each group, group by group; of equal ones those that come first."""
    order = np.argsort(group + distance / (float(distance.max(initial=0.0)) * 1.001 + 1e-30), kind="stable")
    return order[_place(group[order]) < k]


def at_least(masks: list[np.ndarray], threshold: int) -> np.ndarray:
    """The bits set in at least ``threshold`` of the masks, counted for 64 rows at once by adders on whole words."""
    planes: list[list[np.ndarray]] = [list(masks)]
    weight = 0
    while weight < len(planes):
        plane = planes[weight]
        while len(plane) > 1:
            if len(planes) == weight + 1:
                planes.append([])
            a, b = plane.pop(), plane.pop()
            carry, odd = a & b, a ^ b
            if plane:
                c = plane.pop()
                carry |= odd & c
                odd ^= c
            plane.append(odd)
            planes[weight + 1].append(carry)
        weight += 1
    more, equal = np.zeros_like(masks[0]), ~np.zeros_like(masks[0])
    for weight in range(max(len(planes), threshold.bit_length()) - 1, -1, -1):
        bit = planes[weight][0] if weight < len(planes) and planes[weight] else np.zeros_like(more)
        if threshold >> weight & 1:
            equal = equal & bit
        else:
            more |= equal & bit
            equal = equal & ~bit
    return more | equal


class Block:
    """Sorted arrays of the projections of a block's stored vectors. ``ids`` ascend.

    Each array is cut at equal steps of the projected value, and for every cut the rows before it are kept as a
    bitmap; a window, which reaches to the ends of its outer steps, is the difference of two of these. Collisions are
    counted bitwise, 64 rows to a word, so counting costs a fraction of computing the distances.
    """

    def __init__(self, stored: np.ndarray, ids: np.ndarray, c: Collisions):
        self.stored, self.ids, self.c = stored, ids, c
        self.a = directions(stored.shape[1], c)
        p = stored @ self.a
        n, m = p.shape
        self.low = p.min(axis=0) if n else np.zeros(m, np.float32)
        self.per = c.steps / np.maximum((p.max(axis=0) if n else self.low) - self.low, 1e-9)
        step = np.minimum(((p - self.low) * self.per).astype(np.int32), c.steps - 1)
        bits = np.zeros((m, c.steps + 1, -(-n // 64) * 8), dtype=np.uint8)
        for own, steps in zip(bits, step.T):
            packed = np.packbits(steps < np.arange(c.steps + 1)[:, None], axis=1, bitorder="little")
            own[:, : packed.shape[1]] = packed
        self.before = bits.view(np.uint64)

    def collide(self, projected: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, stored) of the pairs that share enough query-centred windows of ``half`` width either side."""
        at = (projected - self.low) * self.per
        wide = half * self.per
        first = np.clip(np.floor(at - wide), 0, self.c.steps).astype(np.intp)
        past = np.clip(np.floor(at + wide) + 1, 0, self.c.steps).astype(np.intp)
        masks = [b.take(z, axis=0) ^ b.take(a, axis=0) for b, a, z in zip(self.before, first.T, past.T)]
        hit = at_least(masks, self.c.threshold)
        word = np.flatnonzero(hit)
        bit = np.unpackbits(hit.ravel()[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.nonzero(bit)
        row, w = np.divmod(word[i], hit.shape[1])
        return row, w * 64 + j

    def _verified(self, q: np.ndarray, active: np.ndarray, qi: np.ndarray, bi: np.ndarray) -> np.ndarray:
        """Single-precision squared distances of candidate pairs, as one product where they are many."""
        if len(qi) < 0.08 * len(active) * len(self.stored):
            return _verify(q, self.stored, active[qi], bi)
        centre = self.stored.mean(axis=0)
        x, y = q[active] - centre, self.stored - centre
        d = np.einsum("ij,ij->i", y, y)[None] - 2 * (x @ y.T)
        d += np.einsum("ij,ij->i", x, x)[:, None]
        return np.maximum(d[qi, bi], 0).astype(np.float64)

    def _all(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of all stored vectors, for queries that windows of no radius satisfy."""
        if len(self.stored) <= most:
            return tuple(x.ravel() for x in np.indices((len(q), len(self.stored))))
        centre = self.stored.mean(axis=0)
        x = self.stored - centre
        d = np.einsum("ij,ij->i", x, x)[None] - 2 * ((q - centre) @ x.T)
        near = np.sort(np.argpartition(d, most, axis=1)[:, :most], axis=1)
        return np.repeat(np.arange(len(q)), most), near.ravel()

    def radii(self, q: np.ndarray, q_ids: np.ndarray, k: int, limit: float | None) -> list[float]:
        """Radii of the virtual rehashes: enough for growing shares of the probes, then the limit."""
        at = np.unique(np.linspace(0, len(q) - 1, self.c.probes).astype(int))
        top = np.inf if limit is None else float(np.sqrt(limit))
        if len(self.ids) <= k:
            return [top]
        step, kth = max(1, LINK_CELLS // len(self.ids)), []
        for s in range(0, len(at), step):
            rows = at[s : s + step]
            qi, bi = (x.ravel() for x in np.indices((len(rows), len(self.ids))))
            d = _verify(q, self.stored, rows[qi], bi)
            d[q_ids[rows[qi]] == self.ids[bi]] = np.inf
            kth.append(np.sqrt(np.partition(d.reshape(len(rows), -1), k - 1, axis=1)[:, k - 1]))
        kth = np.concatenate(kth)
        kth = kth[(kth < top) & (kth > 0)]
        return sorted({*(float(np.quantile(kth, s)) * 1.05 for s in self.c.shares if len(kth))} - {top} | {top}) if len(kth) else [top]

    def search(self, q: np.ndarray, q_ids: np.ndarray, k: int, limit: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, stored row, squared distance) of the k nearest other vectors of each query.

        Windows start narrow and widen by virtual rehashing; a query is done at the first radius within which
        it has k verified vectors, or at the last. With ``limit`` the last radius is its root and only pairs
        within it are kept; without, the last step verifies every stored vector of the block. Of equal
        distances the smaller id comes first.
        """
        dim, n = self.stored.shape[1], len(self.stored)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if n and len(q):
            radii = self.radii(q, q_ids, k, limit)
            projected = q @ self.a
        step = max(64, MASK_BYTES * 8 // max(n, 1))
        for s in range(0, len(q) if n else 0, step):
            active = np.arange(s, min(s + step, len(q)))
            for radius in radii:
                last = radius == radii[-1]
                if np.isinf(radius):
                    qi, bi = self._all(q[active], k + 5)
                else:
                    qi, bi = self.collide(projected[active], self.c.width * radius / np.sqrt(dim))
                other = q_ids[active[qi]] != self.ids[bi]
                qi, bi = qi[other], bi[other]
                d = self._verified(q, active, qi, bi)
                near = d <= radius * radius * (1 + 1e-3) if np.isfinite(radius) else np.ones(len(d), bool)
                qi, bi, d = qi[near], bi[near], d[near]
                done = (np.bincount(qi, minlength=len(active)) >= k) | last
                take = done[qi]
                qi, bi, d = qi[take], bi[take], d[take]
                short = _first(qi, d, k + 4)
                qi, bi = active[qi[short]], bi[short]
                d = exact(q, self.stored, qi, bi)
                again = np.lexsort((self.ids[bi], d, qi))
                qi, bi, d = qi[again], bi[again], d[again]
                keep = _place(qi) < k
                if limit is not None:
                    keep &= d <= limit
                found.append((qi[keep], bi[keep], d[keep]))
                active = active[~done]
                if not len(active):
                    break
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row connected with each of n rows through the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) join all labels that the pairs join, the closest first and no more than needed.

    ``label`` is as from :func:`components`.
    """
    left, chosen = np.arange(len(a)), [np.zeros(0, int)]
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return np.concatenate(chosen)
        both, ends = np.r_[left, left], np.r_[label[a[left]], label[b[left]]]
        order = np.lexsort((both, distance[both], ends))
        closest = np.unique(both[order[_place(ends[order]) < 1]])
        chosen.append(closest)
        label = components(len(label), np.r_[np.arange(len(label)), a[closest]], np.r_[label, b[closest]])


@dataclass(frozen=True)
class Stored:
    """The vectors of a block alone, for :func:`bridges`."""

    stored: np.ndarray


def bridges(block: Block | Stored, q: np.ndarray, at: np.ndarray, label_q: np.ndarray, label_b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The closest pair within ``limit`` of every two labels, over the queries ``at`` and all stored vectors."""
    none = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    if not len(at) or len(np.unique(np.r_[label_q[at], label_b])) < 2:
        return none
    b2, q2 = (np.einsum("ij,ij->i", v, v, dtype=np.float64).astype(np.float32) for v in (block.stored, q))
    slack = 1e-5 * float(max(b2.max(), q2.max()))
    most = max(int(label_q.max()), int(label_b.max())) + 1

    def closest(qi: np.ndarray, bi: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pair = np.minimum(label_q[qi], label_b[bi]) * most + np.maximum(label_q[qi], label_b[bi])
        order = np.lexsort((d, pair))
        keep = order[_place(pair[order]) < 1]
        return qi[keep], bi[keep], d[keep]

    parts = []
    step = max(1, LINK_CELLS // len(b2))
    for s in range(0, len(at), step):
        rows = at[s : s + step]
        d = b2[None] - 2 * (q[rows] @ block.stored.T) + q2[rows][:, None]
        qi, bi = np.nonzero((d <= limit + slack) & (label_q[rows][:, None] != label_b[None]))
        if len(qi):
            d = exact(q, block.stored, rows[qi], bi)
            ok = d <= limit
            parts.append(closest(rows[qi[ok]], bi[ok], d[ok]))
    if not parts:
        return none
    return closest(*(np.concatenate(x) for x in zip(*parts)))
