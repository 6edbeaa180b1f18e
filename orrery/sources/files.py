"""Readers of vector files as Python data sources, and writers used for exchange and tests.

Formats: ``fvecs`` and ``ivecs`` (records of a little-endian int32 length and so many float32 or int32), ``npy`` (a
two-dimensional array), ``vecbin`` (batches of (external_id, values, timestamp) in bincode's standard encoding) and
``ivfshard`` (posting lists of one shard with a list index). Files are read through the local file system, so paths
must be mounted on every executor; files are mapped or read by offset, never taken into memory whole.
"""

from __future__ import annotations

import mmap
import os
import struct
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orrery.schema import InvalidInput
from orrery.session import ship

#: Rows of an input partition of the fixed-size formats.
ROWS = 100_000


class Span(InputPartition):
    """Rows from ``start`` to ``stop`` of a file."""

    def __init__(self, path: str, start: int = 0, stop: int = 0):
        self.path, self.start, self.stop = path, start, stop


def _paths(options: dict) -> list[str]:
    path = options.get("path")
    if not path:
        raise InvalidInput("a path is needed")
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith((".", "_")))
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return [path]


def _limit(options: dict) -> int | None:
    n = int(options.get("maxrows", -1))
    return None if n < 0 else n


def _rows(ids: np.ndarray, x: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    ends = pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(x.ravel(), kind))], names=["id", "values"])


class _FixedReader(DataSourceReader):
    """Rows of one size: every span is read by its own task, by offset."""

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def shape(self, path: str) -> tuple[int, int]:
        raise NotImplementedError

    def block(self, path: str, start: int, stop: int) -> np.ndarray:
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        paths, limit = _paths(self.options), _limit(self.options)
        if len(paths) != 1:
            raise InvalidInput("one file is needed, as rows are numbered by their place in it")
        n = self.shape(paths[0])[0]
        n = n if limit is None else min(n, limit)
        return [Span(paths[0], s, min(s + ROWS, n)) for s in range(0, n, ROWS)] or [Span(paths[0])]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        for s in range(partition.start, partition.stop, 10_000):
            x = self.block(partition.path, s, min(s + 10_000, partition.stop))
            yield _rows(np.arange(s, s + len(x)), x, pa.float32() if x.dtype == np.float32 else pa.int64())


class _VecsReader(_FixedReader):
    kind: type = np.float32

    def shape(self, path: str) -> tuple[int, int]:
        size = os.path.getsize(path)
        if not size:
            return 0, 0
        with open(path, "rb") as f:
            d = struct.unpack("<i", f.read(4))[0]
        if d <= 0 or size % (4 * (d + 1)):
            raise InvalidInput(f"{path} isn't made of records of {d} components")
        return size // (4 * (d + 1)), d

    def block(self, path: str, start: int, stop: int) -> np.ndarray:
        d = self.shape(path)[1]
        raw = np.fromfile(path, dtype="<i4", count=(stop - start) * (d + 1), offset=start * 4 * (d + 1)).reshape(-1, d + 1)
        if (raw[:, 0] != d).any():
            raise InvalidInput(f"{path} mixes dimensions")
        body = np.ascontiguousarray(raw[:, 1:])
        return body.view("<f4") if self.kind is np.float32 else body.astype(np.int64)


class _IvecsReader(_VecsReader):
    kind = np.int64


class _NpyReader(_FixedReader):
    def shape(self, path: str) -> tuple[int, int]:
        x = np.load(path, mmap_mode="r")
        if x.ndim != 2:
            raise InvalidInput(f"{path} has {x.ndim} dimensions, not 2")
        return x.shape

    def block(self, path: str, start: int, stop: int) -> np.ndarray:
        x = np.load(path, mmap_mode="r")[start:stop]
        return np.ascontiguousarray(x, dtype=np.int64 if self.options.get("type") == "int" else np.float32)


class FvecsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self) -> str:
        return "id long, values array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _VecsReader(self.options)


class IvecsSource(FvecsSource):
    @classmethod
    def name(cls) -> str:
        return "ivecs"

    def schema(self) -> str:
        return "id long, values array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        return _IvecsReader(self.options)


class NpySource(FvecsSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "id long, values array<bigint>" if self.options.get("type") == "int" else "id long, values array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    first = data[at]
    for mark, size in ((251, 2), (252, 4), (253, 8)):
        if first == mark:
            if at + 1 + size > len(data):
                raise EOFError
            return int.from_bytes(data[at + 1 : at + 1 + size], "little"), at + 1 + size
    if first > 253:
        raise ValueError("unknown integer size")
    return first, at + 1


def _packed(n: int) -> bytes:
    for below, mark, size in ((251, b"", 1), (1 << 16, b"\xfb", 2), (1 << 32, b"\xfc", 4), (1 << 64, b"\xfd", 8)):
        if n < below:
            return mark + n.to_bytes(size, "little")
    raise InvalidInput("integers have at most 64 bits")


def decode_batches(data: bytes | mmap.mmap, strict: bool = False) -> Iterator[list[tuple[int, np.ndarray, int]]]:
    """Batches of (external_id, values, timestamp). What can't be decoded at the end is left out with a warning, or,
    with ``strict``, an error; ids that don't fit a signed 64-bit integer are an error."""
    view, at = memoryview(data), 0
    while at < len(view):
        rows = []
        try:
            n, place = _varint(view, at)
            for _ in range(n):
                external, place = _varint(view, place)
                size, place = _varint(view, place)
                if place + 4 * size > len(view):
                    raise EOFError
                values = np.frombuffer(view, "<f4", size, place)
                stamp, place = _varint(view, place + 4 * size)
                if external >= 1 << 63 or stamp >= 1 << 63:
                    raise InvalidInput(f"id {external} doesn't fit a signed 64-bit integer")
                rows.append((external, values, stamp))
        except (EOFError, IndexError, ValueError) as e:
            if isinstance(e, InvalidInput) or strict:
                raise InvalidInput(f"a batch at byte {at} can't be decoded") if not isinstance(e, InvalidInput) else e
            warnings.warn(f"left out what follows byte {at}: it can't be decoded", stacklevel=2)
            return
        at = place
        yield rows


def encode_batch(rows: list[tuple[int, list[float], int]]) -> bytes:
    return _packed(len(rows)) + b"".join(_packed(e) + _packed(len(v)) + np.asarray(v, "<f4").tobytes() + _packed(t) for e, v, t in rows)


class _VecbinReader(DataSourceReader):
    """One task per file: the encoding has no index to split it by."""

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        return [Span(p) for p in _paths(self.options)] or [Span("")]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.path or not os.path.getsize(partition.path):
            return
        with open(partition.path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)  # pages come and go batch by batch
        for rows in decode_batches(data, str(self.options.get("strict", "false")).lower() == "true"):
            if rows:
                lists = pa.array([r[1] for r in rows], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), lists, pa.array([r[2] for r in rows], pa.int64())], names=["external_id", "values", "timestamp"])


class VecbinSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecbin"

    def schema(self) -> str:
        return "external_id long, values array<float>, timestamp long"

    def reader(self, schema) -> DataSourceReader:
        return _VecbinReader(self.options)


# Layout of a shard file. Header, list index entry, row of a list.
SHARD_HEADER, SHARD_ENTRY, SHARD_ROW = "<QQIIQQ", "<QIIQQ", "<QQQ"


def _aligned(size: int) -> int:
    return -(-size // 8) * 8


class _ShardReader(DataSourceReader):
    """The wanted lists of a shard file, found by its index."""

    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        return [Span(p) for p in _paths(self.options)] or [Span("")]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        wanted = [int(c) for c in self.options.get("centroidids", "").split(",") if c]
        with open(partition.path, "rb") as f:
            shard, _, dim, lists, index_at, _ = struct.unpack(SHARD_HEADER, f.read(struct.calcsize(SHARD_HEADER)))
            if (asked := self.options.get("shardid")) is not None and int(asked) != shard:
                raise InvalidInput(f"{partition.path} holds shard {shard}")
            f.seek(index_at)
            entries = {}
            for _ in range(lists):
                cid, n, _, at, size = struct.unpack(SHARD_ENTRY, f.read(struct.calcsize(SHARD_ENTRY)))
                entries[cid] = (n, at, size)
            if missing := [c for c in wanted if c not in entries]:
                raise LookupError(f"centroids {missing} aren't in {partition.path}")
            for cid in wanted or sorted(entries):
                n, at, size = entries[cid]
                f.seek(at)
                data = f.read(size)
                head, row = _aligned(4 * dim), _aligned(24 + 4 * dim)
                if len(data) < head + n * row:
                    raise InvalidInput(f"the list of centroid {cid} is cut short")
                if not n:
                    continue
                raw = np.frombuffer(data, np.uint8, n * row, head).reshape(n, row)
                meta = np.ascontiguousarray(raw[:, :24]).view("<i8")
                x = np.ascontiguousarray(raw[:, 24 : 24 + 4 * dim]).view("<f4")
                ends = pa.array((np.arange(n + 1) * dim).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array([cid] * n, pa.int64()), *(pa.array(c) for c in meta.T), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["shard_id", "centroid_id", "id", "external_id", "timestamp", "values"])


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ivfshard"

    def schema(self) -> str:
        return "shard_id long, centroid_id long, id long, external_id long, timestamp long, values array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _ShardReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known to ``spark.read.format``."""
    ship(spark)
    for source in (FvecsSource, IvecsSource, NpySource, VecbinSource, ShardSource):
        spark.dataSource.register(source)


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format(kind).options(**options).load(path)


def write_vecs(path: str, x: np.ndarray) -> None:
    """fvecs or ivecs, by the type of the array."""
    kind = "<f4" if np.issubdtype(x.dtype, np.floating) else "<i4"
    body = np.ascontiguousarray(x.astype(kind)).view("<i4")
    np.concatenate([np.full((len(x), 1), x.shape[1], "<i4"), body], axis=1).tofile(path)


def write_vecbin(df: DataFrame, folder: str) -> None:
    """A ``vecbin`` file per task of (``external_id``, ``values``, ``timestamp``), a batch per Arrow batch."""
    ship(df.sparkSession)
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, written = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.bin"), 0
        with open(f"{name}.tmp", "wb") as f:
            for batch in batches:
                f.write(encode_batch(list(zip(*(batch.column(c).to_pylist() for c in ("external_id", "values", "timestamp"))))))
                written += batch.num_rows
        os.replace(f"{name}.tmp", name)  # a task that is run again replaces its own file
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([written])], names=["file", "rows"])

    stamped = df.select("external_id", "values", "timestamp")
    stamped.mapInArrow(run, "file string, rows long").collect()  # a row per task


def write_shards(postings: DataFrame, centroids: DataFrame, folder: str) -> DataFrame:
    """A shard file ``shard_<id>.bin`` per shard; returns (``file``, ``rows``).

    ``postings`` (shard_id, centroid_id, id, external_id, timestamp, values) and ``centroids`` (centroid_id, shard_id,
    n_vectors, centroid) are those of an index. Sizes of lists are known from the latter, so a task streams its shards'
    rows behind a header and list index that it writes first; a file appears under its name when it is complete.
    """
    spark = postings.sparkSession
    ship(spark)
    os.makedirs(folder, exist_ok=True)
    held: dict[int, list[tuple[int, int, list[float]]]] = {}
    for r in centroids.select("shard_id", "centroid_id", "n_vectors", "centroid").orderBy("shard_id", "centroid_id").collect():  # a row per list
        held.setdefault(r["shard_id"], []).append((r["centroid_id"], r["n_vectors"], r["centroid"]))
    shared = spark.sparkContext.broadcast(held)
    columns = ["shard_id", "centroid_id", "id", "external_id", "timestamp", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, f, left, count = None, None, [], 0

        def heads(until: int | None) -> None:
            """Write the centroids of the lists up to the one whose rows come next."""
            while left and until is not None and left[0][0] <= until or until is None and left:
                cid, _, centroid = left.pop(0)
                c = np.asarray(centroid, "<f4").tobytes()
                f.write(c + b"\0" * (_aligned(len(c)) - len(c)))

        def close() -> tuple[str, int]:
            heads(None)
            f.close()
            os.replace(f.name, f.name[: -len(".tmp")])
            return f.name[: -len(".tmp")], count

        done = []
        for batch in batches:
            shards, lists = (batch.column(c).to_numpy() for c in ("shard_id", "centroid_id"))
            new = np.flatnonzero(np.r_[True, (np.diff(shards) != 0) | (np.diff(lists) != 0)]) if len(shards) else []
            for a, z in zip(new, [*new[1:], len(shards)]):
                if shards[a] != shard:
                    if f:
                        done.append(close())
                    shard, left, count = int(shards[a]), list(shared.value[int(shards[a])]), 0
                    f = open(os.path.join(folder, f"shard_{shard}.bin.tmp"), "wb")
                    dim = len(left[0][2])
                    head, row = _aligned(4 * dim), _aligned(24 + 4 * dim)
                    at = struct.calcsize(SHARD_HEADER) + len(left) * struct.calcsize(SHARD_ENTRY)
                    f.write(struct.pack(SHARD_HEADER, shard, 1, dim, len(left), struct.calcsize(SHARD_HEADER), at))
                    for cid, n, _ in left:
                        f.write(struct.pack(SHARD_ENTRY, cid, n, 0, at, head + n * row))
                        at += head + n * row
                heads(int(lists[a]))
                part = batch.slice(a, z - a)
                raw = np.zeros((z - a, row), np.uint8)
                meta = np.stack([part.column(c).to_numpy() for c in ("id", "external_id", "timestamp")], axis=1).astype("<i8")
                raw[:, :24] = np.ascontiguousarray(meta).view(np.uint8)
                raw[:, 24 : 24 + 4 * dim] = np.ascontiguousarray(part.column("values").flatten().to_numpy().reshape(-1, dim).astype("<f4")).view(np.uint8)
                f.write(raw.tobytes())
                count += int(z - a)
        if f:
            done.append(close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done])], names=["file", "rows"])

    along = postings.select(*columns).repartition("shard_id").sortWithinPartitions("shard_id", "centroid_id", "id")
    written = along.mapInArrow(run, "file string, rows long").collect()  # a row per shard
    return spark.createDataFrame([tuple(r) for r in written], "file string, rows long")
