"""Zarr version 3 arrays and the annotated-matrix groups built of them, read and written without a library.

Codecs: bytes (little endian), gzip, zstd (where zstandard is installed), blosc (read only: zstd, lz4, zlib and
snappy inside, bytes shuffled or not), transpose is not used, and sharding with an index at the end. Local folders; each chunk (or shard) is read by one task.
Writers make flat chunked arrays, and matrices as data, indices and indptr, as other tools read them.
"""

from __future__ import annotations

import gzip
import json
import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AnnMatrix
from .store import StoreError

#: Numeric types of the format.
TYPES = {"int8": "<i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "uint8": "<u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8", "float32": "<f4", "float64": "<f8", "bool": "|b1"}
MISSING = 2**64 - 1


def _zstd():
    try:
        import zstandard
    except ImportError as e:
        raise StoreError("zstd chunks need the zstandard package") from e
    return zstandard


# Fixed values of a Blosc frame (version 1): bits of its flags, and compressors by number.
SHUFFLED, STORED, BITS_SHUFFLED, NOT_SPLIT = 0x1, 0x2, 0x4, 0x10
COMPRESSORS = {1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}


def _inflate(kind: str, raw: bytes, size: int) -> bytes:
    if kind == "zlib":
        return zlib.decompress(raw)
    if kind == "zstd":
        return _zstd().ZstdDecompressor().decompress(raw, max_output_size=size)
    return pa.Codec("lz4_raw" if kind == "lz4" else kind).decompress(raw, size).to_pybytes()


def unblosc(raw: bytes) -> bytes:
    """The bytes of a Blosc frame: blocks of one or of `item` streams each, then the shuffle undone."""
    flags, item = raw[2], raw[3]
    size, block, _ = struct.unpack_from("<III", raw, 4)
    if flags & STORED:
        return raw[16 : 16 + size]
    if flags & BITS_SHUFFLED and item > 0 and not flags & SHUFFLED:
        raise StoreError("Blosc chunks with shuffled bits are not supported")
    kind = COMPRESSORS.get(flags >> 5)
    if kind is None:
        raise StoreError("Blosc chunks by blosclz are not supported")
    out = []
    for k in range(-(-size // block) if block else 0):
        (at,) = struct.unpack_from("<I", raw, 16 + 4 * k)
        length = min(block, size - k * block)
        streams = 1 if flags & NOT_SPLIT or length < block else item
        parts = []
        for _ in range(streams):
            (n,) = struct.unpack_from("<i", raw, at)
            body, want = raw[at + 4 : at + 4 + n], length // streams
            parts.append(body if n == want else _inflate(kind, body, want))
            at += 4 + n
        whole = b"".join(parts)
        if flags & SHUFFLED and item > 1:
            even = length // item * item
            whole = np.frombuffer(whole, np.uint8, even).reshape(item, -1).T.tobytes() + whole[even:]
        out.append(whole)
    return b"".join(out)


def decode(raw: bytes, codecs: list[dict], dtype: str, shape: tuple[int, ...]) -> np.ndarray:
    """One chunk from its bytes, codecs undone from the last."""
    if codecs and codecs[0]["name"] == "sharding_indexed":
        return _decode_shard(raw, codecs[0]["configuration"], dtype, shape)
    for c in reversed(codecs):
        if c["name"] == "gzip":
            raw = gzip.decompress(raw)
        elif c["name"] == "zstd":
            raw = _zstd().ZstdDecompressor().decompressobj().decompress(raw)
        elif c["name"] == "blosc":
            raw = unblosc(raw)
        elif c["name"] == "crc32c":
            raw = raw[:-4]
        elif c["name"] == "bytes":
            kind = np.dtype(TYPES[dtype])
            if c.get("configuration", {}).get("endian") == "big":
                kind = kind.newbyteorder(">")
            return np.frombuffer(raw, kind).reshape(shape).astype(TYPES[dtype])
        else:
            raise StoreError(f"codec {c['name']} is not supported")
    raise StoreError("no bytes codec")


def _decode_shard(raw: bytes, conf: dict, dtype: str, shape: tuple[int, ...]) -> np.ndarray:
    inner = tuple(conf["chunk_shape"])
    grid = [math.ceil(s / i) for s, i in zip(shape, inner)]
    n = math.prod(grid)
    size = 16 * n + (4 if any(c["name"] == "crc32c" for c in conf.get("index_codecs", [])) else 0)
    index = np.frombuffer(raw[-size:] if conf.get("index_location", "end") == "end" else raw[:size], "<u8", 2 * n).reshape(n, 2)
    out = np.zeros(shape, TYPES[dtype])
    for k, (at, length) in enumerate(index.tolist()):
        if at != MISSING:
            place = np.unravel_index(k, grid)
            out[tuple(slice(p * i, (p + 1) * i) for p, i in zip(place, inner))] = decode(raw[at : at + length], conf["codecs"], dtype, inner)
    return out


class Array:
    """Metadata of an array, and its chunks."""

    def __init__(self, path: str):
        self.path = path
        with open(f"{path}/zarr.json") as f:
            self.meta = json.load(f)
        if self.meta.get("node_type") != "array":
            raise StoreError(f"{path} is no array")
        self.shape, self.dtype = tuple(self.meta["shape"]), self.meta["data_type"]
        self.chunk = tuple(self.meta["chunk_grid"]["configuration"]["chunk_shape"])
        self.grid = tuple(math.ceil(s / c) for s, c in zip(self.shape, self.chunk))

    def chunk_path(self, place: tuple[int, ...]) -> str:
        enc = self.meta.get("chunk_key_encoding", {"name": "default"})
        sep = enc.get("configuration", {}).get("separator", "/" if enc["name"] == "default" else ".")
        name = sep.join(map(str, place))
        return f"{self.path}/c{sep}{name}" if enc["name"] == "default" and name else f"{self.path}/{name or 'c'}"

    def read_chunk(self, place: tuple[int, ...]) -> np.ndarray:
        """A chunk cut to the array; a chunk without a file is all fill value."""
        at = self.chunk_path(place)
        if os.path.exists(at):
            with open(at, "rb") as f:
                full = decode(f.read(), self.meta["codecs"], self.dtype, self.chunk)
        else:
            full = np.full(self.chunk, self.meta.get("fill_value") or 0, TYPES[self.dtype])
        return full[tuple(slice(0, min(c, s - p * c)) for p, c, s in zip(place, self.chunk, self.shape))]

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Elements start..stop of a flat array, from the chunks that hold them."""
        stop = self.shape[0] if stop is None else min(stop, self.shape[0])
        if stop <= start:
            return np.zeros(0, TYPES[self.dtype])
        c = self.chunk[0]
        parts = [self.read_chunk((k,)) for k in range(start // c, -(-stop // c))]
        return np.concatenate(parts)[start - start // c * c : stop - start // c * c]


def attributes(path: str) -> dict:
    with open(f"{path}/zarr.json") as f:
        return json.load(f).get("attributes", {})


def read_matrix(spark: SparkSession, path: str, rows_each: int = 4096) -> DataFrame:
    """Triplets of a stored matrix: csr_matrix and csc_matrix groups by bands of majors, dense arrays by chunks."""
    path = path.removeprefix("file://")
    with open(f"{path}/zarr.json") as f:
        meta = json.load(f)
    kind = meta.get("attributes", {}).get("encoding-type")
    schema = "row_id long, col_id long, value double"
    names = ["row_id", "col_id", "value"]
    if meta["node_type"] == "array":
        a = Array(path)
        places = spark.range(math.prod(a.grid), numPartitions=max(1, min(math.prod(a.grid), 10_000)))

        def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = Array(path)
            for b in batches:
                for k in b.column(0).to_pylist():
                    place = tuple(int(p) for p in np.unravel_index(k, mine.grid))
                    x = mine.read_chunk(place)
                    r, c = x.nonzero()
                    yield pa.RecordBatch.from_arrays([pa.array(r + place[0] * mine.chunk[0]), pa.array(c + place[1] * mine.chunk[1]), pa.array(x[r, c].astype(float))], names=names)

        return places.mapInArrow(dense, schema)
    if kind not in ("csr_matrix", "csc_matrix"):
        raise StoreError(f"{path} holds no matrix: {kind}")
    majors = Array(f"{path}/indptr").shape[0] - 1
    bands = -(-majors // rows_each)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ptr, idx, data = Array(f"{path}/indptr"), Array(f"{path}/indices"), Array(f"{path}/data")
        for b in batches:
            for k in b.column(0).to_pylist():
                p = ptr.read(k * rows_each, min((k + 1) * rows_each, majors) + 1).astype(np.int64)
                major = np.repeat(np.arange(k * rows_each, k * rows_each + len(p) - 1), np.diff(p))
                minor, value = idx.read(int(p[0]), int(p[-1])).astype(np.int64), data.read(int(p[0]), int(p[-1])).astype(float)
                cols = (major, minor) if kind == "csr_matrix" else (minor, major)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(value)], names=names)

    return spark.range(bands, numPartitions=max(1, min(bands, 10_000))).mapInArrow(sparse, schema)


def read_obsm(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, vec) of a dense two-dimensional array, chunk rows whole."""
    path = path.removeprefix("file://")
    a = Array(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Array(path)
        for b in batches:
            for k in b.column(0).to_pylist():
                x = np.concatenate([mine.read_chunk((k, c)) for c in range(mine.grid[1])], axis=1).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x)) + k * mine.chunk[0]), pa.array(list(x), pa.list_(pa.float64()))], names=["row_id", "vec"])

    return spark.range(a.grid[0], numPartitions=max(1, min(a.grid[0], 10_000))).mapInArrow(run, "row_id long, vec array<double>")


def write_array(path: str, values: np.ndarray, chunk: tuple[int, ...], codec: str = "zstd", attrs: dict | None = None, shard: tuple[int, ...] | None = None) -> None:
    """One array; with `shard`, chunks are packed into files of that shape with an index at the end."""
    os.makedirs(path, exist_ok=True)
    packers = {"zstd": [{"name": "zstd", "configuration": {"level": 3, "checksum": False}}], "gzip": [{"name": "gzip", "configuration": {"level": 5}}], "none": []}
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, *packers[codec]]
    name = next(k for k, v in TYPES.items() if np.dtype(v) == values.dtype.newbyteorder("<"))
    outer = shard or chunk
    top = [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(chunk), "codecs": codecs, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}], "index_location": "end"}}] if shard else codecs
    meta = {"zarr_format": 3, "node_type": "array", "shape": list(values.shape), "data_type": name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(outer)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": top, "attributes": attrs or {}}
    with open(f"{path}/zarr.json", "w") as f:
        json.dump(meta, f)
    a = Array(path)

    def packed(part: np.ndarray, shape: tuple[int, ...]) -> bytes:
        full = np.zeros(shape, TYPES[name])
        full[tuple(slice(0, s) for s in part.shape)] = part
        raw = full.tobytes()
        return _zstd().ZstdCompressor(level=3).compress(raw) if codec == "zstd" else gzip.compress(raw, 5) if codec == "gzip" else raw

    for k in range(math.prod(a.grid)):
        place = np.unravel_index(k, a.grid)
        part = values[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, outer))]
        if shard:
            grid = [math.ceil(s / c) for s, c in zip(shard, chunk)]
            body, index = [], []
            at = 0
            for j in range(math.prod(grid)):
                q = np.unravel_index(j, grid)
                inner = part[tuple(slice(p * c, (p + 1) * c) for p, c in zip(q, chunk))]
                if inner.size and inner.any():
                    raw = packed(inner, chunk)
                    index.append((at, len(raw)))
                    body.append(raw)
                    at += len(raw)
                else:
                    index.append((MISSING, MISSING))
            raw = b"".join(body) + b"".join(struct.pack("<QQ", *i) for i in index)
        else:
            raw = packed(part, chunk)
        at = a.chunk_path(tuple(int(p) for p in place))
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(raw)


def write_group(path: str, attrs: dict | None = None) -> None:
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/zarr.json", "w") as f:
        json.dump({"zarr_format": 3, "node_type": "group", "attributes": attrs or {}}, f)


def write_csr(x: DataFrame, path: str, n_rows: int, n_cols: int, flat_chunk: int = 1_000_000, codec: str = "zstd") -> None:
    """A csr_matrix group. Rows come to the driver one band at a time, in order, and go out in flat chunks: an export
    to other tools; the engine's own store is Parquet and is written by executors."""
    from ..operators.layout import compressed

    write_group(path, {"encoding-type": "csr_matrix", "encoding-version": "0.1.0", "shape": [n_rows, n_cols]})
    nnz, idx, data = np.zeros(n_rows + 1, np.int64), [], []
    for r in compressed(x).orderBy("row_id").toLocalIterator():
        nnz[r.row_id + 1] = len(r.indices)
        idx.append(np.array(r.indices, np.int32))
        data.append(np.array(r.data, np.float64))
    flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    write_array(f"{path}/indptr", np.cumsum(nnz), (max(1, n_rows + 1),), codec)
    write_array(f"{path}/indices", flat(idx, np.int32), (min(flat_chunk, max(1, int(nnz.sum()))),), codec)
    write_array(f"{path}/data", flat(data, np.float64), (min(flat_chunk, max(1, int(nnz.sum()))),), codec)


def read_store(spark: SparkSession, path: str) -> AnnMatrix:
    """X, layers and obsm of an annotated store; obs and var as their positions (string columns use codecs of other tools)."""
    path = path.removeprefix("file://")
    if attributes(path).get("encoding-type") != "anndata":
        raise StoreError(f"{path} is no annotated store")
    x = read_matrix(spark, f"{path}/X")
    meta = json.load(open(f"{path}/X/zarr.json"))
    shape = meta["shape"] if meta["node_type"] == "array" else meta["attributes"]["shape"]
    inside = lambda g: sorted(os.listdir(f"{path}/{g}")) if os.path.isdir(f"{path}/{g}") else []
    return AnnMatrix(
        obs=spark.range(shape[0]).withColumnRenamed("id", "row_id"),
        var=spark.range(shape[1]).select(F.col("id").alias("col_id"), F.concat(F.lit("g"), "id").alias("var_name")),
        x=x,
        layers={k: read_matrix(spark, f"{path}/layers/{k}") for k in inside("layers") if k != "zarr.json"},
        obsm={k: read_obsm(spark, f"{path}/obsm/{k}") for k in inside("obsm") if k != "zarr.json"},
    )


