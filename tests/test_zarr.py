import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from cytoquilt.sources import zarr as Z
from cytoquilt.sources.store import StoreError


def cells(df):
    return sorted((r.row_id, r.col_id, r.value) for r in df.collect())


@pytest.mark.parametrize("codec", ["zstd", "gzip", "none"])
@pytest.mark.parametrize("shard", [None, (4, 6)])
def test_dense(spark, tmp_path, codec, shard):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (11, 7)).astype(np.float32)
    x[:4] = 0
    Z.write_array(f"{tmp_path}/x", x, (2, 3), codec, shard=shard)
    want = sorted((int(i), int(j), float(x[i, j])) for i, j in zip(*x.nonzero()))
    assert cells(Z.read_matrix(spark, f"{tmp_path}/x")) == want
    assert [r.vec for r in Z.read_obsm(spark, f"{tmp_path}/x").orderBy("row_id").collect()] == x.astype(float).tolist()


def test_csr_group_and_missing_chunk(spark, tmp_path):
    rows = [(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0), (4, 0, 4.0), (4, 2, 5.0)]
    x = spark.createDataFrame(rows, "row_id long, col_id long, value double")
    p = str(tmp_path / "s")
    Z.write_group(p, {"encoding-type": "anndata"})
    Z.write_csr(x, f"{p}/X", 6, 3, flat_chunk=2)
    assert cells(Z.read_matrix(spark, f"{p}/X", rows_each=2)) == rows
    ann = Z.read_store(spark, p)
    assert ann.obs.count() == 6 and ann.var.count() == 3 and cells(ann.x) == rows
    (tmp_path / "s/X/data/c/1").unlink()
    assert [v for *_, v in cells(Z.read_matrix(spark, f"{p}/X"))] == [1.0, 2.0, 0.0, 0.0, 5.0]
    with pytest.raises(StoreError):
        Z.read_matrix(spark, p)
    Z.write_csr(x.where("false"), f"{p}/empty", 2, 2)
    assert cells(Z.read_matrix(spark, f"{p}/empty")) == []


def frame(raw, item, block, kind, split):
    """A Blosc frame: bytes shuffled, blocks compressed as one stream, or one for each byte of an item."""
    number = {"lz4": 1, "snappy": 2, "zlib": 3, "zstd": 4}[kind]
    pack = {"zlib": zlib.compress, "zstd": zstandard.ZstdCompressor(level=5).compress}.get(kind) or (lambda b: pa.Codec("lz4_raw" if kind == "lz4" else kind).compress(b, asbytes=True))
    blocks = []
    for at in range(0, len(raw), block):
        part = raw[at : at + block]
        even = len(part) // item * item
        part = np.frombuffer(part, np.uint8, even).reshape(-1, item).T.tobytes() + part[even:]
        n = item if split and len(part) == block else 1
        streams = [part[i * len(part) // n : (i + 1) * len(part) // n] for i in range(n)]
        blocks.append(b"".join(struct.pack("<i", len(c)) + c for c in (min(pack(x), x, key=len) for x in streams)))
    starts, at = [], 16 + 4 * len(blocks)
    for b in blocks:
        starts.append(at)
        at += len(b)
    return struct.pack("<BBBBIII", 2, 1, 1 | (0 if split else 0x10) | number << 5, item, len(raw), block, at) + b"".join(struct.pack("<I", x) for x in starts) + b"".join(blocks)


@pytest.mark.parametrize("kind", ["lz4", "snappy", "zlib", "zstd"])
@pytest.mark.parametrize("split", [False, True])
def test_blosc(spark, tmp_path, kind, split):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (64, 50)).astype(np.float32)
    raw = x.tobytes()
    for data in (raw, rng.bytes(999), b""):
        assert Z.unblosc(frame(data, 4, 1024, kind, split)) == data
    assert Z.unblosc(struct.pack("<BBBBIII", 2, 1, 2, 4, 5, 5, 21) + b"plain") == b"plain"
    Z.write_array(f"{tmp_path}/x", x, (64, 50), "none")
    meta = json.loads((tmp_path / "x/zarr.json").read_text())
    meta["codecs"].append({"name": "blosc", "configuration": {"cname": kind, "clevel": 5, "shuffle": "shuffle", "typesize": 4, "blocksize": 0}})
    (tmp_path / "x/zarr.json").write_text(json.dumps(meta))
    (tmp_path / "x/c/0/0").write_bytes(frame(raw, 4, 1024, kind, split))
    assert cells(Z.read_matrix(spark, f"{tmp_path}/x")) == sorted((int(i), int(j), float(x[i, j])) for i, j in zip(*x.nonzero()))
    with pytest.raises(StoreError):
        Z.unblosc(struct.pack("<BBBBIII", 2, 1, 1, 4, 5, 5, 21) + b"aaaaa")
