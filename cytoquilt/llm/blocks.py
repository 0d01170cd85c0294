"""Block exchange: documents in buckets ask how often hashed keys occur in the whole corpus.

Three shuffles, none of which has a hot key:
1. `Buckets.docs`: whole documents go to buckets by a hash of their id. Spark reuses this
   exchange wherever the plan needs it, so texts are shuffled once.
2. Each bucket sends its *distinct* keys with counts, in sorted order, as one packed block
   for each shard (a range of hashes), so a key that a third of all documents hold counts
   once for each bucket. Shards add up and decide.
3. Each shard answers every block; answers go back to the buckets and meet the documents.

Buckets and shards both grow with the input, and their product with its square. So no bucket
writes more than FAN blocks: with more shards than that, buckets send to FAN regions of
shards; in each region, teams of TEAM buckets are merged, which also combines hot keys, and
write at most FAN blocks to the region's shards; answers come back the same way. Blocks grow
in proportion to the input (`most_blocks`), and what a task holds is bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import BUCKET_BYTES, field, parts_for, scan_bytes, tune

#: Blocks that a bucket or a team writes at most, and buckets in a team.
FAN, TEAM = 8192, 8192
KEY16 = np.dtype([("lo", "<u8"), ("hi", "<u8")])
NULL_ID = -(1 << 63)

_COLUMNS = {"region": LongType(), "team": LongType(), "shard": LongType(), "bucket": LongType(), "lead": LongType(), "keys": BinaryType(), "values": BinaryType()}
BLOCK = StructType([StructField(n, t) for n, t in _COLUMNS.items()])
_ARROW = pa.schema([(n, pa.binary() if isinstance(t, BinaryType) else pa.int64()) for n, t in _COLUMNS.items()])


def _table(rows: list[tuple]) -> pa.Table:
    """Rows (region, team, shard, bucket, lead, keys, values)."""
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


# ---- packing


def pack_keys(keys: np.ndarray, drop: int = 0) -> bytes:
    """Sorted keys as a first key and differences, byte by byte: low bytes as they are, the highest one compressed.

    Most differences need a byte less than the largest. `drop` low bits are all zero.
    """
    if not len(keys):
        return b""
    if keys.dtype == KEY16:
        low = pack_keys(keys["lo"])
        return len(low).to_bytes(4, "little") + low + keys["hi"].tobytes()
    keys = keys >> np.uint64(drop)
    d = np.diff(keys)
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 1
    planes = d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    top = planes[-1].tobytes()
    thin = zlib.compress(top, 1) if len(top) > 64 else top
    flag = 16 if len(thin) < len(top) else 0
    return bytes([width | flag]) + keys[:1].astype("<u8").tobytes() + len(d).to_bytes(4, "little") + planes[:-1].tobytes() + (thin if flag else top)


def unpack_keys(raw: bytes, kind=np.dtype(np.uint64), drop: int = 0) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    if kind == KEY16:
        size = int.from_bytes(raw[:4], "little")
        low = unpack_keys(raw[4 : 4 + size])
        out = np.empty(len(low), KEY16)
        out["lo"], out["hi"] = low, np.frombuffer(raw, "<u8", offset=4 + size)
        return out
    width, n = raw[0] & 15, int.from_bytes(raw[9:13], "little")
    d = np.zeros((n + 1, 8), np.uint8)
    d[0] = np.frombuffer(raw, np.uint8, 8, 1)
    cut = 13 + n * (width - 1)
    d[1:, : width - 1] = np.frombuffer(raw, np.uint8, n * (width - 1), 13).reshape(width - 1, n).T
    d[1:, width - 1] = np.frombuffer(zlib.decompress(raw[cut:]) if raw[0] & 16 else raw[cut:], np.uint8)
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64) << np.uint64(drop)


def pack_counts(n: np.ndarray) -> bytes:
    top = int(n.max()) if len(n) else 0
    kind = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = n.astype(f"<u{kind}").view(np.uint8).reshape(-1, kind).T.tobytes()  # like bytes together compress better
    return bytes([kind | 16]) + planes if len(planes) < 32 else bytes([kind]) + zlib.compress(planes, 1)


def unpack_counts(raw: bytes) -> np.ndarray:
    kind = raw[0] & 15
    planes = np.frombuffer(raw[1:] if raw[0] & 16 else zlib.decompress(raw[1:]), np.uint8).reshape(kind, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{kind}").ravel().astype(np.int64)


class Plain:
    """How keys are packed: as they are."""

    def __init__(self, kind=np.uint64):
        self.kind = np.dtype(kind)

    def pack(self, keys: np.ndarray) -> bytes:
        return pack_keys(keys)

    def unpack(self, raw: bytes) -> np.ndarray:
        return unpack_keys(raw, self.kind)


# ---- keys


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the keys' high half: sorted keys are sorted by shard too."""
    low = keys["lo"] if keys.dtype == KEY16 else keys
    return (((low >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys, for the shards that have any."""
    if len(keys):
        of = shard_of(keys, shards)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(keys)]])
        yield from zip(of[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist())


def distinct(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, sum of their counts, place of every key among them)."""
    order = np.lexsort((keys["hi"], keys["lo"])) if keys.dtype == KEY16 else np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    n = np.ones(len(k), np.int64) if counts is None else counts[order]
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[start], np.add.reduceat(n, start) if len(start) else np.zeros(0, np.int64), place


def places(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of every key among distinct sorted ones, or -1."""
    if not len(sorted_keys) or not len(keys):
        return np.full(len(keys), -1)
    if keys.dtype != KEY16:
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == keys, at, -1)
    lo = np.ascontiguousarray(sorted_keys["lo"])
    at = np.minimum(np.searchsorted(lo, keys["lo"]), len(lo) - 1)
    same = lo[at] == keys["lo"]
    out = np.where(same & (sorted_keys["hi"][at] == keys["hi"]), at, -1)
    for i in np.flatnonzero(same & (out < 0)):  # equal low halves of different keys
        j = int(at[i])
        while j < len(lo) and lo[j] == keys["lo"][i]:
            if sorted_keys["hi"][j] == keys["hi"][i]:
                out[i] = j
            j += 1
    return out


# ---- the exchange


class Buckets:
    """Documents dealt to buckets, and how many buckets and shards there are."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), shard_bytes: int = 8 << 20):
        tune(docs.sparkSession)
        self.parts = parts_for(docs)
        size = scan_bytes(docs)
        self.n, self.shards = sizes(size, self.parts, shard_bytes)
        self.id_col, self.carry = id_col, carry
        self.fields = [field(docs, id_col), *(field(docs, c) for c in carry)]
        self.docs = docs.select(
            F.pmod(F.xxhash64(F.col(id_col)), F.lit(self.n)).cast("long").alias("bucket"),
            F.col(id_col).alias("k0"),
            *(F.col(c).alias(f"k{i + 1}") for i, c in enumerate(carry)),
            F.col(text_col).cast("binary").alias("raw"),
        ).repartition(self.parts, "bucket")

    def exchange(self, question: Callable, decide: Callable, packing=None, whole: bool = False, after: DataFrame | None = None) -> DataFrame:
        """Rows BLOCK of answers for every bucket.

        question(table of one bucket[, its answers to an earlier question]) -> (sorted distinct
        keys, counts). decide(keys, counts in the corpus) -> (values of the keys, a number for
        the whole shard, which its first asker gets as `lead`). Answers hold the keys with a
        value above 0; with `whole`, the values of all keys asked, without the keys.
        """
        packing = packing or Plain()
        shards, fan, team = self.shards, FAN, TEAM
        deep = shards > fan
        subs = -(-shards // fan) if deep else 1
        targets = -(-shards // subs)  # regions if there are any, else shards

        def ask(table: pa.Table) -> pa.Table:
            return put(table, *question(table))

        def ask_again(table: pa.Table, answers: pa.Table) -> pa.Table:
            return put(table, *question(table, answers.to_pylist())) if table.num_rows else _table([])

        def put(table: pa.Table, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            return _table([(s // subs, bucket // team, s, bucket, 0, packing.pack(keys[a:b]), pack_counts(counts[a:b])) for s, a, b in _ranges(keys, shards, subs)])

        def merged(rows: list[dict]) -> tuple:
            keys = [packing.unpack(r["keys"]) for r in rows]
            cut = np.cumsum([len(k) for k in keys])[:-1]
            return *distinct(np.concatenate(keys), np.concatenate([unpack_counts(r["values"]) for r in rows])), cut

        def forward(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            keys, counts, _, _ = merged(rows)
            return _table([(rows[0]["region"], rows[0]["team"], s, rows[0]["team"], 0, packing.pack(keys[a:b]), pack_counts(counts[a:b])) for s, a, b in by_shard(keys, shards)])

        def reply(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            keys, counts, place, cut = merged(rows)
            values, lead = decide(keys, counts)
            out = []
            for i, (r, at) in enumerate(zip(rows, np.split(place, cut))):
                if not whole:
                    at = at[values[at] > 0]
                if len(at) or i == 0 and lead:
                    out.append((r["region"], r["team"], r["shard"], r["bucket"], lead if i == 0 else 0, None if whole else packing.pack(keys[at]), pack_counts(values[at])))
            return _table(out)

        def back(asked: pa.Table, told: pa.Table) -> pa.Table:
            rows, answers = asked.to_pylist(), sorted(told.to_pylist(), key=lambda r: r["shard"])
            if not rows or not answers:
                return _table([])
            values = np.concatenate([unpack_counts(r["values"]) for r in answers])
            lead, out = sum(r["lead"] for r in answers), []
            if whole:
                _, _, place, cut = merged(rows)
                for i, (r, at) in enumerate(zip(rows, np.split(place, cut))):
                    out.append((r["region"], r["team"], r["shard"], r["bucket"], lead if i == 0 else 0, None, pack_counts(values[at])))
                return _table(out)
            keys = np.concatenate([packing.unpack(r["keys"]) for r in answers])
            for i, r in enumerate(rows):
                own = packing.unpack(r["keys"])
                at = places(keys, own)
                hit = at >= 0
                if hit.any() or i == 0 and lead:
                    out.append((r["region"], r["team"], r["shard"], r["bucket"], lead if i == 0 else 0, packing.pack(own[hit]), pack_counts(values[at[hit]])))
            return _table(out)

        if after is None:
            asked = self.docs.groupBy("bucket").applyInArrow(ask, BLOCK)
        else:
            asked = self.docs.groupBy("bucket").cogroup(after.groupBy("bucket")).applyInArrow(ask_again, BLOCK)
        tasks = max(12, min(shards, 400_000) // 2)
        if not deep:
            return asked.repartition(max(12, targets // 2), "shard").groupBy("shard").applyInArrow(reply, BLOCK)
        met = asked.repartition(tasks, "region", "team")
        told = met.groupBy("region", "team").applyInArrow(forward, BLOCK).repartition(tasks, "shard").groupBy("shard").applyInArrow(reply, BLOCK)
        return met.groupBy("region", "team").cogroup(told.groupBy("region", "team")).applyInArrow(back, BLOCK)

    def meet(self, answers: DataFrame, tell: Callable, schema: StructType) -> DataFrame:
        """tell(table of one bucket, its answers as a list of dicts) -> columns of schema, after the id and carried columns."""
        n_kept = len(self.fields)
        out = StructType([*self.fields, *schema.fields])
        arrow = to_arrow(schema)
        names = [f.name for f in out.fields]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            cols = tell(left, right.to_pylist()) if left.num_rows else [[] for _ in arrow]
            return pa.Table.from_arrays([left.column(1 + i) for i in range(n_kept)] + [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(cols, arrow)], names=names)

        return self.docs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, out)


def _ranges(keys: np.ndarray, shards: int, subs: int) -> Iterator[tuple[int, int, int]]:
    """by_shard, of runs of `subs` shards each: (first shard of the run, from, to)."""
    if subs == 1:
        yield from by_shard(keys, shards)
    elif len(keys):
        region = shard_of(keys, shards) // subs
        cut = np.concatenate([[0], np.flatnonzero(np.diff(region)) + 1, [len(keys)]])
        yield from zip((region[cut[:-1]] * subs).tolist(), cut[:-1].tolist(), cut[1:].tolist())


def sizes(size: int, parts: int = 1, shard_bytes: int = 8 << 20) -> tuple[int, int]:
    """(buckets, shards) of an input of so many bytes."""
    return int(max(48, 4 * parts, size // BUCKET_BYTES)), int(min(max(48, size // shard_bytes), FAN * FAN))


def most_blocks(size: int, shard_bytes: int = 8 << 20) -> int:
    """Blocks that an exchange over so many bytes writes at most: buckets' and teams'."""
    n, shards = sizes(size, 1, shard_bytes)
    if shards <= FAN:
        return n * shards
    subs = -(-shards // FAN)
    return n * FAN + -(-n // TEAM) * FAN * subs


def to_arrow(schema: StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


def texts(table: pa.Table) -> Iterator[bytes]:
    for x in table.column("raw"):
        yield x.as_py() or b""


def ids(table: pa.Table) -> list[int]:
    return [NULL_ID if x is None else x for x in table.column("k0").to_pylist()]
