"""Line dedup by sharded minimal perfect hashing.

1. Documents, in buckets, give the 128-bit hashes of their distinct long lines with the
   number of documents and the largest id; these are added up for the whole corpus.
2. The hashes of lines found in enough documents are cut into shards. A shard is a minimal
   perfect hash over its distinct line hashes and three compact arrays that it indexes: a
   64-bit fingerprint, the number of documents, and the largest of their ids.
3. Documents probe: each bucket sends the hashes of its lines to the shards' arrays, and
   most are turned away there by the fingerprint. Lines themselves are neither shuffled nor
   joined. An index of a large corpus is too large for every task to load, so probes go to
   the shards; each shard is copied as often as its probes need (`salts`).
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .blocks import KEY16, Buckets, by_shard, distinct, ids, texts
from .common import scan_bytes, table

#: White space that a line's key is stripped of: fixed by the contract.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_CHARS, MIN_DOCS = 40, 5
GAMMA, LEVELS = 1.7, 24
#: Bytes of documents whose recurring lines make a shard, shards at most, and buckets that probe one copy of a shard.
INDEX_BYTES, SHARDS, PROBERS = 64 << 20, 4096, 8


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Hash of the stripped line with A-Z lower-cased, or None if it is too short."""
    key = line.strip(BLANK)
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _mix(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    x = lo + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64) + (hi >> np.uint64(7))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


class PerfectHash:
    """Minimal perfect hash: levels of bit arrays in which each key that meets no other sets its own bit.

    A key's index is the number of bits set before its own. Keys that collide go on to the
    next level; the few left after the last one are kept sorted.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        base, lo, hi = 0, keys["lo"], keys["hi"]
        for level in range(LEVELS):
            if not len(lo):
                break
            size = int(GAMMA * len(lo)) + 64
            at = _mix(lo, hi, level) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits = np.packbits(alone, bitorder="little")
            ranks = base + np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])[:-1]
            self.levels.append((size, bits, ranks.astype(np.uint32)))
            base += int(alone.sum())
            left = ~alone[at.astype(np.int64)]
            lo, hi = lo[left], hi[left]
        rest = np.empty(len(lo), KEY16)
        rest["lo"], rest["hi"] = lo, hi
        self.rest, self.base = np.sort(rest, order=["lo", "hi"]), base

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of every key; -1 for keys that are surely not among those it was built for."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = _mix(keys["lo"][todo], keys["hi"][todo], level) % np.uint64(size)
            byte, bit = (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)
            word = bits[byte]
            hit = (word >> bit) & np.uint8(1) == 1
            below = np.bitwise_count(word & ((np.uint8(1) << bit) - np.uint8(1)).astype(np.uint8))
            out[todo[hit]] = ranks[byte[hit]] + below[hit]
            todo = todo[~hit]
            if not len(todo):
                return out
        for i in todo if len(self.rest) else []:
            at = int(np.searchsorted(self.rest["lo"], keys["lo"][i]))
            while at < len(self.rest) and self.rest["lo"][at] == keys["lo"][i]:
                if self.rest["hi"][at] == keys["hi"][i]:
                    out[i] = self.base + at
                at += 1
        return out


class LineIndex:
    """A shard: the perfect hash and the arrays that it indexes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, last: np.ndarray):
        """keys are distinct."""
        self.mph = PerfectHash(keys)
        at = self.mph.index(keys)
        self.mark, self.count, self.last = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64)
        self.mark[at], self.last[at] = keys["hi"], last
        self.count[at] = np.minimum(counts, 0xFFFFFFFF)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents with the line, largest id) for every key; 0 documents for an unknown one."""
        at = self.mph.index(keys)
        known = (at >= 0) & (at < len(self.mark))
        known[known] = self.mark[at[known]] == keys["hi"][known]
        count, last = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        count[known], last[known] = self.count[at[known]], self.last[at[known]]
        return count, last


def dedup_lines(docs: DataFrame, each: Callable, schema: StructType, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The operator: each(kept bytes, number of lines, number dropped) gives the values of `schema` for a document.

    A null text is one empty line. Rows with the same id count as one document and lose the
    same lines; a null id counts as one document, below all others. Columns not named are
    left out, so clashing names do no harm.
    """
    b = Buckets(docs, id_col, text_col, carry)
    shards = int(max(1, min(scan_bytes(docs) // INDEX_BYTES, SHARDS)))
    salts = -(-b.n // (PROBERS * shards))

    def lines_of(t: pa.Table) -> dict[bytes, set[int]]:
        seen: dict[bytes, set[int]] = {}
        for i, raw in zip(ids(t), texts(t)):
            if len(raw) >= min_chars:
                for line in raw.split(b"\n"):
                    if len(line) >= min_chars and (key := line_key(line, min_chars)) is not None:
                        seen.setdefault(key, set()).add(i)
        return seen

    def tally(t: pa.Table) -> pa.Table:
        seen = lines_of(t)
        keys = np.frombuffer(b"".join(seen), KEY16)
        n, last = np.fromiter(map(len, seen.values()), np.int64, len(seen)), np.fromiter(map(max, seen.values()), np.int64, len(seen))
        return pa.table({"lo": keys["lo"].view(np.int64), "hi": keys["hi"].view(np.int64), "n": n, "last": last})

    def build(t: pa.Table) -> pa.Table:
        keys = np.empty(t.num_rows, KEY16)
        keys["lo"], keys["hi"] = (t.column(c).to_numpy().view(np.uint64) for c in ("lo", "hi"))
        return pa.table({"shard": t.column("shard")[:1], "index": pa.array([pickle.dumps(LineIndex(keys, t.column("n").to_numpy(), t.column("last").to_numpy()))], pa.binary())})

    def ask(t: pa.Table) -> pa.Table:
        keys, _, _ = distinct(np.frombuffer(b"".join(lines_of(t)), KEY16))
        bucket = t.column("bucket")[0].as_py()
        rows = [(s, bucket % salts, bucket, keys[x:y].tobytes()) for s, x, y in by_shard(keys, shards)]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "salt", "bucket", "keys"])

    def probe(asked: pa.Table, shard: pa.Table) -> pa.Table:
        rows = []
        if asked.num_rows and shard.num_rows:
            index = pickle.loads(shard.column("index")[0].as_py())
            for bucket, raw in zip(asked.column("bucket").to_pylist(), asked.column("keys").to_pylist()):
                keys = np.frombuffer(raw, KEY16)
                n, last = index.probe(keys)
                if (n >= min_docs).any():
                    rows.append((bucket, keys[n >= min_docs].tobytes(), last[n >= min_docs].tobytes()))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "keys", "last"])

    found = b.docs.groupBy("bucket").applyInArrow(tally, "lo long, hi long, n long, last long")
    common = found.groupBy("lo", "hi").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= min_docs)
    # the same range of hashes as by_shard's
    common = common.withColumn("shard", F.shiftright(F.shiftrightunsigned("lo", 32) * shards, 32))
    index = common.groupBy("shard").applyInArrow(build, "shard long, index binary").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    asked = b.docs.groupBy("bucket").applyInArrow(ask, "shard long, salt long, bucket long, keys binary")
    answers = asked.groupBy("shard", "salt").cogroup(index.groupBy("shard", "salt")).applyInArrow(probe, "bucket long, keys binary, last binary")

    def tell(t: pa.Table, answers: list[dict]) -> list:
        keeper: dict[bytes, int] = {}
        for x in answers:
            keys = x["keys"]
            keeper.update(zip([keys[i : i + 16] for i in range(0, len(keys), 16)], np.frombuffer(x["last"], np.int64).tolist()))
        rows = []
        for i, raw in zip(ids(t), texts(t)):
            lines = raw.split(b"\n")
            if keeper:
                kept = [line for line in lines if len(line) < min_chars or (key := line_key(line, min_chars)) is None or keeper.get(key, i) == i]
            else:
                kept = lines
            rows.append(each(b"\n".join(kept), len(lines), len(lines) - len(kept)))
        return list(zip(*rows))

    return b.meet(answers, tell, schema)


DIGEST = StructType([StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_sha256", StringType())])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), lambda kept, n, gone: (n, gone, hashlib.sha256(kept).hexdigest()), DIGEST)


ORACLE = {
    "op6_line_dedup": """
with l as (
  select doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents))),
k as (select key, max(doc_id) as keeper from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select l.*, (keeper is not null and keeper <> doc_id) as gone from l left join k using (key))
select doc_id, count(*)::bigint as n_lines, sum(gone::int)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by doc_id"""
}
QUERIES = {"op6_line_dedup": op6_line_dedup}
