"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

1. From a bounded sample, rotations are learned that make the signs of the rotated, centred
   vectors lose least (iterative quantisation, Gong and Lazebnik 2011); several rotations
   from different starts give a long code.
2. Every vector is coded. The code is cut into substrings; each is the key of a table. Their
   width follows the number of vectors, and the number of tables follows the width, so that
   pairs right at the threshold meet with a set recall at every size. More tables are cheaper
   here than a search for near substrings: a table adds one row to a vector, a flipped bit too.
3. Vectors that share a substring are compared by the original vectors in one byte a
   component, with the bound of what rounding can hide: no pair at the threshold fails, and
   few below it pass. Components of these links are clusters.
4. Within clusters all pairs are reranked with the original vectors in double precision, in
   pairs of chunks of a bounded size; each pair of chunks meets once. Equal vectors are one
   class with a count all the way.
Vectors of each length are a table of their own.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from .common import checkpoint, components, parts_for, table, tune
from .neardup import WIDE, Forest, chain_last, propose

#: Vectors that rotations are learned from at most, and steps of each.
SAMPLE, STEPS = 8192, 25
#: Bits of one rotation at most, and classes in a chunk.
ROTATION_BITS, CHUNK = 64, 1024
#: Share of the pairs right at the threshold that shares a substring; pairs planted to measure it.
RECALL, PLANTED = 0.999, 4000


def planted(x: np.ndarray, cosine: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of exactly this cosine at rows of x: half apart in any direction, half towards other rows."""
    a = x[rng.integers(0, len(x), PLANTED)]
    t = np.where(np.arange(PLANTED)[:, None] % 2, rng.normal(size=a.shape), x[rng.integers(0, len(x), PLANTED)] - a)
    t -= (t * a).sum(axis=1, keepdims=True) * a
    long = np.linalg.norm(t, axis=1)
    a, t = a[long > 1e-6], t[long > 1e-6]
    return a, cosine * a + math.sqrt(1 - cosine * cosine) * t / np.linalg.norm(t, axis=1, keepdims=True)


class Coder:
    """Centre and rotations; codes of `tables` substrings of `width` bits.

    Centring widens angles, most so near the centre, and learned bits are not independent;
    so nothing is taken from the angle. Width and tables are chosen, and the recall is
    checked, on pairs planted at the threshold; the width is the one of least cost, in keys
    and chance meetings of `total` rows.
    """

    def __init__(self, x: np.ndarray, total: int, cosine: float, seed: int = 5):
        self.width, self.tables, self.rotations = 0, 1, []
        rng = np.random.default_rng(seed)
        x = np.unique(x, axis=0)
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        if len(x) < 2:
            return
        self._learn(x, 512, rng)
        a, b = planted(x, cosine, rng)
        i, j = rng.integers(0, len(x), (2, PLANTED))
        apart = (x[i] * x[j]).sum(axis=1) < cosine
        near, far = self._alike(a, b), self._alike(x[i[apart]], x[j[apart]])
        cost = {0: float(total)}
        for w in range(4, 31):
            cost[w] = self._needed(near**w) * (1 + total * float((far**w).mean() if len(far) else 0.0) / 8)  # a meeting costs less than a key
        self.width = min(cost, key=cost.get)
        if not self.width:
            return
        self.tables = self._needed(near**self.width)
        while True:
            self._learn(x, self.tables * self.width, rng)
            a, b = planted(x, cosine, rng)
            if (self.code(a) == self.code(b)).any(axis=1).mean() >= RECALL:
                break
            self.tables += -(-self.tables // 8)

    def _learn(self, x: np.ndarray, bits: int, rng: np.random.Generator) -> None:
        """Rotations until there are so many bits, each in a random subspace of its own: every direction counts."""
        d = min(x.shape[1], ROTATION_BITS)
        while len(self.rotations) * d < bits:
            base = np.linalg.qr(rng.normal(size=(x.shape[1], d)))[0]
            v, r = (x - self.mean) @ base, np.eye(d)
            for _ in range(STEPS if len(x) > d else 0):
                u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ wt).T
            self.rotations.append(base @ r)

    def _bits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.mean) @ r >= 0 for r in self.rotations], axis=1)

    def _alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self._bits(a) == self._bits(b)).mean(axis=1)

    @staticmethod
    def _needed(q: np.ndarray) -> int:
        """Least number of tables in which RECALL of pairs meet that meet with these chances in one."""
        low, high = 0, 1
        while high < 1 << 40 and (1 - (1 - q) ** high).mean() < RECALL:
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if (1 - (1 - q) ** mid).mean() < RECALL else (low, mid)
        return high

    def code(self, x: np.ndarray) -> np.ndarray:
        """Table keys (int64) of every vector; rotations' bits are dealt to tables in turn."""
        if not self.width:
            return np.zeros((len(x), 1), np.int64)
        sub = self._bits(x)[:, : self.tables * self.width].reshape(len(x), self.width, self.tables)
        key = np.zeros((len(x), self.tables), np.int64)
        for w in range(self.width):
            key |= sub[:, w].astype(np.int64) << w
        return key + (np.arange(self.tables, dtype=np.int64) << 40)


def in_bytes(x: np.ndarray) -> list[bytes]:
    """Unit vectors as one byte a component, their scale, and the length of what rounding leaves out."""
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300) / 127
    q = np.rint(x / scale).astype(np.int8)
    rest = np.sqrt(((x - q * scale) ** 2).sum(axis=1, keepdims=True))
    tail = np.concatenate([scale, rest], axis=1).astype("<f4").view(np.uint8)
    return [r.tobytes() for r in np.concatenate([q.view(np.uint8), tail], axis=1)]


def from_bytes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rounded vectors, length of what is left out) from rows of bytes."""
    tail = np.ascontiguousarray(raw[..., -8:]).view("<f4")
    return np.ascontiguousarray(raw[..., :-8]).view(np.int8) * tail[..., :1], tail[..., 1]


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, valid) of a list column; zero, null or non-finite vectors and other lengths are not valid."""
    out, ok = np.zeros((len(column), dim)), np.zeros(len(column), bool)
    lists = column.to_pylist() if column.null_count or column.values.null_count else None
    if lists is None and len(column) and (np.diff(column.offsets.to_numpy()) == dim).all():
        out[:] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
        ok[:] = np.isfinite(out).all(axis=1)
    else:
        for i, v in enumerate(lists if lists is not None else column.to_pylist()):
            if v is not None and len(v) == dim and None not in v:
                out[i] = v
                ok[i] = np.isfinite(out[i]).all()
    out[~ok] = 0.0
    top = np.abs(out).max(axis=1, keepdims=True) if dim else np.zeros((len(out), 1))
    ok &= top[:, 0] > 0
    out = out / np.where(top > 0, top, 1.0)  # no overflow in the squares
    return np.where(ok[:, None], out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300), 0.0), ok


def units_of(column: pa.Array) -> list[bytes | None]:
    """Unit vectors of a list column as bytes, each length by itself; None for what links with nothing."""
    out: list[bytes | None] = [None] * len(column)
    size = np.array([0 if v is None else v for v in pc.list_value_length(column).to_pylist()], dtype=np.int64)
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        unit, ok = unit_rows(column.take(pa.array(at)), dim)
        for i, u, o in zip(at.tolist(), unit, ok):
            if o:
                out[i] = u.tobytes()
    return out


LINKS = StructType([StructField("rep", LongType()), StructField("n", LongType()), StructField("root", LongType())])


class Exact:
    """Vectors in double precision."""

    def __init__(self, raws: list[bytes]):
        self.x = np.frombuffer(b"".join(raws)).reshape(len(raws), -1)

    def near(self, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
        return self.x[a] @ self.x[b].T >= cosine


class Rounded:
    """Vectors in bytes: near is what may be near."""

    def __init__(self, raws: list[bytes] | np.ndarray):
        raw = raws if isinstance(raws, np.ndarray) else np.frombuffer(b"".join(raws), np.uint8).reshape(len(raws), -1)
        self.x, self.rest = from_bytes(raw)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the cosines of pairs can be at most."""
        return np.einsum("ij,ij->i", self.x[a], self.x[b]) + self.rest[a] + self.rest[b] + 1e-5

    def near(self, a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
        return self.x[a] @ self.x[b].T + self.rest[a][:, None] + self.rest[b] + 1e-5 >= cosine


def rerank(rows: DataFrame, cosine: float, parts: int, kind: type = Exact) -> DataFrame:
    """LINKS of rows (g, lo, hi, part, rep, k, vec): of each pair of chunks (lo, hi), a row's links there and its component's least."""

    def group(lo: int, hi: int, part: np.ndarray, rep: np.ndarray, k: np.ndarray, x: Exact | Rounded) -> list[tuple]:
        a, b = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        if not len(a) or not len(b):
            return []
        n, forest = np.zeros(len(rep), np.int64), Forest()
        label = rep[b].copy()  # the root of every row of b
        for s in range(0, len(a), 256):
            mine = a[s : s + 256]
            near = x.near(mine, b, cosine)
            if lo == hi:
                near[np.arange(len(mine)), np.arange(s, s + len(mine))] = False
            n[mine] += near @ k[b]
            if lo != hi:
                n[b] += k[mine] @ near
            # a row's links are joined through their roots: no more joins than there are rows
            for i in np.flatnonzero(near.any(axis=1)):
                roots = np.unique(np.append(label[near[i]], forest.find(int(rep[mine[i]]))))
                if len(roots) > 1:
                    for o in roots[1:].tolist():
                        forest.join(int(roots[0]), o)
                    label[np.isin(label, roots)] = forest.find(int(roots[0]))
        return [(int(r), int(c), int(forest.find(int(r)))) for r, c in zip(rep, n) if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in chain_last(batches):
            done: list[tuple] = []
            rows_ = zip(*(c.to_pylist() for c in batch.columns)) if batch is not None else [(None,) * 7]
            for g, lo, hi, part, rep, k, vec in rows_:
                if (g, lo, hi) != key:
                    if len(held) > 1:
                        p, r, n, v = zip(*held)
                        done += group(key[1], key[2], np.array(p), np.array(r), np.array(n), kind(v))
                    key, held = (g, lo, hi), []
                held.append((part, rep, k, vec))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(3)], names=["rep", "n", "root"])

    return rows.select("g", "lo", "hi", "part", "rep", "k", "vec").repartition(parts, "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi").mapInArrow(run, LINKS)


def _chunk(n: str | Column) -> Column:
    return F.ceil((F.col(n) if isinstance(n, str) else n) / CHUNK).cast("long")


def _each(n: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), n - 1)


def propose_wide(wide: DataFrame, cosine: float, parts: int) -> DataFrame:
    """Candidate edges of bands of more than WIDE classes, from rows (bk, rep, n, lead, sig).

    Members like the band's first are linked with it, in chunks that each hold the first.
    Those that are not meet all members, in pairs of chunks; a band of copies has few of them.
    """
    size = F.col("size")
    first = wide.where("rep = lead").select("bk", "rep", "lead", "sig", F.explode(_each(_chunk("n"))).alias("part"))
    rest = wide.where("rep <> lead").select("bk", "rep", "lead", "sig", F.pmod(F.xxhash64("rep"), _chunk("n")).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, top = None, None
        for batch in batches:
            x, rest = from_bytes(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, -1)) if batch.num_rows else (np.zeros((0, 1)), np.zeros(0))
            like = np.zeros(len(x), bool)
            keys = list(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()))
            for i, k in enumerate(keys):  # the first comes first in its chunk
                if k != key:
                    key, top = k, (x[i], rest[i])
                    like[i] = True
                    continue
                like[i] = x[i] @ top[0] + rest[i] + top[1] + 1e-5 >= cosine
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(like)], names=["bk", "rep", "lead", "like"])

    order = first.union(rest).select("bk", "rep", "lead", "part", "sig").repartition(parts, "bk", "part").sortWithinPartitions("bk", "part", F.col("rep") != F.col("lead"))
    met = checkpoint(order.mapInArrow(run, StructType([StructField("bk", LongType()), StructField("rep", LongType()), StructField("lead", LongType()), StructField("like", BooleanType())])).where("rep <> lead"))
    stars = met.where("like").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    # strangers take chunks 0 to co - 1, the others those after; every pair has a stranger's chunk
    strange = met.where("not like").select(F.col("bk").alias("sk"), F.col("rep").alias("sr"))
    counts = strange.groupBy("sk").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("sk", "ck")
    dealt = wide.join(counts, F.col("bk") == F.col("ck")).join(strange, (F.col("bk") == F.col("sk")) & (F.col("rep") == F.col("sr")), "left")
    co, ci = _chunk(size), _chunk(F.col("n") - size)
    out = F.col("sr").isNotNull()
    dealt = dealt.select("bk", "rep", "sig", F.when(out, F.pmod(F.xxhash64("rep"), co)).otherwise(co + F.pmod(F.xxhash64("rep"), F.greatest(ci, F.lit(1)))).alias("part"), F.explode(F.when(out, _each(co + ci)).otherwise(_each(co))).alias("o"))
    pairs = dealt.select(F.col("bk").alias("g"), F.least("part", "o").alias("lo"), F.greatest("part", "o").alias("hi"), "part", "rep", F.lit(1).cast("long").alias("k"), F.col("sig").alias("vec"))
    return stars.union(rerank(pairs, cosine, parts, Rounded).select(F.col("rep").alias("a"), F.col("root").alias("b")))


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The operator: (id, n_links, component_id, kept) of every row.

    Vectors of equal length are compared; null, empty, zero and non-finite ones link with
    nothing. Repeated rows are vectors like others and count as links; so are different
    vectors of one id. Rows without an id are kept, unlinked, with a null component.
    """
    spark = tune(vectors.sparkSession)
    parts = parts_for(vectors)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = units_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r and xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["id", "key", "vec"])

    coded = checkpoint(rows.mapInArrow(keyed, StructType([StructField("id", LongType()), StructField("key", BinaryType()), StructField("vec", BinaryType())])))
    classes = coded.where("id is not null and key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("k"), F.first("vec").alias("vec"))
    # a class is known by its least id; further classes of an id that comes with several vectors, by a hash
    again = coded.where("id is not null and key is not null").groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select(F.col("id").alias("again"))
    classes = checkpoint(classes.join(again, F.col("least") == F.col("again"), "left").select("key", F.when(F.col("again").isNull(), F.col("least")).otherwise(F.xxhash64("key")).alias("rep"), "least", "k", "vec", (F.length("vec") / 8).cast("int").alias("dim")))
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each length
    small = [d for d, n in sizes.items() if 1 < n <= CHUNK]
    none = F.lit(0).cast("long")
    met = classes.where(F.col("dim").isin(small) if small else F.lit(False)).select(F.col("dim").cast("long").alias("g"), none.alias("lo"), none.alias("hi"), none.alias("part"), "rep", "k", "vec")
    links = checkpoint(rerank(met, cosine, parts))
    for dim in sorted(d for d, n in sizes.items() if n > CHUNK):
        links = links.union(_links(spark, classes.where(F.col("dim") == dim), dim, sizes[dim], cosine, parts))
    found = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    light = classes.select("key", "rep", "least", "k")
    linked = found.join(light, F.col("v") == F.col("rep")).select("key", "comp", "least")
    named = linked.groupBy("comp").agg(F.min("least").alias("component")).withColumnRenamed("comp", "c2")
    component_of = linked.join(named, F.col("comp") == F.col("c2")).select(F.col("key").alias("k3"), "component")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n")).withColumnRenamed("rep", "r4")
    label = (
        light.join(component_of, F.col("key") == F.col("k3"), "left").join(counts, F.col("rep") == F.col("r4"), "left")
        .select(F.col("key").alias("k2"), F.coalesce("component", "least").alias("comp"), (F.coalesce("n", F.lit(0)) + F.col("k") - 1).alias("n"))
    )
    labelled = coded.select("id", "key").join(label.hint("shuffle_hash"), F.col("key") == F.col("k2"), "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("comp", "id"))
    n_links = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    return labelled.select(F.col("id").alias(id_col), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _links(spark, classes: DataFrame, dim: int, total: int, cosine: float, parts: int) -> DataFrame:
    """LINKS of the classes (rep, k, vec) of one length, of which there are more than a chunk holds."""
    some = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").toArrow().column(0).to_pylist()
    shared, mark = spark.sparkContext.broadcast(Coder(np.frombuffer(b"".join(some)).reshape(len(some), dim), total, cosine)), os.urandom(8).hex()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _HELD:
            _HELD.clear()
            _HELD[mark] = shared.value
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(batch.num_rows, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_HELD[mark].code(x)), pa.list_(pa.int64())), pa.array(in_bytes(x), pa.binary())], names=["rep", "tables", "sig"])

    codes = classes.select("rep", "vec").mapInArrow(code, StructType([StructField("rep", LongType()), StructField("tables", ArrayType(LongType())), StructField("sig", BinaryType())]))
    banded = codes.select("rep", F.explode("tables").alias("bk"))
    shared_keys = banded.groupBy("bk").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("lead")).where("n > 1").withColumnRenamed("bk", "bk2")
    members = banded.join(shared_keys, F.col("bk") == F.col("bk2")).select("bk", "rep", "n", "lead")
    members = checkpoint(members.join(codes.select(F.col("rep").alias("r2"), "sig"), F.col("rep") == F.col("r2")).select("bk", "rep", "n", "lead", "sig"))
    edges = propose(members.where(F.col("n") <= WIDE), cosine, parts, Rounded)
    wide = members.where(F.col("n") > WIDE)
    if wide.limit(1).count():
        edges = edges.union(propose_wide(wide, cosine, parts))
    clusters = components(edges.distinct())
    sized = clusters.groupBy("comp").agg(_chunk(F.count(F.lit(1))).alias("chunks")).withColumnRenamed("comp", "g")
    placed = clusters.join(sized, F.col("comp") == F.col("g")).select("g", F.col("v").alias("r3"), "chunks", F.pmod(F.xxhash64("v"), F.col("chunks")).alias("part"))
    met = placed.join(classes.select("rep", "k", "vec"), F.col("r3") == F.col("rep")).select("g", "part", "rep", "k", "vec", F.explode(_each(F.col("chunks"))).alias("o"))
    return checkpoint(rerank(met.select("g", F.least("part", "o").alias("lo"), F.greatest("part", "o").alias("hi"), "part", "rep", "k", "vec"), cosine, parts))


_HELD: dict[str, Coder] = {}


def op9_itq(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op9_itq": """
with recursive e as (select vec_id, embedding::double[] as v from embeddings),
n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as s from e),
u as (select vec_id, list_transform(v, lambda x: x / s) as v from n where s > 0 and isfinite(s)),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_dot_product(a.v, b.v) >= 0.95),
r as (select vec_id as v, vec_id as c from e union select l.b, r.c from r join l on l.a = r.v where r.c < l.b),
m as (select v, min(c) as c from r group by v),
k as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(k.n, 0)::bigint as n_links, m.c as component_id, e.vec_id = m.c as kept
from e left join k on k.a = e.vec_id join m on m.v = e.vec_id"""
}
QUERIES = {"op9_itq": op9_itq}
