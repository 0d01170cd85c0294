"""MinHash near-dedup with b-bit signatures.

1. One pass over the texts: distinct 5-word shingles, their count, a 128-bit key of the
   whole set, minima of PERMS permutations, band keys from the full minima, and the low
   BITS bits of the minima packed into a signature.
2. Documents with equal sets form a class; classes, not documents, go on.
3. Bands that two classes or more share propose links. A pair is a candidate if the
   similarity estimated from equal signature bits, corrected for chance collisions, is
   near the threshold. In a band with very many classes all are proposed to one cluster.
4. Clusters of candidates are confirmed on full sets, read from the texts again: chunks of
   a bounded number of classes, with some pivots in every chunk of a large cluster, and
   then every class outside the cluster's largest component against all others, in blocks
   of some of these by some of all. So every pair of a cluster that is not connected yet is
   compared once, or twice if both are outside. A block counts all its intersections at
   once, by products of matrices for the hashes that many of its sets hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import checkpoint, components, parts_for, table, tune
from .passages import rolling, word_hashes

SHINGLE = 5
BAND_ROWS, BANDS, BITS = 6, 36, 4
PERMS = BAND_ROWS * BANDS
#: Standard errors by which an estimate may fall below the threshold.
MARGIN = 4.5
#: Classes in a band beyond which all of them go to one cluster, and classes in a chunk.
WIDE, CHUNK, PIVOTS = 256, 128, 8
#: Hashes that a chunk holds about, where texts are long; chunks on each side of a block.
CHUNK_HASHES, SIDE = 1 << 18, 8
#: Hashes, and pairs of rows, that are counted at a time.
SLAB, PAIRS = 2048, 1 << 21

_RNG = np.random.default_rng(20_11)
SALTS = _RNG.integers(1, 2**32, PERMS, dtype=np.uint32)
MULTS = _RNG.integers(0, 2**31, PERMS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(raw: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word runs of a text, A-Z lower-cased; the whole of a shorter text as one."""
    h = word_hashes(raw.lower())
    if not len(h):
        return h
    return np.unique(rolling(h, k, 11)) if len(h) >= k else rolling(h, len(h), 12 + len(h))


def minima(s: np.ndarray) -> np.ndarray:
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        y = (x[at : at + 2048, None] ^ SALTS) * MULTS
        y ^= y >> np.uint32(15)
        np.minimum(out, y.min(axis=0), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    raw = m.tobytes()
    size = 4 * BAND_ROWS
    return np.array([xxhash.xxh3_64_intdigest(raw[i * size : (i + 1) * size], i) for i in range(BANDS)], np.uint64).view(np.int64)


def packed(m: np.ndarray) -> bytes:
    low = ((m * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8) if BITS == 4 else None
    return (low[0::2] | (low[1::2] << np.uint8(4))).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (rows of bytes): equal BITS-bit values, less those equal by chance."""
    x = a ^ b
    same = ((x & np.uint8(15)) == 0).sum(axis=1) + ((x >> np.uint8(4)) == 0).sum(axis=1)
    chance = 1.0 / (1 << BITS)
    return (same / PERMS - chance) / (1 - chance)


class Signatures:
    """Rows of packed signatures, compared in pairs."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return estimate(self.raw[a], self.raw[b])


def least_estimate(num: int, den: int) -> float:
    j = num / den
    chance = 1.0 / (1 << BITS)
    p = j + (1 - j) * chance
    return j - MARGIN * (p * (1 - p) / PERMS) ** 0.5 / (1 - chance)


class Forest:
    """Union-find that keeps the smallest id as root."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, key, bands, sig) of every row; key, bands and sig are null for a text without words."""
    schema = StructType([StructField("id", LongType()), StructField("n", LongType()), StructField("key", BinaryType()), StructField("bands", ArrayType(LongType())), StructField("sig", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            n, keys, bands, sigs = [], [], [], []
            for raw in batch.column(1):
                s = shingles(raw.as_py() or b"")
                n.append(len(s))
                if not len(s):
                    keys.append(None), bands.append(None), sigs.append(None)
                    continue
                key = xxhash.xxh3_128_digest(s.tobytes())
                if key not in seen:
                    if len(seen) >= 20_000:
                        seen.clear()
                    m = minima(s)
                    seen[key] = band_keys(m), packed(m)
                b, g = seen[key]
                keys.append(key), bands.append(b), sigs.append(g)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["id", "n", "key", "bands", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, schema)


EDGE = StructType([StructField("a", LongType()), StructField("b", LongType())])


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def propose(banded: DataFrame, floor: float, parts: int, kind: type = Signatures) -> DataFrame:
    """Candidate edges of bands of at most WIDE classes, from rows (bk, rep, sig): a forest of each task's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, rest = Forest(), None
        for batch in chain_last(batches):
            if batch is not None:
                bk, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                sig = np.frombuffer(b"".join(x.as_py() for x in batch.column(2)), np.uint8).reshape(len(bk), -1)
                if rest is not None:
                    bk, rep, sig = np.concatenate([rest[0], bk]), np.concatenate([rest[1], rep]), np.concatenate([rest[2], sig])
                cut = int(np.searchsorted(bk, bk[-1]))  # the last band may go on in the next batch
                rest = bk[cut:], rep[cut:], sig[cut:]
                bk, rep, sig = bk[:cut], rep[:cut], sig[:cut]
            elif rest is not None:
                bk, rep, sig = rest
            else:
                return
            if not len(bk):
                continue
            start = np.concatenate([[0], np.flatnonzero(np.diff(bk)) + 1])
            size = np.diff(np.concatenate([start, [len(bk)]]))
            first = np.repeat(start, size)
            me = np.arange(len(bk))
            others = me != first
            ok, seen = np.zeros(len(bk), bool), kind(sig)
            ok[others] = seen.pair(me[others], first[others]) >= floor
            pairs = [(x, y) for x, y in zip(rep[first[ok]].tolist(), rep[me[ok]].tolist()) if forest.join(x, y)]
            for i in np.flatnonzero(others & ~ok):  # unlike the band's first: against all later members, and those before that were like it
                a, b = first[i] + 1, first[i] + size[np.searchsorted(start, i, side="right") - 1]
                j = np.concatenate([np.arange(a, i)[ok[a:i]], np.arange(i + 1, b)])
                if len(j):
                    for y in rep[j[seen.pair(j, np.full(len(j), i)) >= floor]].tolist():
                        if forest.join(int(rep[i]), y):
                            pairs.append((int(rep[i]), y))
            if pairs:
                yield _edges(pairs)
            if len(forest.up) > 500_000:
                forest = Forest()

    return banded.select("bk", "rep", "sig").repartition(parts, "bk").sortWithinPartitions("bk").mapInArrow(run, EDGE)


def chain_last(batches):
    yield from batches
    yield None


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of the sorted sets a with each of b.

    A hash that few rows hold adds one to each of their pairs; those that many rows hold are
    columns of two matrices of zeros and ones, whose product is their share of the counts.
    """
    out = np.zeros(len(a) * len(b), np.int64)
    x, y = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(x, y)
    if not len(both):
        return out.reshape(len(a), len(b))

    def entries(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows ordered by the place of their hash in both, where the rows of a place begin, and how many they are."""
        at = np.searchsorted(both, flat)
        at[at == len(both)] = 0
        held = both[at] == flat
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[held], at[held]
        count = np.bincount(at, minlength=len(both))
        return row[np.argsort(at, kind="stable")], np.cumsum(count) - count, count

    row_a, first_a, n_a = entries(a, x)
    row_b, first_b, n_b = entries(b, y)

    def spread(places: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all entries of these places, and which of the places each is of."""
        n = count[places]
        which = np.repeat(np.arange(len(places)), n)
        return first[places][which] + np.arange(len(which)) - (np.cumsum(n) - n)[which], which

    pairs = n_a * n_b
    dense = pairs * 256 >= len(out)
    few = np.flatnonzero(~dense)
    upto = np.cumsum(pairs[few])
    for part in np.split(few, np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS))) if len(few) else []:
        ia, which = spread(part, first_a, n_a)  # entries of a, each with all entries of b at its place
        n = n_b[part][which]
        e = np.repeat(np.arange(len(ia)), n)
        ib = first_b[part][which][e] + np.arange(len(e)) - (np.cumsum(n) - n)[e]
        out += np.bincount(row_a[ia][e] * len(b) + row_b[ib], minlength=len(out))
    many, out = np.flatnonzero(dense), out.reshape(len(a), len(b))
    for k in range(0, len(many), SLAB):
        part = many[k : k + SLAB]
        sides = []
        for sets, row, first, count in ((a, row_a, first_a, n_a), (b, row_b, first_b, n_b)):
            i, which = spread(part, first, count)
            side = np.zeros((len(sets), len(part)), np.float32)
            side[row[i], which] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def confirm(rows: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """Edges confirmed on full sets within groups (g, chunk) of rows (g, chunk, asks, rep, comp, key, raw): a star for each component.

    Rows that ask are compared with those that do not (asks null: each row with all others).
    Rows of the same comp are known to be connected already (null: nothing is known), and an
    edge is between the comps of two rows. A row whose text is not the one of its class (an id
    that comes with several texts) is passed over.
    """

    def group(asks: list, ids: list[int], comps: list, keys: list[bytes], raws: list[bytes]) -> list[tuple[int, int]]:
        found: dict[tuple, tuple[int, np.ndarray]] = {}
        for ask, i, c, key, raw in zip(asks, ids, comps, keys, raws):
            if (ask, i, key) not in found and xxhash.xxh3_128_digest((s := shingles(raw)).tobytes()) == key:
                found[ask, i, key] = i if c is None else c, s
        one = [x for k, x in found.items() if k[0] is not False]
        other = [x for k, x in found.items() if k[0] is not True]
        if not one or not other:
            return []
        both = overlaps([s for _, s in one], [s for _, s in other])
        size = np.array([len(s) for _, s in one])[:, None] + np.array([len(s) for _, s in other])
        p, q = np.nonzero(den * both >= num * (size - both))
        c, d = np.array([c for c, _ in one])[p], np.array([c for c, _ in other])[q]
        forest = Forest()
        for x, y in np.unique(np.stack([c, d], 1)[c != d], axis=0).tolist():
            forest.join(x, y)
        return [(x, r) for x in list(forest.up) if (r := forest.find(x)) != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in chain_last(batches):
            done: list[tuple[int, int]] = []
            rows = zip(*(c.to_pylist() for c in batch.columns)) if batch is not None else [(None,) * 7]
            for g, chunk, *row in rows:
                if (g, chunk) != at:
                    if len(held) > 1:
                        done += group(*zip(*held))
                    at, held = (g, chunk), []
                held.append(row)
            if done:
                yield _edges(done)

    return rows.select("g", "chunk", "asks", "rep", "comp", "key", "raw").repartition(parts, "g", "chunk").sortWithinPartitions("g", "chunk").mapInArrow(run, EDGE)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 85, den: int = 100) -> DataFrame:
    """The operator: (id, n_shingles, component_id, kept) of every row; links are den * intersection >= num * union.

    Texts without words link with nothing. Rows without an id are returned unlinked, with a
    null component, and kept. Repeated ids with different texts link their texts' classes.
    """
    spark = tune(docs.sparkSession)
    parts = parts_for(docs)
    few = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts // 4)
    signed = checkpoint(sign(docs, id_col, text_col))
    real = signed.where("id is not null and key is not null")
    classes = checkpoint(real.groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    banded = classes.select("rep", F.explode("bands").alias("bk"))
    shared = banded.groupBy("bk").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("lead")).where("n > 1")
    members = checkpoint(banded.join(shared.withColumnRenamed("bk", "bk2"), F.col("bk") == F.col("bk2")).select("bk", "rep", "n", "lead"))
    small = members.where(F.col("n") <= WIDE).join(classes.select(F.col("rep").alias("r2"), "sig"), F.col("rep") == F.col("r2"))
    wide = members.where((F.col("n") > WIDE) & (F.col("rep") != F.col("lead"))).select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    # one id with two texts: both classes have it as their representative, or one has; they are linked by it
    twice = real.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("id")
    same_id = real.join(twice.withColumnRenamed("id", "i2"), F.col("id") == F.col("i2")).select("id", "key").join(classes.select(F.col("key").alias("k2"), "rep"), F.col("key") == F.col("k2")).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    clusters = components(propose(small, least_estimate(num, den), few).union(wide).distinct())
    named = clusters.select(F.col("comp").alias("g"), "v").join(classes.select("rep", "key", "n"), F.col("v") == F.col("rep"))
    sized = named.groupBy(F.col("g").alias("g2")).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("hashes"))
    chunks = F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("hashes") / CHUNK_HASHES)).cast("long")
    # a class's text: one row of its representative id, whichever has the class's set
    reps = checkpoint(named.join(sized, F.col("g") == F.col("g2")).select("g", "rep", "key", chunks.alias("chunks"), F.pmod(F.xxhash64("v"), chunks).alias("chunk"), ((F.pmod(F.xxhash64("v", F.lit(7)), F.col("m")) < PIVOTS) | (F.col("v") == F.col("g"))).alias("pivot")))
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw")).where("id is not null")
    bodies = checkpoint(raw.join(reps, F.col("id") == F.col("rep")).select("g", "rep", "key", "chunks", "chunk", "pivot", "raw"))
    spread = bodies.select("g", "rep", "key", F.lit(None).cast("long").alias("comp"), F.lit(None).cast("boolean").alias("asks"), "raw", F.explode(F.when(F.col("pivot") & (F.col("chunks") > 1), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("chunk"))).alias("chunk"))
    edges = checkpoint(confirm(spread, num, den, parts).union(same_id).distinct())
    found = components(edges)
    # clusters of several chunks: whatever is outside their largest component meets all others
    large = bodies.where("chunks > 1").join(found.select("v", F.col("comp").alias("c")), F.col("rep") == F.col("v"), "left").select("g", "rep", "key", "chunks", F.coalesce("c", "rep").alias("comp"))
    large = checkpoint(large.distinct())
    tops = large.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("g").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    tops = tops.select(F.col("g").alias("g2"), F.col("top.comp").alias("top"), (1 - F.col("top.k") / F.col("m")).alias("share"))
    all_sides = F.ceil(F.col("chunks") / SIDE).cast("long")
    out_sides = F.greatest(F.lit(1), F.ceil(F.col("chunks") * F.col("share") / SIDE)).cast("long")
    left = large.join(tops, F.col("g") == F.col("g2")).select("g", "rep", "key", "comp", (F.col("comp") != F.col("top")).alias("out"), all_sides.alias("alls"), out_sides.alias("outs"))
    if left.limit(1).count():
        # a row that asks has a place among the outs and goes to that place's blocks; any row has one among all
        place = lambda n: F.pmod(F.xxhash64("rep", F.lit(n)), F.col(n))
        each = lambda n, block: F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), block)).alias("chunk")
        texts = bodies.where("chunks > 1").select(F.col("rep").alias("r3"), F.col("key").alias("k3"), "raw")
        told = left.join(texts, (F.col("rep") == F.col("r3")) & (F.col("key") == F.col("k3")))
        asked = told.select("g", F.lit(False).alias("asks"), "rep", "comp", "key", "raw", each("outs", lambda x: x * F.col("alls") + place("alls")))
        again = asked.union(told.where("out").select("g", F.lit(True).alias("asks"), "rep", "comp", "key", "raw", each("alls", lambda x: place("outs") * F.col("alls") + x)))
        edges = edges.union(confirm(again, num, den, parts)).distinct()
        found = components(edges)
    label = classes.select("key", "rep").join(found, F.col("rep") == F.col("v"), "left").select(F.col("key").alias("k2"), F.coalesce("comp", "rep").alias("comp"))
    linked = signed.join(label.hint("shuffle_hash"), F.col("key") == F.col("k2"), "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("comp", "id"))
    return linked.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = {
    "op10_near_dedup": """
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: sha1(array_to_string(w[i:i + 4], ' '))) when len(w) >= 1 then [sha1(len(w)::varchar || '|' || array_to_string(w, ' '))] else [] end) as k from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as v, doc_id as c from d union select e.b, r.c from r join e on e.a = r.v where r.c < e.b),
m as (select v, min(c) as c from r group by v)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id, d.doc_id = m.c as kept
from d left join n using (doc_id) join m on m.v = d.doc_id"""
}
QUERIES = {"op10_near_dedup": op10_near_dedup}
