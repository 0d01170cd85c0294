"""Language-model scoring by deleted interpolation.

Bigram, unigram and uniform estimates are mixed by weights that depend on how often the
context occurs in training (buckets of powers of two). The weights come from expectation
maximisation on held-out counts: each training document's tokens are predicted from all
other training documents, by taking its own counts off the corpus counts.

Counts travel by the block exchange: buckets send the distinct words and bigrams of their
documents with training counts, shards add them up and answer in the same order, and the
buckets write each document's counts, packed, to the shared folder. The weights are then
learned from one bounded histogram, and scores need no text. Hashes have a fixed width, so
the same rows score alike however they are stored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from .blocks import Buckets, pack_counts, pack_keys, texts, unpack_counts, unpack_keys
from .common import checkpoint, table
from .passages import ODD, mix, word_hashes

#: Hash of the end of a text and of the context of its first word: no word hashes are given out twice.
END, START = np.uint64(0x5BD1E995A5A5A5A5), np.uint64(0x27D4EB2F165667C5)
#: Bins of the histogram: contexts by powers of two, bigram estimates by quarters of one, word counts by halves.
CONTEXTS, RATIOS, COUNTS = 24, 128, 80
ROUNDS = 200


#: Bits of a bigram's hash: at 100 TB, one distinct bigram in some ten thousand shares its hash with another.
PAIR_BITS = 50


class TwoKinds:
    """Keys of words (even, 63 bits) and of bigrams (odd, PAIR_BITS high bits), each packed by themselves."""

    def pack(self, keys: np.ndarray) -> bytes:
        odd = (keys & np.uint64(1)).astype(bool)
        words = pack_keys(keys[~odd])
        return len(words).to_bytes(4, "little") + words + pack_keys(keys[odd], 64 - PAIR_BITS)

    def unpack(self, raw: bytes) -> np.ndarray:
        size = int.from_bytes(raw[:4], "little")
        return np.sort(np.concatenate([unpack_keys(raw[4 : 4 + size]), unpack_keys(raw[4 + size :], drop=64 - PAIR_BITS) | np.uint64(1)]))


class Tokens:
    """The tokens of a bucket: words and one end for each document; keys of their types and bigrams, and each token's places among them."""

    def __init__(self, raws: list[bytes]):
        parts = [np.concatenate([word_hashes(r.lower()), [END]]).astype(np.uint64) for r in raws]
        h = np.concatenate(parts) & ~np.uint64(1)
        size = np.array([len(p) for p in parts])
        self.cut = np.concatenate([[0], np.cumsum(size)])
        self.doc = np.repeat(np.arange(len(parts)), size)
        before = np.concatenate([[START], h[:-1]]).astype(np.uint64)
        before[self.cut[:-1]] = START
        low = np.uint64(64 - PAIR_BITS)
        pair = (mix(before * ODD + h) >> low << low) | np.uint64(1)
        self.keys, place = np.unique(np.concatenate([h, pair]), return_inverse=True)
        self.type_of, self.pair_of = place[: len(h)], place[len(h) :]
        first = np.zeros(len(h), bool)
        first[self.cut[:-1]] = True
        # the context's type; a first word's context is as frequent as documents, and so as ends
        end = int(np.searchsorted(self.keys, END & ~np.uint64(1)))
        self.context_of = np.concatenate([[end], self.type_of[:-1]])
        self.context_of[first] = end

    def own(self, what: np.ndarray) -> np.ndarray:
        """For every token, how often its document has the same value."""
        _, at, n = np.unique(self.doc * (int(what.max()) + 1 if len(what) else 1) + what, return_inverse=True, return_counts=True)
        return n[at]


def cells(context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Histogram cell of every token, from the counts of its context, bigram and word."""
    with np.errstate(divide="ignore", invalid="ignore"):
        b = np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0)
        q = np.where((pair > 0) & (context > 0), 1 + np.round(4 * np.log2(np.maximum(context, 1) / np.maximum(pair, 1))), 0)
        c = np.where(word > 0, 1 + np.round(2 * np.log2(np.maximum(word, 1))), 0)
    b, q, c = np.clip(b, 0, CONTEXTS - 1), np.clip(q, 0, RATIOS - 1), np.clip(c, 0, COUNTS - 1)
    return ((b * RATIOS + q) * COUNTS + c).astype(np.int64)


def learn(histogram: dict[int, int], tokens: int, types: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of every context bucket by expectation maximisation."""
    weights = np.tile([0.4, 0.5, 0.1], (CONTEXTS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    cell = np.array(sorted(histogram), np.int64)
    if not len(cell):
        return weights
    n = np.array([histogram[c] for c in cell.tolist()], float)
    b, q, c = cell // (RATIOS * COUNTS), cell // COUNTS % RATIOS, cell % COUNTS
    p = np.stack([np.where(q > 0, 2.0 ** (-(q - 1) / 4), 0.0), np.where(c > 0, 2.0 ** ((c - 1) / 2), 0.0) / max(1, tokens), np.full(len(cell), 1.0 / (types + 1))], axis=1)
    for _ in range(ROUNDS):
        share = weights[b] * p
        share *= (n / share.sum(axis=1))[:, None]
        got = np.stack([np.bincount(b, weights=share[:, k], minlength=CONTEXTS) for k in range(3)], axis=1)
        got += [0.0, 0.5, 0.5]  # a trace of mass keeps every token possible
        seen = np.bincount(b, minlength=CONTEXTS) > 0
        new = got / got.sum(axis=1, keepdims=True)
        step = np.abs(new - weights)[seen].max()
        weights[seen] = new[seen]
        if step < 1e-7:
            break
    return weights


STATS = StructType([StructField("held_out", BooleanType()), StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("log_counts", DoubleType()), StructField("types", LongType()), StructField("histogram", BinaryType()), StructField("counts", BinaryType())])


def held(i: int | None, mod: int, rest: int) -> bool:
    return zlib.crc32(b"" if i is None else str(i).encode()) % mod == rest


def count(docs: DataFrame, id_col: str, text_col: str, mod: int, rest: int) -> DataFrame:
    """(id, STATS) of every document: its tokens' corpus counts, and each bucket's part of the held-out histogram."""
    b = Buckets(docs, id_col, text_col, shard_bytes=4 << 20)

    def read(t: pa.Table) -> tuple[Tokens, np.ndarray]:
        return Tokens(list(texts(t))), np.array([not held(i, mod, rest) for i in t.column("k0").to_pylist()])

    def question(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x, train = read(t)
        on = train[x.doc]
        return x.keys, np.bincount(x.type_of[on], minlength=len(x.keys)) + np.bincount(x.pair_of[on], minlength=len(x.keys))

    def decide(keys: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, int]:
        return total, int(((keys & np.uint64(1) == 0) & (total > 0)).sum())

    def tell(t: pa.Table, answers: list[dict]) -> list:
        x, train = read(t)
        answers.sort(key=lambda a: a["shard"])
        n = np.concatenate([unpack_counts(a["values"]) for a in answers])
        types = sum(a["lead"] for a in answers)
        w, p, c = n[x.type_of], n[x.pair_of], n[x.context_of]
        # without the document's own counts
        own_w, own_p = x.own(x.type_of), x.own(x.pair_of)
        own_c = np.concatenate([[1], own_w[:-1]])
        own_c[x.cut[:-1]] = 1
        on = train[x.doc]
        cell, n = np.unique(cells((c - own_c)[on], (p - own_p)[on], (w - own_w)[on]), return_counts=True)
        histogram = zlib.compress(cell.astype("<u4").tobytes() + n.astype("<u4").tobytes(), 1)
        logs = np.add.reduceat(np.log10(w + 1.0), x.cut[:-1])
        known = np.add.reduceat((w > 0).astype(np.int64), x.cut[:-1])
        rows = []
        for i in range(len(x.cut) - 1):
            a, e = x.cut[i], x.cut[i + 1]
            raw = [pack_counts(v[a:e]) for v in (p, w)]
            rows.append((not bool(train[i]), int(e - a), int(known[i]), float(logs[i]), types if i == 0 else 0, histogram if i == 0 else None, b"".join(len(r).to_bytes(4, "little") + r for r in raw)))
        return list(zip(*rows))

    return b.meet(b.exchange(question, decide, TwoKinds(), whole=True), tell, STATS)


def split_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, bigram, word) counts of a text. A token's context is the word before it; the first one's, the end."""
    size = int.from_bytes(raw[:4], "little")
    pair, word = unpack_counts(raw[4 : 4 + size]), unpack_counts(raw[8 + size :])
    return np.concatenate([word[-1:], word[:-1]]), pair, word


def log_prob(context: np.ndarray, pair: np.ndarray, word: np.ndarray, weights: np.ndarray, tokens: int, types: int) -> float:
    """log10 probability of a text from its tokens' counts."""
    b = np.where(context > 0, np.clip(1 + np.floor(np.log2(np.maximum(context, 1))), 0, CONTEXTS - 1), 0).astype(int)
    w = weights[b]
    p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(1, tokens) + w[:, 2] / (types + 1)
    return float(np.log10(p).sum())


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, rest: int = 2) -> tuple[DataFrame, np.ndarray]:
    """The operator: rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score), and the weights learned.

    Learns from rows whose crc32 of the id leaves another remainder than `rest`. A null or
    empty text is one end; a null id hashes as the empty text. Repeated rows count each.
    """
    stats = checkpoint(count(docs, id_col, text_col, mod, rest))
    tokens, types = stats.agg(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.sum("types")).first()
    tokens, types = int(tokens or 0), int(types or 0)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for raw in batch.column(0):
                both = np.frombuffer(zlib.decompress(raw.as_py()), "<u4")
                for c, n in zip(both[: len(both) // 2].tolist(), both[len(both) // 2 :].tolist()):
                    total[c] = total.get(c, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["cell", "n"])

    # at most CONTEXTS * RATIOS * COUNTS cells, whatever the input
    cells_ = stats.where("histogram is not null").select("histogram").mapInArrow(explode, StructType([StructField("cell", LongType()), StructField("n", LongType())]))
    weights = learn({r[0]: r[1] for r in cells_.groupBy("cell").agg(F.sum("n")).collect()}, tokens, types)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = StructType([stats.schema[id_col], STATS["held_out"], STATS["n_tokens"], STATS["n_known"], StructField("train_tokens", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())])
    below = math.log10(tokens + types + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, logs = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            got = [log_prob(*split_counts(r.as_py()), weights, tokens, types) for r in batch.column(5)]
            cols = [*batch.columns[:4], pa.array([tokens] * len(n), pa.int64()), pa.array(logs - n * below, pa.float64()), pa.array(got, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return stats.select(id_col, "held_out", "n_tokens", "n_known", "log_counts", "counts").mapInArrow(score, schema), weights


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    return fit_and_score(table(spark, sf_dir, "documents"))[0]


QUERIES = {"op5_lm_score": op5_lm_score}
ORACLE: dict[str, str] = {}
