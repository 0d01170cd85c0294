"""Toxic spans by a linear-chain conditional random field.

Document labels become token labels first: a feature of a word (the word itself, or a
prefix of 4 to 6 letters) that toxic documents hold far more often than the others marks
its words in toxic documents. A two-state chain is then fitted to these tokens with
forward-backward gradients. A document's score is calibrated from the forward-backward
marginals of its tokens: the largest one and the expected number of toxic tokens.
Features count once for each context (the words beside them), so that copies of one
toxic document do not turn all its rare words into toxic ones.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import crc_mod, field, table, tune

#: Labelled rows (clean, toxic) that the model is fitted on at most: the bound of the driver's sample.
SAMPLE_PER_CLASS = (1600, 800)
#: Hashed weights: 2**BITS doubles, the fixed size of what is broadcast.
BITS = 17
#: Words that a Python worker keeps with their weights.
CACHE = 300_000
WORD = re.compile(r"[^\W\d_]+")
MASK = (1 << BITS) - 1


def features(word: str) -> list[str]:
    """Names of a lower-case word's features."""
    return ["w=" + word, *(f"p{k}={word[:k]}" for k in (4, 5, 6) if len(word) >= k)]


def slots(word: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(f) & MASK for f in features(word)]


class Odds(dict):
    """Emission odds by word, computed once per worker and kept up to CACHE words."""

    def __init__(self, model: Chain):
        super().__init__()
        self.w, self.bias = model.w, model.bias

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        x = self[word] = float(self.w[slots(word)].sum()) + self.bias
        return x


class Chain:
    """Two states, clean and toxic: emission odds e_t of toxic, transition odds a[i][j], start odds."""

    def __init__(self):
        self.w = np.zeros(MASK + 1)
        self.bias, self.start = -3.0, -2.0
        self.trans = np.array([[0.0, -1.0], [0.0, 0.5]])
        self.cal = np.array([-4.0, 6.0, 0.5])
        self.held: Odds | None = None

    def odds(self, words: list[str]) -> np.ndarray:
        """Log odds of each word's emission."""
        if self.held is None:
            self.held = Odds(self)
        return np.fromiter(map(self.held.__getitem__, words), np.float64, len(words))

    def marginals(self, seqs: list[np.ndarray], pairs: bool = False):
        """P(toxic) of every token of every sequence, all sequences stepping together; with pairs, summed P of transitions too."""
        order = np.argsort([-len(s) for s in seqs], kind="stable")
        lens = np.array([len(seqs[i]) for i in order])
        live = int((lens > 0).sum())
        n = int(lens[0]) if live else 0
        if not n:
            return [np.zeros(0) for _ in seqs], np.zeros((2, 2))
        active = np.searchsorted(-lens, -np.arange(n), side="left")  # sequences longer than t
        offset = np.concatenate([[0], np.cumsum(active)])
        e = np.empty(offset[-1])
        for rank, i in enumerate(order[:live]):
            e[offset[: lens[rank]] + rank] = seqs[i]
        t = np.exp(self.trans)
        # forward odds f = P(toxic)/P(clean) so far, backward odds b likewise
        f, b = np.empty_like(e), np.empty_like(e)
        grow = np.exp(np.clip(e, -40, 40))
        last = None
        for k in range(n):
            m, o = active[k], offset[k]
            if last is None:
                f[o : o + m] = grow[o : o + m] * np.exp(self.start)
            else:
                p = last[:m]
                f[o : o + m] = grow[o : o + m] * (t[0, 1] + p * t[1, 1]) / (t[0, 0] + p * t[1, 0])
            np.clip(f[o : o + m], 1e-30, 1e30, out=f[o : o + m])
            last = f[o : o + m]
        nxt, width = None, 0
        for k in range(n - 1, -1, -1):
            m, o = active[k], offset[k]
            b[o : o + m] = 1.0
            if width:
                g = nxt * grow[offset[k + 1] : offset[k + 1] + width]
                b[o : o + width] = (t[1, 0] + t[1, 1] * g) / (t[0, 0] + t[0, 1] * g)
            nxt, width = b[o : o + m], m
        x = f * b
        p = x / (1 + x)
        sums = np.zeros((2, 2))
        if pairs:
            for k in range(n - 1):
                m, o, q = active[k + 1], offset[k], offset[k + 1]
                fa, g = f[o : o + m], b[q : q + m] * grow[q : q + m]
                cell = [t[0, 0] * np.ones(m), t[0, 1] * g, fa * t[1, 0], fa * t[1, 1] * g]
                z = sum(cell)
                sums += np.array([(c / z).sum() for c in cell]).reshape(2, 2)
        out: list[np.ndarray] = [np.zeros(0)] * len(seqs)
        for rank, i in enumerate(order[:live]):
            out[i] = p[offset[: lens[rank]] + rank]
        return out, sums

    def score(self, probs: list[np.ndarray]) -> np.ndarray:
        x = np.array([[1.0, p.max() if len(p) else 0.0, np.log1p(p.sum())] for p in probs])
        return 1 / (1 + np.exp(-np.clip(x @ self.cal, -40, 40))) if len(x) else np.zeros(0)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def fit(texts: list[str], toxic: list[int], epochs: int = 16) -> Chain:
    """Fit a chain on labelled texts; with one class only, every score is low."""
    model = Chain()
    y = np.array(toxic, dtype=float)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        model.cal = np.array([-4.0, 0.0, 0.0])
        return model
    keys: dict[str, int] = {}
    parts = [np.fromiter((keys.setdefault(w, len(keys)) for w in words_of(t)), np.int64) for t in texts]
    flat_a, cuts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
    in_toxic = np.repeat(y == 1, [len(p) for p in parts])
    del parts
    first = np.zeros(len(flat_a), dtype=bool)
    first[[c for c in cuts[:-1] if c < len(flat_a)]] = True
    last = np.concatenate([first[1:], [True]]) if len(flat_a) else first
    before = np.where(first, -1, np.concatenate([[-1], flat_a[:-1]]))
    after = np.where(last, -1, np.concatenate([flat_a[1:], [-1]]))
    context = (before * 1_000_003 + flat_a) * 1_000_003 + after
    have = []
    for label in (False, True):
        on = in_toxic == label
        _, at = np.unique(context[on], return_index=True)
        have.append(np.bincount(flat_a[on][at], minlength=len(keys)))
    # a feature marks toxic tokens if chance would hardly put so many of its contexts into toxic documents;
    # words come first, and prefixes are judged by the words that do not mark by themselves
    base = have[1].sum() / max(1, have[0].sum() + have[1].sum())
    marks: set[str] = set()
    for whole in (True, False):
        by_feature: tuple[Counter, Counter] = Counter(), Counter()
        for w, k in keys.items():
            names = features(w)
            for f in names[:1] if whole else names[1:] if names[0] not in marks else []:
                by_feature[0][f] += int(have[0][k])
                by_feature[1][f] += int(have[1][k])
        need = np.log(20.0 * max(1, sum(c > 0 for c in by_feature[1].values())))
        for f, c in by_feature[1].items():
            n = c + by_feature[0][f]
            q = c / n if n else 0.0
            if c >= 5 and q > max(0.9, base):
                gain = c * np.log(q / base) + ((n - c) * np.log((1 - q) / (1 - base)) if n > c else 0.0)
                if gain >= need:
                    marks.add(f)
    marked = np.array([not marks.isdisjoint(features(w)) for w in keys])
    tags_a = (marked[flat_a] & in_toxic).astype(float) if len(flat_a) else np.zeros(0)
    if not tags_a.any():
        model.cal = np.array([-4.0, 0.0, 0.0])
        return model
    table_, owner = [], []
    for w, k in keys.items():
        for s in slots(w):
            table_.append(s)
            owner.append(k)
    slot_a, owner_a = np.array(table_), np.array(owner)
    size = np.maximum(1, np.bincount(owner_a, minlength=len(keys)))
    # observed transitions
    prev = np.concatenate([[0.0], tags_a[:-1]])
    seen = np.array([[(~first & (prev == i) & (tags_a == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    total = len(flat_a)
    tag_word = np.bincount(flat_a, weights=tags_a, minlength=len(keys))
    g2 = np.full(MASK + 1, 1e-6)
    for step in range(epochs):
        odds = np.bincount(owner_a, weights=model.w[slot_a], minlength=len(keys)) + model.bias
        e = odds[flat_a]
        probs, pairs = model.marginals([e[a:b] for a, b in zip(cuts, cuts[1:])], pairs=True)
        p = np.concatenate(probs)
        miss = tag_word - np.bincount(flat_a, weights=p, minlength=len(keys))
        grad = np.bincount(slot_a, weights=(miss / size)[owner_a], minlength=MASK + 1) - 0.02 * model.w
        g2 += grad * grad
        model.w += 1.5 * grad / np.sqrt(g2)
        model.bias += float(np.clip(0.5 * miss.sum() / max(1.0, tag_word.sum()), -0.3, 0.3))
        diff = seen - pairs
        model.trans += np.clip(0.3 * diff / np.maximum(seen + pairs, 20.0), -0.2, 0.2)
        model.trans[:, 0] = 0.0  # odds of toxic against clean only
        starts = first.nonzero()[0]
        model.start += float(np.clip(0.5 * (tags_a[starts] - p[starts]).sum() / max(5.0, tags_a[starts].sum()), -0.3, 0.3))
    model.held = None
    odds = np.bincount(owner_a, weights=model.w[slot_a], minlength=len(keys)) + model.bias
    e = odds[flat_a]
    probs, _ = model.marginals([e[a:b] for a, b in zip(cuts, cuts[1:])])
    x = np.array([[1.0, p.max() if len(p) else 0.0, np.log1p(p.sum())] for p in probs])
    c = np.array([-3.0, 5.0, 0.0])
    weight = np.where(y == 1, 1.0, n1 / n0)
    for _ in range(60):  # damped Newton steps for the calibration
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (weight * q * (1 - q) + 1e-6)[:, None]).T @ x + 1e-1 * np.eye(3)
        c = c + 0.7 * np.linalg.solve(h, x.T @ (weight * (y - q)) - 1e-1 * c)
    model.cal = c

    return model


def sample(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int], id_col: str, text_col: str) -> tuple[list[str], list[int]]:
    """At most per_class labelled texts of each class, by hash of the id; conflicting labels count as toxic."""
    spark = docs.sparkSession
    one = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max("toxic").alias("y"))
    ids: list[tuple] = []
    for label in (0, 1):  # two top-k selections, each of a fixed size
        ids += [(r.k, label) for r in one.where(F.col("y") == label).orderBy(F.xxhash64("k"), "k").limit(per_class[label]).collect()]
    if not ids:
        return [], []
    small = F.broadcast(spark.createDataFrame(ids, StructType([field(labels, id_col, "k"), StructField("y", IntegerType())])))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    rows = texts.join(small, F.col("i") == F.col("k")).groupBy("k", "y").agg(F.max("t").alias("t")).collect()
    rows.sort(key=lambda r: (r.y, str(r.k)))
    return [r.t or "" for r in rows], [r.y for r in rows]


_HELD: dict[str, Chain] = {}


def spans(text: str, probs: np.ndarray, level: float) -> list[tuple[int, int, float]]:
    """Offsets (start, end, largest probability) of runs of neighbouring toxic words."""
    if not len(probs) or probs.max() < level:
        return []
    out: list[tuple[int, int, float]] = []
    last = -2
    for k, (m, p) in enumerate(zip(WORD.finditer(text), probs)):
        if p >= level:
            out[-1:] = [(out[-1][0], m.end(), max(out[-1][2], float(p)))] if last == k - 1 else [*out[-1:], (m.start(), m.end(), float(p))]
            last = k
    return out


def score_documents(docs: DataFrame, labels: DataFrame, train: Callable[[DataFrame], DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", level: float = 0.5, with_spans: bool = True, carry: tuple[str, ...] = (), per_class: tuple[int, int] = SAMPLE_PER_CLASS) -> DataFrame:
    """The operator: rows (id, carry columns, score, spans array<struct<start, end, p>>) for every document.

    `train` chooses the label rows to learn from. Offsets count code points of the lower-cased
    text. A null or empty text has no spans and the score of a text without words. Every row is
    scored whole, one by one, without a shuffle; extra columns are left out unless carried.
    """
    spark = tune(docs.sparkSession)
    learn = train(labels) if train else labels
    model = fit(*sample(docs, learn, per_class, id_col, text_col))
    model.held = None
    shared, key = spark.sparkContext.broadcast(model), os.urandom(8).hex()
    keep = [id_col, *carry]
    schema = [field(docs, c) for c in keep] + [StructField("score", DoubleType())]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    if with_spans:
        schema.append(StructField("spans", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("p", DoubleType())]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = shared.value
        chain = _HELD[key]
        for batch in batches:
            texts = [(x.as_py() or b"").decode("utf-8", "replace").lower() for x in batch.column(len(keep))]
            probs, _ = chain.marginals([chain.odds(WORD.findall(t)) for t in texts])
            cols = [batch.column(i) for i in range(len(keep))] + [pa.array(chain.score(probs), pa.float64())]
            if with_spans:
                cols.append(pa.array([[{"start": a, "end": b, "p": p} for a, b, p in spans(t, q, level)] for t, q in zip(texts, probs)], kind))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return docs.select(*keep, docs[text_col].cast("binary").alias("__raw")).mapInArrow(run, StructType(schema))


#: Share of labels that learning never sees: ids whose crc32 leaves this remainder.
HELD_MOD, HELD_REST, THRESHOLD = 4, 2, 0.3


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, table(spark, sf_dir, "labels"), lambda x: x.where(crc_mod("doc_id", HELD_MOD) != HELD_REST))
    return out.select(
        "doc_id",
        (crc_mod("doc_id", HELD_MOD) == HELD_REST).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE: dict[str, str] = {}
