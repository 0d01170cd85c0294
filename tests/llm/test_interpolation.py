import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cytoquilt.llm import blocks
from cytoquilt.llm import interpolation as L


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 40, 1000):
        k = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        assert (blocks.unpack_keys(blocks.pack_keys(k)) == k).all()
        wide = np.empty(len(k), blocks.KEY16)
        wide["lo"], wide["hi"] = k, k[::-1]
        assert (blocks.unpack_keys(blocks.pack_keys(wide), blocks.KEY16) == wide).all()
        words, pairs = k & ~np.uint64(1), (k >> np.uint64(14) << np.uint64(14)) | np.uint64(1)
        both = np.unique(np.concatenate([words, pairs]))
        assert (L.TwoKinds().unpack(L.TwoKinds().pack(both)) == both).all()
        c = rng.integers(0, 70_000, n)
        assert (blocks.unpack_counts(blocks.pack_counts(c)) == c).all()


def test_blocks_grow_with_the_input():
    gb = 1 << 30
    each = [blocks.most_blocks(s, b) / s for s in (100 * gb, 1000 * gb, 10_000 * gb, 100_000 * gb) for b in (4 << 20, 8 << 20)]
    assert max(each) <= (1 + blocks.FAN / blocks.TEAM) * blocks.FAN / blocks.BUCKET_BYTES * 1.01
    assert all(blocks.most_blocks(s) <= 1.5 * s * blocks.FAN / blocks.BUCKET_BYTES for s in (gb, 30 * gb))


def brute(rows):
    docs = []
    for i, t in rows:
        s = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        docs.append((i, zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2, [*s, "END"]))
    uni, bi = Counter(), Counter()
    for _, h, d in docs:
        if not h:
            uni.update(d)
            bi.update(zip(["START", *d[:-1]], d))
    uni["START"] = uni["END"]
    return docs, uni, bi


@pytest.mark.parametrize("deep", [False, True])
def test_equals_brute_force(spark, monkeypatch, deep):
    if deep:  # regions and teams
        monkeypatch.setattr(blocks, "FAN", 8)
        monkeypatch.setattr(blocks, "TEAM", 5)
    rng = random.Random(2)
    words = ["a", "B", "the", "é", "cat", "x" * 30, "dog"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    rows += [(150, None), (151, ""), (None, "the cat"), (3, rows[3][1]), (152, "the cat " * 3000)]
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, held_out boolean")
    out, weights = L.fit_and_score(df)
    got = sorted([tuple(r) for r in out.collect()], key=str)
    docs, uni, bi = brute(rows)
    n = sum(c for w, c in uni.items() if w != "START")
    v = len(uni) - 1
    want = []
    for i, h, d in docs:
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in d)
        c = np.array([uni[w] for w in ["START", *d[:-1]]])
        p = np.array([bi[x] for x in zip(["START", *d[:-1]], d)])
        score = L.log_prob(c, p, np.array([uni[w] for w in d]), weights, n, v)
        want.append((i, h, len(d), sum(uni[w] > 0 for w in d), n, base, score))
    want.sort(key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6])
    assert np.allclose(weights.sum(axis=1), 1)


def test_weights_equal_unbinned_expectation_maximisation():
    """EM over the tokens themselves, each by the counts of the other documents, without bins."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    step = {w: rng.sample(words, 4) for w in words}
    rows = []
    for i in range(300):
        t = [rng.choice(words)]
        for _ in range(rng.randrange(5, 40)):
            t.append(rng.choice(step[t[-1]]) if rng.random() < 0.8 else rng.choice(words))
        rows.append((i, " ".join(t)))
    docs, uni, bi = brute(rows)
    n, v = sum(c for w, c in uni.items() if w != "START"), len(uni) - 1
    tokens = []
    for _, held_out, d in docs:
        if not held_out:
            own_w, own_p = Counter(d), Counter(zip(["START", *d[:-1]], d))
            own_w["START"] = 1
            tokens += [(uni[a] - own_w[a], bi[a, b] - own_p[a, b], uni[b] - own_w[b]) for a, b in zip(["START", *d[:-1]], d)]
    c, p, w = np.array(tokens).T
    # the operator's own way: cells of a histogram
    cell, times = np.unique(L.cells(c, p, w), return_counts=True)
    got = L.learn(dict(zip(cell.tolist(), times.tolist())), n, v)
    bucket = np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))), 0).astype(int)
    q = np.stack([np.where(c > 0, p / np.maximum(c, 1), 0.0), w / n, np.full(len(c), 1 / (v + 1))], axis=1)
    want = np.tile([0.4, 0.5, 0.1], (L.CONTEXTS, 1))
    want[0] = [0.0, 0.9, 0.1]
    for _ in range(400):
        share = want[bucket] * q
        share /= share.sum(axis=1, keepdims=True)
        for k in np.unique(bucket):
            total = share[bucket == k].sum(axis=0) + [0, 0.5, 0.5]
            want[k] = total / total.sum()
    for k in np.unique(bucket):
        if (bucket == k).sum() > 300:
            assert np.abs(got[k] - want[k]).max() < 0.03, (k, got[k], want[k])


def test_model_beats_base(spark, sf_dir):
    out, _ = L.fit_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    r = out.where("held_out").selectExpr("sum(score)", "sum(base_score)", "count(*)").first()
    assert r[2] > 0 and r[0] > r[1]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.fit_and_score(df)[0].count() == 0
