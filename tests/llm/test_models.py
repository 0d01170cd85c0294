"""HTML extraction, toxicity, embedding and MinHash near-dedup, and the pipeline."""

import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoquilt.llm import itq, labeller, neardup, toxicity

# ---- HTML


def test_labeller_on_new_pages():
    model, rng, right, total = labeller.train(), random.Random(123), 0, 0
    for _ in range(60):
        x, y = labeller.labelled(labeller.make_page(rng))
        p = model.forward(*labeller.padded([x]))[:, 0]
        right += int(((p >= 0.5) == (y > 0.5)).sum())
        total += len(y)
    assert right / total > 0.985


def said(page):
    return [b.text for b in labeller.leaves(page)]


def test_leaves():
    page = "<!-- <p>no</p> --><title>no</title><script>var a = '</p>';</script><p>one&nbsp;&amp;<br>two <b>three<p>four<ul><li>a<li>b</ul><svg><text>no</text></svg><a href='>'>link</a>"
    assert said(page) == ["one & two three", "four", "a", "b", "link"]
    assert labeller.leaves("") == [] and said("<<<p") == ["<<<p"] and said("a < b <p") == ["a < b <p"]
    assert said("a<div>b</span></div>c") == ["a", "b", "c"]
    assert len(labeller.leaves("<div>" * 3000 + "x")) == 1
    assert said("<p title=it's>x</p><p title='a>b'>y<!-- z") == ["x", "y"]
    assert said("<p>&#65;&#0000000000065;&#x41;&#" + "9" * 5000 + ";") == ["AAA\ufffd"]


def test_path_is_the_sum_of_open_names():
    def path(*names):
        x = np.zeros(labeller.PATH_DIM, np.float32)
        for n in names:
            s = labeller.PATH_SLOT[n]
            x[s >> 1] += -1.0 if s & 1 else 1.0
        return x.tobytes()

    got = labeller.leaves('<div class="Post body"><p>a<b>b</p></b><font><h2>c</h2></div>d')
    assert [(b.text, b.last) for b in got] == [("ab", "p"), ("c", "h2"), ("d", "")]
    # the paragraph's block ends with the bold text in it still open
    assert [b.path for b in got] == [path("div", ".post", ".body", "p", "b"), path("div", ".post", ".body", "font", "h2"), path()]


@pytest.mark.parametrize("page", ["<a" * 1_000_000, "<font>" * 170_000 + "x", "<font>x" * 150_000, '<a "' * 250_000 + ">", '<a b="<a>" ' * 100_000 + '"', "<h1>" * 200_000, "<thead>" * 150_000, "<font>" * 80_000 + "</b>" * 100_000, "<p><table><td>" + "<font>" * 50_000 + "<div>" * 100_000, "&#" + "9" * 1_000_000, "<!--" * 250_000, "<a " + "= " * 500_000])
def test_malformed_pages_take_linear_time(page):
    began = time.process_time()
    labeller.train().label([labeller.leaves(page)])
    assert time.process_time() - began < 30  # seconds on a busy machine; 2 or less alone


def test_lstm_equals_a_scalar_version():
    model, rng = labeller.BiLSTM(3), random.Random(2)
    page = labeller.leaves(labeller.make_page(rng))
    x, h = labeller.vectors(page).astype(float).tolist(), labeller.HIDDEN_DIM
    logistic = lambda v: 1 / (1 + math.exp(-v))
    score = [float(model.p["bias"][0])] * len(x)
    for d, first in (("f", 0), ("b", h)):
        wx, wh, c = (model.p[k + d].tolist() for k in "xhc")
        hid, cell = [0.0] * h, [0.0] * h
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = [c[j] + sum(v * wx[k][j] for k, v in enumerate(x[t]) if v) + sum(hid[k] * wh[k][j] for k in range(h)) for j in range(4 * h)]
            cell = [logistic(a[h + j]) * cell[j] + logistic(a[j]) * math.tanh(a[3 * h + j]) for j in range(h)]
            hid = [logistic(a[2 * h + j]) * math.tanh(cell[j]) for j in range(h)]
            score[t] += sum(hid[j] * float(model.p["out"][first + j, 0]) for j in range(h))
    want = [logistic(v) for v in score]
    assert np.allclose(model.label([page])[0], want) and np.allclose(model.label_long(page), want)


def test_gradients_equal_differences():
    model, rng = labeller.BiLSTM(3), random.Random(4)
    data = [labeller.labelled(labeller.make_page(rng)) for _ in range(3)]
    x, mask = labeller.padded([d[0] for d in data])
    y = np.zeros(mask.shape)
    for k, d in enumerate(data):
        y[: len(d[1]), k] = d[1]
    g, _ = model.gradients(x, mask, y)
    pick = np.random.default_rng(0)
    for name, p in model.p.items():
        for _ in range(4):
            at = tuple(int(pick.integers(0, n)) for n in p.shape)
            keep, e = p[at], 1e-5
            p[at] = keep + e
            up = model.gradients(x, mask, y)[1]
            p[at] = keep - e
            down = model.gradients(x, mask, y)[1]
            p[at] = keep
            assert g[name][at] == pytest.approx((up - down) / (2 * e), rel=1e-3, abs=1e-7), (name, at)


def test_long_page_in_parts(monkeypatch):
    model = labeller.train()
    page = labeller.leaves("<article>" + "".join(f"<p>Paragraph {k} of the text, and more.</p>" for k in range(40)) + "</article><footer>end</footer>")
    whole = model.label([page])[0]
    monkeypatch.setattr(labeller, "PART", 7)
    assert np.allclose(model.label([page])[0], whole)


def test_extract(spark):
    body = "<html><body><nav><ul>" + "".join(f"<li><a href=#>Item {k}</a></li>" for k in range(6)) + "</ul></nav><article><h1>A title</h1><p>First  paragraph of\n the text, long enough to read.</p><p>Second one follows here, with commas, and ends.</p></article><footer>&copy; Someone 2020</footer></body></html>"
    rows = [(1, "u", body), (1, "u", body), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (4, "u", "<article>" + "<p>Many words stand here in a row.</p>" * 3000 + "</article>")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, __html int")
    got = labeller.extract(df, with_blocks=True).collect()
    assert len(got) == len(rows)
    text = "A title\nFirst paragraph of the text, long enough to read.\nSecond one follows here, with commas, and ends."
    assert [r.text for r in got if r.page_id == 1] == [text, text]
    assert all(r.n_chars == len(r.text) for r in got) and sum(r.text == "" for r in got) == 3
    assert labeller.extract(df.where("false")).count() == 0


# ---- toxicity


def toxic_rows(n=400, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 7)))
    rows = []
    for i in range(n):
        text, bad = [word() for _ in range(rng.randrange(10, 80))], i % 4 == 0
        for _ in range(rng.randrange(1, 4) if bad else 0):
            text[rng.randrange(len(text))] = rng.choice(["scoundrel", "Villain!", "zonk" + word()])
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "a") for i, t, _ in rows] + [(9000, None, "a"), (9001, "", "a"), (9002, "x " * 60_000 + "villain", "a"), (None, "fine", "a"), (3, rows[3][1], "a")], "doc_id long, text string, score string").selectExpr("*", "1 as k", "2 as y", "3 as t")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(0, None), (None, 1), (5, 0), (5, 0)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [(i, t, y) for i, t, y in rows if i % 3 == 0]
    assert np.mean([(out[i].score >= 0.3) == bool(y) for i, _, y in held]) > 0.97
    assert out[9000].score == out[9001].score < 0.3 <= out[9002].score and all(0 <= r.score <= 1 for r in out.values())
    i, t, _ = next(x for x in rows if x[2] and "villain" in x[1].lower())
    assert any("villain" in t.lower()[s.start : s.end] for s in out[i].spans)
    assert toxicity.score_documents(docs.where("false"), labels).count() == 0
    for only in (labels.where("toxic = 0"), labels.where("false")):
        assert {r.score >= 0.3 for r in toxicity.score_documents(docs, only).collect()} == {False}


def test_marginals_equal_enumeration():
    model, rng = toxicity.Chain(), np.random.default_rng(0)
    seqs = [rng.normal(size=n) for n in (4, 1, 0, 6)]
    got, pairs = model.marginals(seqs, pairs=True)
    want_pairs = np.zeros((2, 2))
    for e, p in zip(seqs, got):
        n = len(e)
        total, one = 0.0, np.zeros(n)
        pp = np.zeros((2, 2))
        for code in range(2**n):
            z = [(code >> k) & 1 for k in range(n)]
            s = np.exp(sum(e[k] * z[k] for k in range(n)) + (model.start * z[0] if n else 0) + sum(model.trans[a, b] for a, b in zip(z, z[1:])))
            total += s
            one += s * np.array(z, float)
            for a, b in zip(z, z[1:]):
                pp[a, b] += s
        assert np.allclose(p, one / total)
        want_pairs += pp / total
    assert np.allclose(pairs, want_pairs)


# ---- components of links, shared by the two near-dedups


def closed(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_links(rows, cosine=0.95):
    """(links, least reachable id) of every row, each row a vector of its own."""
    unit = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            u = np.array(v) / np.abs(v).max()
            unit[n] = u / np.linalg.norm(u)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    n_links, comp = Counter(k for l in links for k in l), closed(list(range(len(rows))), links)
    least = {}
    for n, c in comp.items():
        if rows[n][0] is not None:
            least[c] = min(least.get(c, rows[n][0]), rows[n][0])
    return Counter((i, n_links[n], None if i is None else least[comp[n]], i is None or least[comp[n]] == i) for n, (i, _) in enumerate(rows))


@pytest.mark.parametrize("small", [False, True])
def test_vectors_equal_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(itq, "CHUNK", 4)
        monkeypatch.setattr(itq, "WIDE", 3)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    x = [c + rng.normal(scale=s, size=24) for c in centres for s in (0.05, 0.1, 0.12, 0.15, 0.2)] + [centres[0] * k for k in (1.0, 3.0, 1e-160)]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 24), (502, [float("nan")] + [1.0] * 23), (503, [1.0] * 7), (504, x[3].tolist()), (504, x[3].tolist()), (505, [None] + [1.0] * 23)]
    # several lengths, an empty one, rows without id, one id with two vectors
    rows += [(510 + k, [1.0, 2.0 + 0.1 * (k % 3)]) for k in range(9)] + [(530, [5.0]), (531, [-1.0]), (532, [7.0]), (533, []), (None, x[3].tolist()), (None, None), (504, x[9].tolist()), (2, x[60].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int")
    assert Counter(map(tuple, itq.near_vectors(df).collect())) == brute_links(rows)
    assert itq.near_vectors(df.where("false")).count() == 0


def test_bands_of_any_width(spark, monkeypatch):
    """A band of copies and strangers, wider than a chunk: the same components as all pairs have."""
    monkeypatch.setattr(itq, "CHUNK", 5)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3, 16))
    x = np.concatenate([base[0] + rng.normal(scale=0.05, size=(40, 16)), base[1] + rng.normal(scale=0.05, size=(9, 16)), rng.normal(size=(12, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sig = itq.in_bytes(x)
    df = spark.createDataFrame([(7, i, len(x), 0, s) for i, s in enumerate(sig)], "bk long, rep long, n long, lead long, sig binary")
    got = closed(list(range(len(x))), [(r.a, r.b) for r in itq.propose_wide(df, 0.95, 3).collect()])
    may = itq.Rounded(sig).near(np.arange(len(x)), np.arange(len(x)), 0.95)
    assert got == closed(list(range(len(x))), [tuple(p) for p in np.argwhere(may).tolist()])
    assert not ((x @ x.T >= 0.95) & ~may).any() and (may & (x @ x.T < 0.92)).sum() == 0


def around(n, shift, seed, d=64):
    """Unit vectors whose mean cosine is about shift^2 / (1 + shift^2), and one at cosine 0.9501 to each."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + shift
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = rng.normal(size=x.shape)
    t -= (t * x).sum(axis=1, keepdims=True) * x
    return x, 0.9501 * x + np.sqrt(1 - 0.9501**2) * t / np.linalg.norm(t, axis=1, keepdims=True)


@pytest.mark.parametrize("shift,total", [(0, 130_000), (1, 1_000_000), (2, 130_000), (0, 8_000_000), (0, 1_000_000_000)])
def test_recall_does_not_fall_with_size_or_a_common_mean(shift, total):
    coder = itq.Coder(around(8192, shift, 1)[0], total, 0.95)
    a, b = around(4000, shift, 2)
    assert coder.width and (coder.code(a) == coder.code(b)).any(axis=1).mean() >= 0.997
    both = itq.Rounded(itq.in_bytes(a) + itq.in_bytes(b))
    assert (both.pair(np.arange(len(a)), np.arange(len(a)) + len(a)) >= 0.95).all()


def test_vectors_of_an_uncentred_table_equal_brute_force(spark):
    x = np.concatenate(around(2500, 2.0, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = (x @ x.T >= 0.95).sum() - len(x)
    got = itq.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert 0.997 * want <= got <= want


def brute_near(rows, num=85, den=100):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).encode().split()
        sets[n] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    real = [n for n in sets if sets[n] and rows[n][0] is not None]
    links = [(rows[a][0], rows[b][0]) for a in real for b in real if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = closed([i for i, _ in rows if i is not None], links)
    return Counter((i, len(sets[n]), comp.get(i), i is None or comp[i] == i) for n, (i, _) in enumerate(rows))


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    if small:  # very small chunks and bands take every path of the large groups
        monkeypatch.setattr(neardup, "CHUNK", 3)
        monkeypatch.setattr(neardup, "WIDE", 3)
        monkeypatch.setattr(neardup, "PIVOTS", 1)
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz") * rng.randrange(1, 5)
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.randrange(20, 150))]
        for _ in range(rng.choice([1, 2, 12])):
            t = list(text)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = word()
            rows.append((rng.randrange(10_000), rng.choice([" ", "\n"]).join(t)))
    rows = list({i: (i, t) for i, t in rows}.values())
    rows += [(20_000, None), (20_001, ""), (20_002, " \t"), (20_003, "one two"), (20_004, "ONE  two"), (20_005, "two one"), (None, rows[0][1]), rows[1], (20_006, "long " * 30_000), (20_007, "a b c d e"), (20_008, "a b c d e")]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean")
    assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == brute_near(rows)
    if not small:
        assert neardup.near_duplicates(df.where("false")).count() == 0


def test_a_large_group_meets_in_blocks(spark, monkeypatch):
    """What one task compares at once is bounded, however many of a group are outside its largest component."""
    monkeypatch.setattr(neardup, "CHUNK", 8)
    monkeypatch.setattr(neardup, "SIDE", 1, raising=False)
    most, confirm = [], neardup.confirm

    def watched(rows, *rest):
        most.append(rows.groupBy("g", "chunk").count().agg(F.max("count")).first()[0])
        return confirm(rows, *rest)

    monkeypatch.setattr(neardup, "confirm", watched)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(rng.randrange(0, 7)):
            t[rng.randrange(len(t))] += rng.choice("abcdefghij") * rng.randrange(1, 20)
        rows.append((i, " ".join(t)))
    want = brute_near(rows)
    assert sum(c != 0 for _, _, c, _ in want) > 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == want
    assert len(most) == 2 and max(most) <= 60


@pytest.mark.parametrize("at_a_time", [3, 1 << 20])
def test_overlaps_equal_single_intersections(monkeypatch, at_a_time):
    monkeypatch.setattr(neardup, "SLAB", at_a_time)
    monkeypatch.setattr(neardup, "PAIRS", at_a_time)
    rng = np.random.default_rng(2)
    for na, nb, words in ((1, 1, 5), (5, 7, 40), (60, 50, 400), (30, 40, 1 << 40)):
        a, b = ([np.unique(rng.integers(0, words, rng.integers(1, 90)).astype(np.uint64)) for _ in range(n)] for n in (na, nb))
        b[0] = a[0]
        assert (neardup.overlaps(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_signatures():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.85, 0.95):
        both = rng.integers(0, 1 << 62, 2000).astype(np.uint64)
        n = int(2000 * (1 - share) / (1 + share) * (1 + share) / 2)
        a = np.unique(np.concatenate([both, rng.integers(0, 1 << 62, n).astype(np.uint64)]))
        b = np.unique(np.concatenate([both, rng.integers(0, 1 << 62, n).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sig = [np.frombuffer(neardup.packed(neardup.minima(s)), np.uint8)[None] for s in (a, b)]
        assert abs(neardup.estimate(*sig)[0] - true) < 0.15


# ---- pipeline


def plain_leaks(items, text):
    """Items that any stretch of the text comes within the budget of, by a table of edit distances."""
    from cytoquilt.llm.decontaminate import RATE, normal

    found, t = [], normal(text or "")
    for k, item in items:
        n = normal(item or "")
        if n and t:
            prev = [0] * (len(t) + 1)
            for i, a in enumerate(n, 1):
                cur = [i]
                for j, b in enumerate(t, 1):
                    cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
                prev = cur
            if min(prev) <= int(RATE * (len(n) - 2)):
                found.append(k)
    return found


def put(spark, d, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, rest int, kept int, score double, bucket int, k int, raw string, __raw string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def doc(i, t, lang="en"):
    return (i, t, lang, "s", len(t or ""), 1, 1, 0.5, 1, 1, "r", "x")


def test_pipeline_equals_its_parts(spark, tmp_path):
    import corpus_pipeline
    from tests_llm_helpers import brute_lines_text, near_kept

    rng = random.Random(8)
    rows = [(i, t, y) for i, t, y in toxic_rows(300, 9)]
    item = "the seventh question asks which river is the longest one in the world today"
    footer = "this footer line is shared by very many of the documents here"
    texts = {i: t for i, t, _ in rows}
    for i in list(texts)[1:60:2]:
        texts[i] += "\n" + footer
    texts[6] += "\n" + item.upper()
    texts[10] += "\n" + item.replace("river", "rivr").replace("today", "todays")
    texts[14] += "\n" + item.replace("seventh question asks", "question is").replace("in the world", "of all")
    for k in (1, 2, 3):
        texts[1000 + k] = texts[k]
    put(spark, str(tmp_path), [doc(i, t) for i, t in texts.items()] + [doc(5000, None)], [(i, y) for i, _, y in rows], [(1, item), (2, None)])
    got = corpus_pipeline.run(spark, str(tmp_path))
    out = {r.doc_id: r for r in got.collect()}
    toxic = {i for i, _, y in rows if y}
    clean = [(i, t) for i, t in [*texts.items(), (5000, None)] if i not in toxic and not (i >= 1000 and i - 1000 in toxic)]
    kept = near_kept(brute_lines_text(clean), 80, 100)
    want = {i for i, t in kept if not plain_leaks([(1, item)], t)}
    assert set(out) == want and 6 not in out and 10 not in out and 14 in out and 1001 not in out
    assert all(out[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in kept if i in want)


def test_pipeline_edges(spark, tmp_path):
    """Repeated ids, rows without id or text, long texts, clashing names; and empty tables."""
    import corpus_pipeline

    long = "w " * 30_000
    docs = [doc(1, "one text of some words that stands here by itself"), doc(1, "quite another one under the same id, nothing like it"), doc(1, "one text of some words that stands here by itself", "fr"), doc(1, "one text of some words that stands here by itself", "de")]
    docs += [doc(None, "a text without any id"), doc(None, "a text without any id"), doc(2, None), doc(3, ""), doc(4, long), doc(5, long + "x"), (6, "only a text", None, None, None, None, None, None, None, None, None, None)]
    docs += [doc(7, "it holds the item which river of the world is the longest one of all")]
    items = [(1, "Which river of the world is the longest one of all"), (None, None)]
    put(spark, f"{tmp_path}/a", docs, [(1, 0), (None, None)], items)
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(r[0], sha(r[1])) for k, r in enumerate(docs) if k not in (2, 3, 11)]
    assert sorted(want, key=str) == sorted([(r.doc_id, r.decoded_sha256) for r in got], key=str)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    first = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    kept = [sorted(map(str, stage(spark, first.repartition(n), "").where("doc_id = 1").collect())) for n in (1, 3)]
    assert kept[0] == kept[1] and len(kept[0]) == 2 and any("'de'" in r for r in kept[0])
    for name, some in (("no_docs", ([], [(1, 1)], items)), ("no_items", (docs, [(1, 0)], [])), ("no_labels", (docs[:3], [], items))):
        put(spark, f"{tmp_path}/{name}", *some)
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
        assert out.count() == {"no_docs": 0, "no_items": len(want) + 1, "no_labels": 2}[name]
