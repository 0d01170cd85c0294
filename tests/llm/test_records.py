"""WARC conversion, line dedup and substring dedup against brute force, with their edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoquilt.llm import blocks, common, lines, passages, warc

WS = b" \t\n\x0b\x0c\r"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bucket string, n_lines int")


# ---- WARC


def test_arc_versions():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npay\nload"
    for version in (1, 2):
        raw = warc.arc_version_block(version, "f.arc") + warc.arc_record(version, "http://a/b", "20010203040506", "text/html", block, "f.arc") + warc.arc_record(version, "http://a/c d", "20010203040506", "text/html", b"", "f.arc")
        got = list(warc.read_arc(raw))
        assert [g["block"] for g in got] == [block, b""] and got[0]["URL"] == "http://a/b" and got[1]["URL"] == "http://a/c%20d"
        fields, body = next(warc.read_warc(warc.warc_record(got[0], "response") + b"\r\n\r\n"))
        assert body == block and fields["WARC-Date"] == "2001-02-03T04:05:06Z" and fields["WARC-Payload-Digest"] == "sha1:" + warc.base32_sha1(b"pay\nload")
        assert warc.warc_record(got[0], "response") == warc.warc_record(got[0], "response")
        with pytest.raises(warc.ArcError):
            list(warc.read_arc(raw[:-5]))
    with pytest.raises(warc.ArcError):
        list(warc.read_arc(b"http://a 0.0.0.0 2001 text/html 1\nx\n"))


def test_warc_round_trip(spark, tmp_path):
    big, other = "é" * 600, "WARC/1.0\r\n\r\n" * 100
    rows = [(1, "u", big), (9, "u v", big), (5, None, big), (9, "u", big), (2, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", other), (8, "u", other), (None, "u", big), (10, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, record_type int")
    warc.convert(warc.pages_as_arc(df), f"{tmp_path}/w")
    got = warc.read_warc_files(spark, f"{tmp_path}/w")
    assert got.where("sound = 0").count() == 0
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        top = max(k for k, _, x in rows if (x or "") == (h or "") and k is not None)
        again = len(p) >= 1000 and i != top
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    empty = f"{tmp_path}/e"
    warc.convert(warc.pages_as_arc(df.where("false")), empty)
    assert warc.read_warc_files(spark, empty).count() == 0


def test_archives_are_bounded(spark, monkeypatch, tmp_path):
    """Whatever the partitions, an archive holds FILE_BYTES or one record; more pages than an Arrow batch holds."""
    monkeypatch.setattr(warc, "FILE_BYTES", 50_000)
    own = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        pages = spark.range(1500).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") == 7, F.repeat(F.lit("z"), 300_000)).when(F.col("id") < 500, F.repeat(F.lit("copy "), 300)).otherwise(F.repeat(F.concat(F.lit("w"), F.col("id").cast("string")), 250)).alias("html")).coalesce(1)
        warc.convert(warc.pages_as_arc(pages), f"{tmp_path}/w")
        got = warc.read_warc_files(spark, f"{tmp_path}/w").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)
    size = sorted(len(warc.gunzip(f.read_bytes())) for f in (tmp_path / "w").glob("*.gz"))
    assert len(size) > 20 and size[-2] <= 50_004 and 300_000 < size[-1] < 301_000
    assert len(got) == 1500 and all(r.sound for r in got)
    assert {(r.record_type, r.refers_to) for r in got if r.key < 499 and r.key != 7} == {("revisit", 499)}
    assert {r.record_type for r in got if r.key >= 499 or r.key == 7} == {"response"}


def test_no_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        common.shared_root(Session())


# ---- lines


def brute_lines(rows, min_chars=40, min_docs=5):
    where = defaultdict(set)
    key = lambda x: x.strip(WS).lower()
    for i, t in rows:
        for x in (t or "").encode().split(b"\n"):
            if len(key(x).decode()) >= min_chars:
                where[key(x)].add(i)
    last = {k: max(v) for k, v in where.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        all_ = (t or "").encode().split(b"\n")
        kept = [x for x in all_ if last.get(key(x), i) == i]
        out.append((i, len(all_), len(all_) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return out


def test_lines_need_the_index(spark, monkeypatch):
    rows = [(i, "a line that is long enough to count as one of many") for i in range(6)]
    gone = lambda: {r.doc_id: r.n_dropped for r in lines.dedup_lines(docs(spark, rows), lambda kept, n, gone: (n, gone, ""), lines.DIGEST).collect()}
    assert gone() == {i: int(i < 5) for i in range(6)}
    kept = lines.line_key(rows[0][1].encode())
    index = lines.LineIndex(np.frombuffer(kept, lines.KEY16), np.array([6]), np.array([5]))
    assert index.probe(np.frombuffer(lines.line_key(b"another line that is as long as the one above"), lines.KEY16))[0].tolist() == [0]
    assert index.probe(np.frombuffer(kept, lines.KEY16))[0].tolist() == [6]


@pytest.mark.parametrize("shards", [1, 5])
def test_lines_equal_brute_force(spark, monkeypatch, shards):
    if shards > 1:
        monkeypatch.setattr(lines, "INDEX_BYTES", 1)
        monkeypatch.setattr(lines, "SHARDS", shards)
        monkeypatch.setattr(lines, "PROBERS", 2)
    line_digest = lambda kept, n, gone: (n, gone, hashlib.sha256(kept).hexdigest())
    rng = random.Random(1)
    pool = [rng.choice(["", "É"]) + f"line {k} " + "word " * rng.randrange(3, 14) for k in range(30)] + ["ñ" * 39, "ñ" * 40, "A" * 40]
    vary = lambda x: rng.choice(["", " ", "\t", "\x0b"]) + (x.upper() if x.isascii() and rng.random() < 0.3 else x) + rng.choice(["", "\r", "  "])
    rows = [(i, "\n".join(vary(rng.choice(pool)) for _ in range(rng.randrange(0, 9)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "A" * 40 + "\n" + "x" * 200_000), (5, rows[5][1])]
    got = lines.dedup_lines(docs(spark, rows), line_digest, lines.DIGEST).collect()
    assert Counter(map(tuple, got)) == Counter(brute_lines(rows))
    assert lines.dedup_lines(docs(spark, rows).where("false"), line_digest, lines.DIGEST).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.empty(n, lines.KEY16)
        keys["lo"], keys["hi"] = rng.integers(0, 1 << 63, n), rng.integers(0, 1 << 63, n)
        assert sorted(lines.PerfectHash(keys).index(keys).tolist()) == list(range(n))
        index = lines.LineIndex(keys, np.arange(n) + 7, np.arange(n, 2 * n))
        count, last = index.probe(keys)
        assert (count == np.arange(n) + 7).all() and (last == np.arange(n, 2 * n)).all()
        strange = keys.copy()
        strange["hi"] ^= np.uint64(1 << 40)
        assert (index.probe(strange)[0] == 0).all()


# ---- passages


def brute_passages(rows, w=35):
    where, words = Counter(), {}
    for n, (_, t) in enumerate(rows):
        words[n] = (t or "").encode().split()
        for k in range(len(words[n]) - w + 1):
            where[tuple(words[n][k : k + w])] += 1
    out = []
    for n, (i, _) in enumerate(rows):
        x, gone = words[n], set()
        for k in range(len(x) - w + 1):
            if where[tuple(x[k : k + w])] > 1:
                gone.update(range(k, k + w))
        out.append((i, len(x), len(gone), hashlib.sha256(b" ".join(v for k, v in enumerate(x) if k not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("deep", [False, True])
def test_passages_equal_brute_force(spark, monkeypatch, deep):
    if deep:  # regions and teams
        monkeypatch.setattr(blocks, "FAN", 8)
        monkeypatch.setattr(blocks, "TEAM", 5)
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 4)
    shared = [" ".join(word() for _ in range(n)) for n in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 50)))] + [rng.choice(shared) if rng.random() < 0.4 else word() for _ in range(3)]
        rng.shuffle(parts)
        rows.append((i, rng.choice([" ", "\n", "\t \r"]).join(parts)))
    rows += [(90, "a " * 36), (91, "a b " * 40), (92, "a b c " * 12), (93, None), (94, ""), (95, "z " * 20_000), (7, rows[7][1]), (None, rows[8][1]), (96, "one " * 35)]
    got = passages.dedup_passages(docs(spark, rows), passages.digest, passages.DIGEST).collect()
    assert Counter(map(tuple, got)) == Counter(brute_passages(rows))
    assert passages.dedup_passages(docs(spark, rows).where("false"), passages.digest, passages.DIGEST).count() == 0


def words_of(texts):
    return passages.Words([t.encode() for t in texts], 35, 16)


def confirmed_in(words):
    keys, n, _ = blocks.distinct(words.windows()[words.whole])
    return keys[n >= 2]


def test_occurrences_come_from_the_automaton(monkeypatch):
    rng = random.Random(5)
    text = [f"w{rng.randrange(3000)}" for _ in range(300)]
    parts = [text, text[40:140], ["x"] + text[100:134], text[10:60] + text[200:260], ["y"] * 36]
    w = words_of([" ".join(p) for p in parts])
    got = passages.locate(w, confirmed_in(w))
    brute = brute_passages(list(enumerate(" ".join(p) for p in parts)))
    assert [0 if c is None else int(c.sum()) for c in got] == [n for _, _, n, _ in brute]
    # without what the automaton finds, nothing is covered
    monkeypatch.setattr(passages.Passages, "covered", lambda self, a, b: None)
    assert passages.locate(w, confirmed_in(w)) == [None] * 5


def test_many_passages_with_one_anchor():
    rng = random.Random(6)
    core = " ".join(f"core{k}" for k in range(16))
    sides = [(" ".join(f"l{k}_{j}" for j in range(12)), " ".join(f"r{k}_{j}" for j in range(12))) for k in range(40)]
    rows = [(n, f"{a} {core} {b} tail{n}") for n, (a, b) in enumerate(sides * 2)] + [(100, f"{sides[0][0]} {core} {sides[1][1]}")]
    rng.shuffle(rows)
    w = words_of([t for _, t in rows])
    assert [0 if c is None else int(c.sum()) for c in passages.locate(w, confirmed_in(w))] == [n for _, _, n, _ in brute_passages(rows)]


def test_many_different_words(monkeypatch):
    words = " ".join(f"w{k}" for k in range(399))
    w = words_of([words, words, words[:600]])
    want = passages.locate(w, confirmed_in(w))
    monkeypatch.setattr(passages, "SHIFT", 2)  # as if the words did not fit three code points
    got = passages.locate(w, confirmed_in(w))
    assert all((x == y).all() and x.sum() >= 50 for x, y in zip(want, got))


def test_one_word_many_times():
    w = words_of(["z " * 30_000, "a b c " * 5000])
    assert [int(c.sum()) for c in passages.locate(w, confirmed_in(w))] == [30_000, 15_000]
