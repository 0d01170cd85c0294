import datetime
import random

import pytest
from pyspark.sql import functions as F

from cytoquilt.llm import decontaminate as D


def plain(item, text):
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        cur = [i]
        for j, b in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return min(prev)


def edit(rng, text, n):
    s = list(text)
    for _ in range(n):
        i = rng.randrange(len(s))
        rng.choice([lambda: s.pop(i), lambda: s.insert(i, rng.choice("abc ")), lambda: s.__setitem__(i, rng.choice("xyz"))])()
    return "".join(s)


def test_distance_is_exact():
    rng = random.Random(3)
    for _ in range(60):
        item = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 60))) + edit(rng, item, rng.randrange(0, 6) if len(item) > 8 else 0) + "".join(rng.choice("abcd") for _ in range(30))
        assert D.Myers(item).search(text)[0] == min(plain(item, text), len(item))


def test_equals_brute_force():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa", "mu"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(25)]
    matcher = D.Matcher(items, D.RATE)
    for _ in range(80):
        k, item = rng.choice(items)
        text = " ".join(rng.choice(words) for _ in range(20)) + ". " + edit(rng, item, rng.randrange(0, 10) if len(item) > 40 else 0).upper() + "\n" + " ".join(rng.choice(words) for _ in range(10))
        want = {}
        for i, t in items:
            n = D.normal(t)
            d = plain(n, D.normal(text))
            if d <= int(D.RATE * (len(n) - 2)):
                want[i] = d
        assert {i: d for i, d, _, _ in matcher.find(text)} == want


def test_table(spark):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog today"), (2, None), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 50 + "the QUICK brown fox jumps, over the lazy dog today!", "a"), (2, None, "a"), (3, "", "a"), (4, "nothing here", "a"), (1, "the quick brown fox jumpz over the lazy dog today", "a")], "doc_id long, text string, distance string")
    out = D.find_leaks(docs, items).select("doc_id", "item_id", "distance").collect()
    assert sorted(map(tuple, out)) == [(1, 1, 0), (1, 1, 1)]
    assert D.find_leaks(docs.where("false"), items).count() == 0
    assert D.find_leaks(docs, items.where("false")).count() == 0


@pytest.mark.parametrize("passes", [False, True])
def test_kinds_of_ids_and_clashing_names(spark, monkeypatch, passes):
    if passes:
        monkeypatch.setattr(D, "PASS_CHARS", 60)
    item, other = "The quick brown fox jumps over the lazy dog today", "Which river of the world is the longest one, and why is it"
    text = "x y z " * 170_000 + item.upper() + " end"
    for kind, ids in (("int", (1, 2, 1, None)), ("string", ("a", "b", "a", None)), ("double", (0.5, 1.5, 0.5, None)), ("date", (datetime.date(2020, 1, 1), datetime.date(2020, 1, 2), datetime.date(2020, 1, 1), None))):
        items = spark.createDataFrame([(ids[0], item), (ids[1], other), (ids[2], item), (ids[3], other.upper()), (None, None)], f"item_id {kind}, text string")
        docs = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (None, other + "!", "c"), (3, "", "d")], "distance int, text string, __raw string").withColumn("raw", F.lit(1))
        got = D.find_leaks(docs, items, id_col="distance")
        assert got.columns == ["distance", "item_id", "_distance", "end", "stretch"]
        want = [(1, ids[0], 0), (1, ids[2], 0), (None, ids[1], 0), (None, None, 0)]
        assert sorted(map(str, want)) == sorted(str((r[0], r[1], r[2])) for r in got.collect())
        kept = D.without_leaks(docs, items)
        assert kept.columns == docs.columns and sorted(r["__raw"] for r in kept.collect()) == ["b", "d"]
    same = D.find_leaks(docs.withColumnRenamed("distance", "id"), items.withColumnRenamed("item_id", "id"), id_col="id", item_id="id")
    assert same.columns == ["id", "_id", "distance", "end", "stretch"] and same.count() == 4


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa", "mu"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 20)))) for i in range(12)] + [(20, None), (21, ""), (22, "..."), (3, "theta mu eta iota kappa delta beta alpha mu mu")]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(30))
        if i % 3:
            text = text[:70] + " " + edit(rng, rng.choice(items[:12])[1], rng.randrange(0, 9)) + " " + text[70:]
        docs.append((i, text))
    docs += [(60, None), (61, ""), docs[1]]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = []
    for i, text in docs:
        for k, item in items:
            n = D.normal(item or "")
            d = plain(n, D.normal(text or "")) if n else None
            if n and D.normal(text or "") and d <= int(D.RATE * (len(n) - 2)):
                want.append((i, k, d))
    assert len(want) > 20 and sorted(want) == sorted(map(tuple, D.op1_decontaminate(spark, str(tmp_path)).collect()))
