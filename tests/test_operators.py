import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytoquilt.functions.shapes import first_part, replace_first, shard_shape, slug, slug_name, strip_space
from cytoquilt.functions.types import supertype, union_relaxed
from cytoquilt.operators import benchstats as B
from cytoquilt.operators import embed as E
from cytoquilt.operators import harmonize as H
from cytoquilt.operators import ingest as I
from cytoquilt.operators import layout as L
from cytoquilt.operators import positions as P
from cytoquilt.operators import preprocess as PP
from cytoquilt.operators import select as S
from cytoquilt.sources.readers import read_selection, read_triplets

LIGHT = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def trip(spark, rows):
    return spark.createDataFrame(rows, "row_id long, col_id long, value double")


def cells(df):
    return sorted((r.row_id, r.col_id, r.value) for r in df.collect())


@LIGHT
@given(st.dictionaries(st.tuples(st.integers(0, 9), st.integers(0, 7)), st.integers(1, 50), max_size=30))
def test_layouts_agree(spark, entries):
    rows = [(r, c, float(v)) for (r, c), v in entries.items()]
    x = trip(spark, rows)
    assert cells(L.triplets(L.compressed(L.triplets(L.compressed(x, "col_id", "row_id"), "col_id", "row_id")))) == sorted(rows)
    assert cells(L.from_dense(L.dense_rows(L.compressed(x), 8))) == sorted(rows)
    t = L.tiles(x, 10, 8, 4, 3).collect()
    assert len(t) == 9 and sum(r.nnz for r in t) == len(rows) and sum(sum(r["values"]) for r in t) == sum(v for *_, v in rows)


@LIGHT
@given(st.sets(st.integers(0, 200), max_size=60), st.sampled_from([4, 7, 65536]))
def test_runs(spark, ids, block):
    want, last = [], None
    for i in sorted(ids):
        if last is not None and i == last + 1:
            want[-1][1] = i + 1
        else:
            want.append([i, i + 1])
        last = i
    keep, P.BLOCK = P.BLOCK, block
    try:
        got = P.runs(spark.createDataFrame([(i,) for i in ids], "row_id long")).collect()
    finally:
        P.BLOCK = keep
    assert sorted([r.start, r.end] for r in got) == want


def test_run_stats_goldens(spark):
    ids = lambda *v: spark.createDataFrame([(int(i),) for i in v], "row_id long")
    get = lambda df: tuple(S.run_stats(df).first())[1:3]
    assert get(ids(*range(100))) == (1, 100.0) and get(ids(0, 2, 4, 6, 8)) == (5, 1.0) and get(ids()) == (0, 0.0)
    x = trip(spark, [(i, 0, 1.0) for i in range(20)])
    spans = spark.createDataFrame([(0, 3), (7, 9)], "start long, end long")
    assert [r.row_id for r in S.read_runs(x, spans, block=2).orderBy("row_id").collect()] == [0, 1, 2, 7, 8]


@LIGHT
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 3)), max_size=40))
def test_positions_and_totals(spark, rows):
    df = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(rows)], "row_id long, k string, n long")
    got = [r.row_id for r in P.positions(df, ["k"]).orderBy("position").collect()]
    assert got == [i for _, i in sorted((k, i) for i, (k, _) in enumerate(rows))]
    totals = [r.t for r in P.running_total(df, "row_id", "n", "t", block=3).orderBy("row_id").collect()]
    assert totals == np.cumsum([n for _, n in rows]).tolist()


def test_selection_rules(spark):
    obs = spark.createDataFrame(list(zip(range(6), "BAABAB", "yxyxxy")), "row_id long, cell_type string, demographic string")
    assert {r.row_id for r in S.checked(obs, cell_type="A", demographic="x").collect()} == {1, 4}
    with pytest.raises(S.SelectionError, match="A"):
        S.checked(obs, cell_type="Z")
    with pytest.raises(S.SelectionError):
        S.matching(obs, gone=1)
    with pytest.raises(S.SelectionError):
        S.sequential(obs, "row_id", 7, 6)
    a = S.random_ids(100, 10, 0)
    assert a == S.random_ids(100, 10, 0) == sorted(set(a)) and len(a) == 10
    names = spark.createDataFrame([("x",), ("x",)], "name string")
    with pytest.raises(S.SelectionError):
        S.by_names(obs.withColumn("name", F.col("cell_type")), names)
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    pts = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (1.0, 3.0), (0.5, 1.5)], "x double, y double")
    assert [r[0] for r in pts.select(S.in_polygon(F.col("x"), F.col("y"), square)).collect()] == [True, False, False, True]
    assert pts.where(S.in_polygon(F.col("x"), F.col("y"), square[:2])).count() == 0


def test_sort_and_concat_rules(spark):
    obs = spark.createDataFrame(list(zip(range(6), "BAABAB", "yxyxxy")), "row_id long, cell_type string, demographic string")
    order = lambda **k: [r.row_id for r in I.sort_positions(obs, ["cell_type", "demographic"], **k).orderBy("position").collect()]
    assert order() == [1, 4, 2, 3, 0, 5]
    assert order(categories={"cell_type": ["B", "A"]}) == [3, 0, 5, 1, 4, 2]
    with pytest.raises(I.IngestError):
        I.sort_positions(obs, ["gone"])
    with pytest.raises(I.IngestError):
        I.sort_positions(obs.withColumn("cell_type", F.when(F.col("row_id") > 1, F.col("cell_type"))), ["cell_type"])
    var = spark.createDataFrame([(0, "g0"), (1, "g1")], "col_id long, var_name string")
    x = trip(spark, [(0, 0, 1.0)])
    with_score = lambda kind, extra: obs.withColumn("score", F.lit(1).cast(kind)).withColumn(extra, F.lit(1))
    a, b = I.Part(with_score("bigint", "ea"), var, x), I.Part(with_score("double", "eb"), var, x)
    warnings = I.check_parts([a, b], ["cell_type", "score"])
    assert len(warnings) == 3 and sum("dropped" in w for w in warnings) == 2
    out = I.concat_obs([a, b], ["cell_type", "score"])
    assert out.count() == 12 and dict(out.dtypes)["score"] == "double"
    for parts, columns, what in (([a, b], None, "schema"), ([a, b], ["gone"], "not found"), ([I.Part(a.obs, var, x, {"cell_type": ["A"]}), I.Part(b.obs, var, x, {"cell_type": ["A", "B"]})], ["cell_type"], "categorical"), ([a, I.Part(a.obs, var.where("col_id = 0"), x)], None, "var mismatch"), ([a, I.Part(a.obs, var, x.withColumn("value", F.col("value").cast("int")))], None, "dtype")):
        with pytest.raises(I.IngestError, match=what):
            I.check_parts(parts, columns)
    with pytest.raises(I.IngestError):
        I.validate(obs, var, uns={"spatial": 1})
    with pytest.raises(I.IngestError):
        I.validate(obs, var, obsm=("X_Spatial",))
    with pytest.raises(I.IngestError):
        I.validate(obs.where("false"), var)
    assert I.validate(obs, var.unionAll(var)) == ["duplicate var names"]


def test_scalar_rules(spark):
    df = spark.createDataFrame([("PBxPB-1", "\t a b \n", " a/b? "), (None, None, "??")], "a string, b string, c string")
    rows = df.select(replace_first(F.col("a"), "PB", "KT"), first_part(F.col("a"), "-"), strip_space(F.col("b")), slug(F.col("c"))).collect()
    assert tuple(rows[0]) == ("KTxPB-1", "PBxPB", "a b", "a_b") and rows[1][3] == "subset" == slug_name("??") and slug_name(" a/b? ") == "a_b"
    assert shard_shape(6, 3, 2, 2, 2) == (4, 4) and shard_shape(6, 3, 2, 2, 1) is None
    assert supertype(["bigint", "string"]) == "string" and supertype(["int", "double"]) == "double" and supertype(["void", "int"]) == "int"
    u = union_relaxed([spark.createDataFrame([(1, "x")], "a long, b string"), spark.createDataFrame([("q", 2.0)], "a string, c double")])
    assert u.columns == ["a", "b", "c"] and sorted(map(str, u.collect())) == sorted(["Row(a='1', b='x', c=None)", "Row(a='q', b=None, c=2.0)"])


def test_interval_union_goldens(spark):
    get = lambda rows: [r.length for r in B.interval_union(spark.createDataFrame([(1, *map(float, r)) for r in rows], "k int, start double, end double"), ["k"]).collect()]
    assert get([]) == [] and get([(0, 1), (2, 3)]) == [2.0] and get([(0, 2), (1, 3)]) == [3.0] and get([(0, 5), (1, 2)]) == [5.0] and get([(0, 1), (2, 3), (2.5, 6), (3, 4), (6, 7)]) == [6.0]


def test_harmonize_rules(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 0)], "k long, leaf string, n int")
    tree = spark.createDataFrame([("a", "p"), ("b", "q"), ("b", "r")], "leaf string, parent string")
    with pytest.raises(H.HarmonizeError):
        H.relabel_from_leaf(df, tree, "leaf", ["parent"])
    assert sorted(map(tuple, H.quality_report(df).collect())) == [("n", 1, 1)]
    assert H.drop_all_null(df.withColumn("z", F.lit(None))).columns == ["k", "leaf", "n"]
    assert H.tree_breaks(tree, "leaf", "parent").first().leaf == "b"


def test_variable_genes_match_dense(spark):
    rng = np.random.default_rng(0)
    dense = rng.poisson(rng.gamma(1, 2, 60), size=(80, 60)).astype(float)
    dense[5] = 0
    x = trip(spark, [(int(i), int(j), float(dense[i, j])) for i, j in zip(*dense.nonzero())])
    n = spark.createDataFrame([(80,)], "n long")
    genes = spark.createDataFrame([(i,) for i in range(60)], "col_id long")
    got = PP.variable_stats(PP.log1p(PP.normalize_total(x)), n, genes=genes).toPandas().set_index("col_id")
    t = dense.sum(axis=1)
    e = dense * (np.median(t[t > 0]) / np.where(t > 0, t, 1))[:, None]
    mean, var = e.mean(axis=0), e.var(axis=0, ddof=1)
    g = pd.DataFrame({"mean": np.log1p(np.where(mean == 0, 1e-12, mean)), "disp": np.log(np.where(var > 0, var / np.where(mean == 0, 1e-12, mean), np.nan))})
    g["bin"] = pd.cut(g["mean"], 20)
    m, s = g.groupby("bin", observed=True)["disp"].mean(), g.groupby("bin", observed=True)["disp"].std()
    one = s.isna()
    s[one], m[one] = m[one], 0
    want = (g["disp"] - m.reindex(g["bin"]).to_numpy()) / s.reindex(g["bin"]).to_numpy()
    assert np.allclose(got["norm"].reindex(range(60)), want, equal_nan=True, atol=1e-6)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(scale=4, size=(4, 8))
    rows = [(i, (centres[i % 4] + rng.normal(scale=0.5, size=8) + (i % 2) * 1.5).tolist(), f"b{i % 2}", i % 4) for i in range(160)]
    return spark.createDataFrame(rows, "row_id long, vec array<double>, batch string, kind int").repartition(3).persist()


def test_pca(blobs):
    scores, comp, share = E.pca(blobs, 3)
    x = np.array([r.vec for r in blobs.orderBy("row_id").collect()])
    y = np.array([r.scores for r in scores.orderBy("row_id").collect()])
    c = x - x.mean(axis=0)
    values = np.linalg.eigvalsh(np.cov(c.T))[::-1]
    assert np.allclose(comp.T @ comp, np.eye(3), atol=1e-8) and np.allclose(y.mean(axis=0), 0, atol=1e-8)
    assert np.allclose(y.var(axis=0, ddof=1), values[:3]) and np.allclose(share, values[:3] / values.sum())


def test_neighbours_graph_and_communities(spark, blobs):
    brute = E.knn_brute(blobs, blobs, 10).persist()
    x = {r.row_id: np.array(r.vec) for r in blobs.collect()}
    want = {i: sorted((float(np.linalg.norm(v - x[i])), j) for j, v in x.items() if j != i)[:10] for i in x}
    got = brute.groupBy("query").agg(F.sort_array(F.collect_list("neighbour")).alias("n")).collect()
    assert all(r.n == sorted(j for _, j in want[r["query"]]) for r in got)
    approx = E.knn_ivf(blobs, blobs, 10, 8, 4)
    both = brute.select("query", "neighbour").intersect(approx.select("query", "neighbour")).count()
    assert both / 1600 >= 0.9
    graph = E.connectivities(brute, 10).persist()
    flipped = graph.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight")
    assert graph.exceptAll(flipped).count() == 0 and graph.agg(F.max("weight")).first()[0] <= 1 + 1e-9
    labels = E.leiden(graph, 0.5).persist()
    quality = E.modularity(graph, labels)
    rng = np.random.default_rng(0)
    chance = E.modularity(graph, spark.createDataFrame([(i, int(rng.integers(0, 4))) for i in x], "node long, community int"))
    assert quality > 0.5 > chance + 0.3
    forced = E.leiden(graph, 0.5, limit=400)  # coarsened on executors first
    assert forced.count() == 160 and E.modularity(graph, forced) > 0.4
    xy = {r.node: np.array([r.x, r.y]) for r in E.umap(graph, epochs=100).collect()}
    near = np.mean([np.linalg.norm(xy[i] - xy[j]) for i in range(0, 40) for j in range(i + 4, 160, 16)])
    far = np.mean([np.linalg.norm(xy[i] - xy[j]) for i in range(0, 40) for j in range(i + 1, 160, 16)])
    assert len(xy) == 160 and near < far
    assert E.umap(graph, epochs=20, limit=80).count() == 160


def test_harmony_mixes_batches(blobs):
    out = E.harmony(blobs, "batch", clusters=4)
    gap = lambda df: np.linalg.norm(np.subtract(*[np.mean([r.vec for r in df.where(F.col("batch") == b).collect()], axis=0) for b in ("b0", "b1")]))
    same = blobs.where("kind in (0, 1)")
    assert out.count() == 160 and gap(out.where("kind in (0, 1)")) < gap(same)


def test_readers(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate\n% note\n3 2 3\n1 1 5\n3 2 7\n3 1 2.5\n")
    assert cells(read_triplets(spark, f"{tmp_path}/m.mtx")) == [(0, 0, 5.0), (2, 0, 2.5), (2, 1, 7.0)]
    (tmp_path / "s.json").write_text('{"store": "x", "indices": [3, 5], "barcodes": ["c3", "c5"]}')
    assert sorted(map(tuple, read_selection(spark, f"{tmp_path}/s.json").collect())) == [(3, "c3"), (5, "c5")]
