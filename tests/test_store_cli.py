import json

import pytest

from cytoquilt import cli
from cytoquilt.model import AnnMatrix
from cytoquilt.plans import convert, pipeline, querybench
from cytoquilt.sources.config import AppConfig, from_dict, load_config, override
from cytoquilt.sources.inputs import from_csr, read_any
from cytoquilt.sources.store import Store, StoreError, matrix, open_x, write_back


def six(spark):
    """Six labelled cells in the order B, A, A, B, A, B."""
    obs = spark.createDataFrame(list(zip(range(6), "BAABAB", "yxyxxy")), "row_id long, cell_type string, demographic string")
    var = spark.createDataFrame([(i, f"g{i}") for i in range(3)], "col_id long, var_name string")
    x = spark.createDataFrame([(i, 0, i + 1.0) for i in range(6)] + [(i, 1, 10.0 * (i + 1)) for i in range(6)], "row_id long, col_id long, value double")
    coords = spark.createDataFrame([(i, [2.0 * i, 2.0 * i + 1]) for i in range(6)], "row_id long, vec array<double>")
    return AnnMatrix(obs=obs, var=var, x=x, obsm={"coords": coords}, layers={"counts": x}, uns={"note": [1, {"a": 2}]})


def cells(df):
    return sorted(tuple(r) for r in df.select("row_id", "col_id", "value").collect())


@pytest.mark.parametrize("fmt", ["csr", "csc", "dense"])
def test_round_trip(spark, tmp_path, fmt):
    ann = six(spark)
    store = Store.create(spark, f"{tmp_path}/s")
    store.write(ann, fmt, chunk=(2, 2))
    again = store.load()
    assert cells(again.x) == cells(ann.x) == cells(again.layers["counts"])
    assert again.uns == ann.uns and open_x(store.readonly())["is_sparse"] == (fmt != "dense")
    assert convert.inspect(spark, f"{tmp_path}/s")["nnz"] == 12


def test_sorted_golden(spark):
    s = six(spark).sorted(["cell_type", "demographic"])
    first = [r.value for r in s.x.where("col_id = 0").orderBy("row_id").collect()]
    assert first == [2, 5, 3, 4, 1, 6]
    assert [r.vec[0] for r in s.obsm["coords"].orderBy("row_id").collect()] == [2, 8, 4, 6, 0, 10]
    assert {r.row_id for r in six(spark).subset(cell_type="A", demographic="x").obs.collect()} == {1, 4}


def test_versions(spark, tmp_path):
    store = Store.create(spark, f"{tmp_path}/v")
    store.write(six(spark))
    with pytest.raises(StoreError):
        Store.create(spark, f"{tmp_path}/v")
    before = store.lookup("main")
    store.create_branch("dev")
    a, b = store.writable("dev"), store.writable("dev")
    a.write("layers/norm", a.read("X"), kind="matrix", format="csr", shape=[6, 3], dtype="double", chunk=[1, 1])
    a.commit("norm")
    with pytest.raises(StoreError):
        b.write("obs", b.read("obs"))
        b.commit("late")
    assert store.lookup("main") == before and not store.readonly().exists("layers/norm")
    assert store.readonly("dev").nodes["X"] == store.readonly().nodes["X"]
    store.reset_branch("main", store.lookup("dev"))
    assert [s["message"] for s in store.ancestry()] == ["norm", "write", "created"]
    with pytest.raises(StoreError):
        store.readonly().write("x", b.read("obs"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "node long, community int")
    xy = spark.createDataFrame([(i, 1.0, 2.0) for i in range(6)], "node long, x double, y double")
    for _ in range(2):
        write_back(store, xy, labels)
    assert store.load().obs.columns.count("leiden") == 1 and store.load().obsm["X_umap"].count() == 6


def test_concat_and_cli(spark, tmp_path, capsys):
    for n in "ab":
        Store.create(spark, f"{tmp_path}/{n}").write(six(spark))
    assert cli.main(["concat-h5ads", "--inputs", f"{tmp_path}/a", f"{tmp_path}/b", "--output", f"{tmp_path}/c", "--obs-columns", "cell_type"], spark) == 0
    got = Store.open(spark, f"{tmp_path}/c").load()
    assert got.obs.columns == ["row_id", "cell_type"] and got.obs.count() == 12
    want = cells(six(spark).x)
    assert cells(got.x) == sorted(want + [(r + 6, c, v) for r, c, v in want])
    assert cli.main(["convert-h5ad", "--input", f"{tmp_path}/a", "--output", f"{tmp_path}/d", "--sort-by", "cell_type"], spark) == 0
    assert [r.cell_type for r in Store.open(spark, f"{tmp_path}/d").load().obs.orderBy("row_id").collect()] == list("AAABBB")
    assert cli.main(["convert-h5ad", "--input", f"{tmp_path}/none", "--output", f"{tmp_path}/e"], spark) == 1
    assert cli.main(["concat-h5ads", "--inputs", f"{tmp_path}/a", f"{tmp_path}/b", "--output", f"{tmp_path}/f", "--obs-columns", "gone"], spark) == 1
    capsys.readouterr()
    for k in range(2):
        assert cli.main(["bench", "--store", f"{tmp_path}/d", "--mode", "celltype", "--obs-column", "cell_type", "--obs-value", "B", "--repeats", "2", "--json"], spark) == 0
        (tmp_path / f"r{k}.json").write_text(capsys.readouterr().out)
    r = json.loads((tmp_path / "r0.json").read_text())
    assert (r["n_selected"], r["n_runs"], r["nnz"]) == (3, 1, 6)
    assert cli.main(["compare", f"{tmp_path}/r*.json", "--md"], spark) == 0 and capsys.readouterr().out.count("\n") == 4
    with pytest.raises(ValueError):
        querybench.run(spark, f"{tmp_path}/d", "col", "celltype", obs_column="cell_type", obs_value="B")


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('[io]\nx_storage = "DENSE"\n[chunks]\nx_row_chunk = 10\n')
    cfg = load_config(f"{tmp_path}/c.toml")
    assert cfg.io.x_storage == "dense" and cfg.chunks.x_row_chunk == 10
    assert override(cfg, sort_by=["a"]).grouping.enabled
    for bad in ({"nope": {}}, {"io": {"x": 1}}, {"io": {"x_storage": "odd"}}, {"chunks": {"cpus": 0}}, {"grouping": {"enabled": True}}):
        with pytest.raises(ValueError):
            from_dict(bad)
    assert AppConfig().io.x_storage == "sparse-csr"


def test_10x_layout(spark):
    ann = from_csr(spark, [0, 2, 3], [0, 2, 1], [1, 3, 2], ["CELL1-1", "CELL2-1"], [{"var_name": n} for n in "abc"])
    assert cells(ann.x) == [(0, 0, 1.0), (0, 2, 3.0), (1, 1, 2.0)]
    with pytest.raises(RuntimeError):
        read_any(spark, "/nowhere/x.h5")


def test_pipeline(spark, tmp_path, sf_dir):
    from cytoquilt.plans import binding

    obs = binding.obs(spark, sf_dir).where("row_id < 200")
    x = binding.counts(spark, sf_dir).where("row_id < 200")
    store = Store.create(spark, f"{tmp_path}/p")
    store.write(AnnMatrix(obs=obs, var=binding.var(spark, sf_dir), x=x))
    out = pipeline.run(spark, pipeline.Settings(data_path=f"{tmp_path}/p", n_top_genes=40, n_comps=5, n_neighbors=8, neighbors_algorithm="brute", batch_key="batch"))
    assert [s for s, _ in out["steps"]] == ["load", "normalize", "hvg", "pca", "harmony", "neighbors", "umap", "leiden", "write"]
    assert "leiden" in store.load().obs.columns and matrix(store.readonly()).count() == x.count()
