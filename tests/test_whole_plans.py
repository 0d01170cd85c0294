import numpy as np
import pandas as pd
import pytest

from cytoquilt.operators import select as S
from cytoquilt.plans import ingest, layouts, selection

N, G = 620, 230


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """(folder, dense matrix, statuses) of tables wider and longer than the corners; some cells hold nothing."""
    d, rng = tmp_path_factory.mktemp("small"), np.random.default_rng(3)
    rows, cols = rng.integers(0, N - 5, 4000), rng.integers(0, G, 4000)
    amount = rng.integers(1, 9, 4000).astype(float)
    x = np.zeros((N, G), int)
    np.add.at(x, (rows, cols), amount.astype(int))
    status = rng.choice(list("FOP"), N)
    pd.DataFrame({"l_orderkey": rows, "l_partkey": cols, "l_quantity": amount}).to_parquet(d / "lineitem.parquet")
    pd.DataFrame({"o_orderkey": np.arange(N), "o_orderpriority": "1-URGENT", "o_orderstatus": status, "o_totalprice": 1.0, "o_custkey": 1}).to_parquet(d / "orders.parquet")
    pd.DataFrame({"p_partkey": np.arange(G), "p_name": [f"g{i}" for i in range(G)], "p_brand": "b", "p_type": "t"}).to_parquet(d / "part.parquet")
    return str(d), x, status


def tiled(rows, x, rc, cc):
    got = {(r.row_block, r.col_block): (r.n_rows, r.n_cols, r["values"]) for r in rows}
    want = {}
    for i in range(-(-x.shape[0] // rc)):
        for j in range(-(-x.shape[1] // cc)):
            t = x[i * rc : (i + 1) * rc, j * cc : (j + 1) * cc]
            want[i, j] = (*t.shape, ",".join(map(str, t.ravel())))
    assert got == want and len(rows) == len(want)


def test_whole_layouts(spark, small):
    d, x, _ = small
    rows = layouts.densify_whole(spark, d).collect()
    tiled(rows, x, *layouts.TILE)
    assert sum(r.nnz for r in rows) == (x > 0).sum()
    assert {r.row_id: r["values"] for r in layouts.to_dense_whole(spark, d).collect()} == {i: ",".join(map(str, v)) for i, v in enumerate(x)}
    csr = {r.row_id: (r.indices, r.data) for r in layouts.to_csr_whole(spark, d).collect()}
    assert csr == {i: (",".join(map(str, np.flatnonzero(v))), ",".join(map(str, v[v > 0]))) for i, v in enumerate(x) if v.any()}


def test_whole_concatenation(spark, small):
    d, x, status = small
    tiled(ingest.concat_dense_whole(spark, d).collect(), np.concatenate([x[status == s] for s in ingest.FILES]), 50, 64)


def test_random_ids_of_all_rows(spark, small):
    d, x, _ = small
    for query, key, y, count in ((selection.select_rows_rand_whole, "row_id", x, selection.COUNT), (selection.select_cols_rand_whole, "col_id", x.T, 50)):
        chosen = S.random_ids(len(y), count, selection.SEED)
        got = query(spark, d).collect()
        assert {r[key] for r in got} == {i for i in chosen if y[i].any()} and sum(r["value"] for r in got) == y[chosen].sum()
