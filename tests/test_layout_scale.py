import numpy as np
import pytest

from cytoquilt.operators import layout as L
from cytoquilt.plans import ingest, layouts


def trip(spark, rows):
    return spark.createDataFrame(rows, "row_id long, col_id long, value double")


def test_full_tiles_take_one_pass(spark):
    """A tile of 90,000 entries; each place was searched for in all of them before."""
    x = spark.range(90_000).selectExpr("id div 300 as row_id", "id % 300 as col_id", "cast(id as double) as value")
    (r,) = L.tiles(x, 300, 300, 300, 300).collect()
    assert r.nnz == 90_000 and r["values"] == list(map(float, range(90_000)))


def test_repeated_places_are_an_error(spark):
    for make in (L.tiles, L.tiles_text):
        with pytest.raises(Exception, match="two values at one place"):
            make(trip(spark, [(0, 1, 3.0), (0, 1, 4.0)]), 2, 2, 2, 2).collect()


def test_tiles_are_dealt_by_their_cells(spark, monkeypatch):
    """Few entries in a large grid: its text is written by many tasks, whatever is shuffled before."""
    monkeypatch.setattr(L, "TASK_CELLS", 10_000)
    x = trip(spark, [(0, 0, 3.0), (299, 399, 5.0), (299, 399 - 64, 7.0)])
    for make, (rc, cc) in ((lambda: ingest._concat_dense(x, 300, 400), (50, 64)), (lambda: layouts._densify(x, 300, 400), layouts.TILE)):
        assert make().rdd.getNumPartitions() == 12
        got = {(r.row_block, r.col_block): r["values"] for r in make().collect()}
        assert len(got) == -(-300 // rc) * -(-400 // cc) and sum(len(v.split(",")) for v in got.values()) == 300 * 400
        assert got[0, 0].startswith("3,0,0") and got[299 // rc, 399 // cc].endswith(",0,5")


def test_to_csr_of_a_very_wide_matrix(spark):
    """Only slices that hold something are made dense: a row of a thousand million columns would not fit."""
    x = trip(spark, [(0, 5, 2.0), (0, 63, 0.0), (0, 64, 1.0), (7, 999_999_999, 4.0), (9, 3, 0.0)])
    assert sorted(tuple(r) for r in layouts._to_csr(x, 10**9).collect()) == [(0, "5,64", "2,1"), (7, "999999999", "4")]


def test_dense_rows_are_dealt_by_their_cells(spark, monkeypatch):
    monkeypatch.setattr(L, "TASK_CELLS", 10_000)
    dense = np.zeros((40, 1000), int)
    dense[3, [0, 7, 999]], dense[5, 500] = [4, 5, 6], 1
    packed = L.compressed(trip(spark, [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]))
    rows = L.dense_rows_text(packed, 40, 1000)
    assert rows.rdd.getNumPartitions() == 4
    assert {r.row_id: r["values"] for r in rows.collect()} == {i: ",".join(map(str, dense[i])) for i in (3, 5)}
    assert {r.row_id: r["values"] for r in L.dense_rows(packed, 3, 6).collect()} == {3: [0.0, 5.0, 0.0], 5: [0.0] * 3}
    assert [r["values"] for r in L.dense_rows_text(packed, 40, 0).collect()] == ["", ""]  # no columns: no values
