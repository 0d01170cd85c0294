import pytest

from cytoquilt import api
from cytoquilt.model import AnnMatrix
from cytoquilt.plans import binding, multiuser
from cytoquilt.sources.store import Store, matrix


def test_flow_and_second_run(spark, tmp_path, sf_dir):
    store = Store.create(spark, f"{tmp_path}/s")
    ann = AnnMatrix(obs=binding.obs(spark, sf_dir).where("row_id < 300"), var=binding.var(spark, sf_dir), x=binding.counts(spark, sf_dir).where("row_id < 300"))
    first = multiuser.ingest(store, ann)
    raw = store.readonly().node("X")["dir"]
    assert multiuser.add_normalized(store, "user1") and multiuser.analyse(store, "user2", "cell_type", "1-URGENT", 30, 4, 6)
    now = store.readonly()
    assert now.node("X")["dir"] == raw and matrix(now, "layers/norm").count() == ann.x.count()
    assert now.read("analyses/1-URGENT/obs").count() == ann.obs.where("cell_type = '1-URGENT'").count()
    assert now.read("analyses/1-URGENT/var").where("highly_variable").count() == 30
    assert [h.split(" ", 1)[1] for h in multiuser.history(store)] == ["user2: cell_type = 1-URGENT", "user1: normalised layer", "ingest raw counts", "created"]
    assert multiuser.ingest(store, ann) is multiuser.add_normalized(store, "user1") is multiuser.analyse(store, "user2", "cell_type", "1-URGENT") is None
    assert not store.readonly(snapshot=first).exists("layers/norm")


def test_api(spark, tmp_path):
    assert api.health() == {"status": "ok"}
    with pytest.raises(FileNotFoundError):
        api.convert_h5ad(f"{tmp_path}/none", f"{tmp_path}/out", spark=spark)
