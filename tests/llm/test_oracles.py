import pytest
from oracle import same

from cytoquilt.llm import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf_dir, name):
    same(spark, QUERIES[name], ORACLE[name], sf_dir)


def test_registered_once():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
