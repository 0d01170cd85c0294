import pytest
from oracle import same

from cytoquilt import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf_dir, name):
    same(spark, QUERIES[name], ORACLE[name], sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_imports_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['cytoquilt.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'csr_rows' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
