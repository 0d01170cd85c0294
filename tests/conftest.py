import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cytoquilt.session import build_session

    session = build_session("tests", spark__driver__host="127.0.0.1", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("wh")), spark__checkpoint__dir=str(tmp_path_factory.mktemp("ck")))
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
