import os

import pytest

os.environ.setdefault("PYTHONDONTWRITEBYTECODE", "1")


@pytest.fixture(scope="session")
def spark():
    from weftlens.session import build_session

    session = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    """The smallest driver tables, where they are there."""
    base = os.environ.get("WEFTLENS_TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    return base
