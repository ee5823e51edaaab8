import pytest


@pytest.fixture(scope="session")
def spark():
    from webloom.core.session import session

    s = session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
