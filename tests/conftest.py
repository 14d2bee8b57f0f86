import pytest

from alertloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("alertloom-tests", cores=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
