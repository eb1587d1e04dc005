import pytest

from treespark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "treespark-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
