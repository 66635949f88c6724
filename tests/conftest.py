import pytest

from fleetbooks.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
