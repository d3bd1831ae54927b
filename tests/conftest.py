import pytest

from tidewire.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tidewire-tests", "8g")
    yield session
    session.stop()
