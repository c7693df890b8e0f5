import pytest

from tests.support import make_session


@pytest.fixture(scope="session")
def spark():
    return make_session()
