import pytest

from veinwork.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("veinwork-tests", cores="4", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
