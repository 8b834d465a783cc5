import pytest

from barline.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "barline-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
