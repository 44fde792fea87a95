import pytest

from quillspan.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, "4g", partitions=2)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
