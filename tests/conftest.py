import pytest

from airstrata.session import build


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build(master="local[4]", app="tests", shuffle_partitions=4, memory="4g", shared=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.001"
