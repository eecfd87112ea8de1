import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from textloom.session import local_session

    s = local_session("tests", cpus=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
