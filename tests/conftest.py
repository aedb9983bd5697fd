import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from threadloom.session import get_session

    session = get_session(cores="4", shuffle_partitions=3, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
