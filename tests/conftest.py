import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from waymill.session import build_session

    session = build_session("local[4]", shuffle_partitions=4, memory="3g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test tables here")
    return str(path)
