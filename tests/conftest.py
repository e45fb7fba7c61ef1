import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from verifolio.session import local_session, ship  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, partitions=4)
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
