import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_spark

    session = get_spark("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
