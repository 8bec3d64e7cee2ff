import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lodgetier.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session("tests", "local[8]", 8)
    made.sparkContext.setLogLevel("ERROR")
    yield made


SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF_SMALL
