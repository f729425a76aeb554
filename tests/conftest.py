import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from scanfold.session import get_session

    s = get_session("tests", 8)
    s.sparkContext.setLogLevel("ERROR")
    return s
