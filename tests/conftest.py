import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.compare import session


@pytest.fixture(scope="session")
def spark():
    return session("8")
