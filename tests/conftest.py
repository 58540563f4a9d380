import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from inkwarden.session import ensure_workers, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8", memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    ensure_workers(session)
    yield session
    session.stop()
