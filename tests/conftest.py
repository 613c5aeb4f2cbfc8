import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from kinmark.session import ensure_package, get_spark

    session = get_spark("tests", "local[2]", 4)
    session.sparkContext.setLogLevel("ERROR")
    ensure_package(session)
    yield session
    session.stop()
