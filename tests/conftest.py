import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
# Spark's Python workers must find the package too, wherever the tests are started.
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)


@pytest.fixture(scope="session")
def spark():
    from sweepmill.session import local_session

    session = local_session(partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
