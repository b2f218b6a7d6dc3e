from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("WEBLOOM_DRIVER_MEMORY", "4g")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from webloom.session import local_session

    session = local_session("4", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
