from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from flatcel.session import local_session, ship_package

    session = local_session("tests")
    ship_package(session)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
