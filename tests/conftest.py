import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.dirname(os.path.abspath(__file__))):
    if p not in sys.path:
        sys.path.insert(0, p)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from meterlens.session import local_session

    session = local_session("*", shuffle_partitions=8, app="meterlens-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck01():
    from compare import duck

    return duck(SF01)
