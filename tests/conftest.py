import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from hazecast.session import get_spark
    s = get_spark("local[8]", 4)
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
