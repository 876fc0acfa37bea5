import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidemart.session import build_session
    # spark.checkpoint.dir comes from the environment's defaults when set;
    # tidemart.session.checkpoint_dir() creates one only when it is unset
    s = build_session("local[4]", app="tidemart-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL
