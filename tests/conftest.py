import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from reqlens.session import get_session
    s = get_session("local[4]", app="reqlens-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from reqlens.sources.fixtures import Fixtures
    return Fixtures(spark, SF_SMALL)


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
