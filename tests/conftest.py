import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from plantpulse.session import local_session

    s = local_session("*", shuffle_partitions=8, app="plantpulse-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def samples(tmp_path_factory):
    from tests.samples import write_samples

    return write_samples(str(tmp_path_factory.mktemp("samples")))
