import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tankcast.session import build_session, checkpoint_dir
    s = build_session(master="local[4]", shuffle_partitions=4)
    # tests own a fresh shared folder; on a cluster it comes from the session
    checkpoint_dir(s, tempfile.mkdtemp(prefix="tankcast-tests-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tankcast-t-", dir="/tmp")


SF = "/root/testdata/sf0.001"
