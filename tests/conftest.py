import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from labelweave.session import get_session
    s = get_session("local[*]", shuffle_partitions=8)
    if not s.conf.get("spark.checkpoint.dir", None):      # tests only: a local scratch folder
        d = tempfile.mkdtemp(prefix="lw-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="lw-test-")
