import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from dnsglass.session import get_session
    s = get_session(master="local[*]", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="dnsglass-test-ckpt-")})
    yield s


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.001"


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="dnsglass-test-")
