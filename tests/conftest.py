import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpusmill.session import drop_scratch, ensure_checkpoint_dir, local_session
    s = local_session(4, shuffle_partitions=4, driver_memory="4g")
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="corpusmill-tests-"))
    yield s
    drop_scratch(s)
