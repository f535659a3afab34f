import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tapeloom.session import local_session
    from tapeloom.staging import clean

    session = local_session(4, shuffle_partitions=4, shared=f"file://{tmp_path_factory.mktemp('shared')}")
    yield session
    clean(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
