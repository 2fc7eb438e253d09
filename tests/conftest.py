import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from dnsflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoints")
    session = local_session(4, shuffle_partitions=4, spark__checkpoint__dir=str(folder))
    session.sparkContext.setLogLevel("ERROR")
    return session
