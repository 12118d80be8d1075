import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from socspan.session import local_session

    s = local_session(cpus=8, memory="6g", partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
