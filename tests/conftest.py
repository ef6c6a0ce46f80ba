import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from stallmark.session import local_session

    return local_session(cores=4, partitions=4, memory="4g")
