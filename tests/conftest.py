import os
import sys
from pathlib import Path

import pytest

HERE = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = ":".join(filter(None, (HERE, os.environ.get("PYTHONPATH"))))


@pytest.fixture(scope="session")
def spark():
    from loopweave.session import local_session

    session = local_session(cores=4, partitions=2, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
