import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH", "")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scriptloom.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, "3g", spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__sql__shuffle__partitions="4")
    yield session
    session.stop()
