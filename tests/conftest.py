import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from recordlab.session import local_session

    return local_session("8", "tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def sf():
    return SF
