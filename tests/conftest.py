import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidewell.session import local_session

    return local_session(8, "tests", **{"spark.driver.memory": "6g"})


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("TIDEWELL_TEST_DATA", "/root/testdata/sf0.01")
