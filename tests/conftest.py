import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from resolvescope.session import local_session

    return local_session(4, "tests")


@pytest.fixture(scope="session")
def fx(spark):
    from workload.fixtures import Fixtures

    return Fixtures(spark, "/root/testdata/sf0.001")
