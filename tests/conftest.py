import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from loomgraph.session import local_session

    return local_session(4, 4, **{"spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
