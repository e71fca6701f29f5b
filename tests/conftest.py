import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vellichor.plans import default_session

    s = default_session("tests", os.environ.get("TEST_MASTER", "local[4]"), spark_sql_shuffle_partitions="4", spark_driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
