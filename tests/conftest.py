import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panescan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "panescan-tests")


@pytest.fixture(autouse=True)
def eight_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
