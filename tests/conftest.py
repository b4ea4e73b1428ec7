import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from corpusforge.session import get_session
    s = get_session(master="local[4]", cpus=4, extra={"spark.sql.shuffle.partitions": "8"})
    yield s
