import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kindred.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", app="kindred-tests", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)
