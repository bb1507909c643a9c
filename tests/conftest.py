import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from veloscore.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="veloscore-tests")
    yield s
    s.stop()


@pytest.fixture()
def write_text(tmp_path):
    """Write a text file under the test's own tmp dir and return its path."""
    def _write(name, text):
        p = tmp_path / name
        p.write_text(text)
        return str(p)
    return _write
