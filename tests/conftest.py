import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from wardstats.functions.session import local_session

    s = local_session(cpus=4, shuffle_partitions=8, app="wardstats-tests")
    yield s


def rows(df, order=None):
    """Collect as a list of dicts, ordered by ``order`` (or all columns)."""
    out = [r.asDict() for r in df.collect()]
    key = order or df.columns
    return sorted(out, key=lambda d: tuple(repr(d[k]) for k in key))
