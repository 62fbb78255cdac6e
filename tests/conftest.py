import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from bastion.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="bastion-tests")
    yield s


def rows(df, *cols):
    """Collect selected columns as a list of tuples (test helper; fixtures are tiny)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
