import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_session

    s = get_session("local[*]", shuffle_partitions=8, app="quarry-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Rows of ``df`` as sorted tuples (optionally of the given columns)."""
    sel = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in sel.collect())
