import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lineamix.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples."""
    def collect(df, *columns):
        return sorted(
            (tuple(r) for r in (df.select(*columns) if columns else df).collect()),
            key=lambda r: tuple((v is None, str(v)) for v in r),
        )
    return collect
