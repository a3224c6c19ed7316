"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from plinth.session import local_session

    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """The rows of a DataFrame as a sorted list of tuples, nulls first."""

    def sort(df):
        plain = lambda v: "nan" if isinstance(v, float) and v != v else v
        return sorted((tuple(map(plain, r)) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) if not isinstance(x, (int, float)) else (True, f"{float(x):030.9f}") for x in r))

    return sort
