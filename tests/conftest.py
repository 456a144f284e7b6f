import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from licensum.session import local_session  # noqa: E402


# Started before collection, because column expressions in parametrisations need a session.
SESSION = local_session("8", partitions=4)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture
def one():
    """Value of a column expression over a single value ``c``."""

    def run(expr, value, kind="string"):
        df = SESSION.createDataFrame([(value,)], f"c {kind}")
        return df.select(expr.alias("x")).first().x

    return run
