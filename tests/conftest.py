import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from runledger.session import local_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(
        "tests",
        "8",
        **{
            "spark.checkpoint.dir": str(shared),
            # Plans are compared as text, so nothing in them may be cut.
            "spark.sql.maxMetadataStringLength": "10000",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples, NULLs first."""

    def sort_key(row):
        return [(value is not None, str(value)) for value in row]

    return lambda df: sorted((tuple(r) for r in df.collect()), key=sort_key)
