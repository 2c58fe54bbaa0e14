import pytest
from odd_tables import documents, write


@pytest.fixture(scope="session")
def mixed(spark, tmp_path_factory):
    """Tables with nulls, odd and long texts, ties, repeated rows and columns whose names the operators use themselves."""
    return write(spark, tmp_path_factory.mktemp("mixed"), documents(), clashing=True)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])
