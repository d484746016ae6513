import pytest

from tidewatch.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture()
def frame(spark):
    """DataFrame from a DDL schema and rows, with row_index in list order."""

    def make(schema, rows, index=True):
        if not index:
            return spark.createDataFrame(rows, schema)
        numbered = [(i, *row) for i, row in enumerate(rows)]
        return spark.createDataFrame(numbered, f"row_index long, {schema}").coalesce(1)

    return make
