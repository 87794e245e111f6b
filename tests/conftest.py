import pytest

from placelab.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8", partitions=4)
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate one column expression over text values."""

    def run(texts, expression):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
        return [row.v for row in df.select("i", expression(df.x).alias("v")).orderBy("i").collect()]

    return run


@pytest.fixture
def hot_paths(monkeypatch):
    """Limits so low that small data takes the paths of skewed data."""
    from placelab.operators import grid, skew

    monkeypatch.setattr(skew, "HOT_ROWS", 4)
    monkeypatch.setattr(grid, "PAIR_LIMIT", 9)
