import pytest

from normloom.plans.session import build_session, ship


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cpus=4, driver_memory="4g")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    ship(s)
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Sorted tuples of a DataFrame."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
