import pytest

from docloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, shuffle_partitions=4, memory="4g")
