import pytest


@pytest.fixture(scope="session")
def data() -> str:
    return "/root/testdata/sf0.001"
