import pytest


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
