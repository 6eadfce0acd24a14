import pytest

from tarnql.llm import common


@pytest.fixture(autouse=True)
def nothing_remembered():
    """Each test begins as a new worker does."""
    common.forget()
