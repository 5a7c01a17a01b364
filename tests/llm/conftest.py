import pytest
from llm_cases import ODD_TEXTS, frame


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD_TEXTS)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)
