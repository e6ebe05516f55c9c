import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vigipanel.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests")


@pytest.fixture(scope="session")
def areas(spark):
    rows = [("3300100", "Angra dos Reis"), ("3300159", "Aperibé"), ("3304904", "São Gonçalo")]
    return spark.createDataFrame(rows, "code string, name string")
