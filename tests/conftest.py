import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shapelab.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = builder("local[4]", 4).config("spark.driver.memory", "3g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
