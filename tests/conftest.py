import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", shuffle_partitions=8, driver_memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vectors(spark):
    """40 vectors of 8 small integers, with repeats and one zero vector."""
    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, size=(40, 8)).astype(float)
    m[7] = m[21] = m[22]
    m[5] = 0.0
    rows = [(i, [float(x) for x in m[i]], i % 3) for i in range(40)]
    return m, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
