import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from reviewlab.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        master="local[4]",
        **{
            "spark.sql.shuffle.partitions": 4,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def points(spark):
    """Labelled random vectors in three datasets, one of them with a third class and with many exact copies."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows, at = [], 0
    for dataset, counts in {"base": (60, 0, 50), "one": (25, 0, 30), "two": (30, 22, 40)}.items():
        for label, n in zip(("Negatief", "Neutraal", "Positief"), counts):
            for _ in range(n):
                vector = rng.normal(size=6).round(3) + (label == "Positief")
                if dataset == "two" and at % 3 == 0:
                    vector = np.full(6, 0.5)
                rows.append((dataset, at, label, [float(v) for v in vector]))
                at += 1
    schema = "dataset string, row_id bigint, label string, embedding array<float>"
    return spark.createDataFrame(rows, schema).cache()
