import pathlib
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def points(spark):
    """Turn a matrix into ``(id, features)``."""

    def build(matrix, partitions=4):
        rows = [(i, [float(x) for x in row]) for i, row in enumerate(np.asarray(matrix))]
        return spark.createDataFrame(rows, "id long, features array<double>").repartition(partitions)

    return build


@pytest.fixture(scope="session")
def wide(spark):
    """Turn a matrix into ``(id, x0, x1, ..)``."""

    def build(matrix):
        frame = pd.DataFrame(matrix, columns=[f"x{i}" for i in range(matrix.shape[1])])
        frame.insert(0, "id", np.arange(len(frame)))
        return spark.createDataFrame(frame)

    return build


def subspace(n, d, q, noise, seed):
    """Points near a q-dimensional linear subspace."""
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(d, q)))[0]
    return rng.normal(size=(n, q)) @ basis.T + noise * rng.normal(size=(n, d))
