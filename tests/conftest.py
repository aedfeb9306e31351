from __future__ import annotations

import os
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def pictures():
    """Textured pictures, as those of one colour have no hash to speak of."""

    def make(seed: int, size: int = 64) -> np.ndarray:
        rng = np.random.default_rng(seed)
        y, x = np.mgrid[0:size, 0:size] / size
        planes = [np.clip(128 + 90 * np.sin(2 * np.pi * (x * rng.uniform(1, 5) + y * rng.uniform(1, 5) + rng.uniform())), 0, 255) for _ in range(3)]
        return np.stack(planes, axis=2).astype(np.uint8)

    return make
