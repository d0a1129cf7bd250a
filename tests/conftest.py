import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voxelloom import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def stack(spark):
    """Make a slices DataFrame from {volume_id: array[z, y, x]}."""
    from voxelloom.layouts import SLICE_SCHEMA

    def make(volumes):
        rows = [
            (name, z, f"slice_{z:04d}.png", image.shape[0], image.shape[1], str(image.dtype), image.tobytes())
            for name, volume in volumes.items()
            for z, image in enumerate(volume)
        ]
        return spark.createDataFrame(rows, SLICE_SCHEMA)

    return make


@pytest.fixture(scope="session")
def volume_of():
    """Collect one volume of a slices DataFrame as an array[z, y, x]."""
    import numpy as np

    def collect(slices, volume_id):
        rows = sorted(slices.where(f"volume_id = '{volume_id}'").collect(), key=lambda r: r.z)
        return np.stack([np.frombuffer(r.data, r.dtype).reshape(r.h, r.w) for r in rows])

    return collect
