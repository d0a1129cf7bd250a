"""Kernels take a bounded share of a batch at once."""

import numpy as np
import pandas as pd

from voxelloom import layouts


def test_batches_are_cut_by_bytes():
    rows = pd.DataFrame({"volume_id": [f"v{i}" for i in range(1000)], "z": range(1000), "data": [bytes(2048)] * 999 + [bytes(1 << 21)]})
    found = list(layouts.small_batches(iter([rows, rows[:0], rows[:1]]), 1 << 18))
    assert [z for part in found for z in part["z"]] == [*range(1000), 0]
    assert all(len(part) == 1 or part["data"].str.len().sum() <= 1 << 18 for part in found)
    pieces = pd.DataFrame({"parts": [[{"piece": bytes(1 << 17), "part": 0}] * 2] * 3})
    assert [len(part) for part in layouts.small_batches(iter([pieces]), 1 << 18)] == [1, 1, 1]


def test_counting_does_not_hold_a_whole_batch(spark, stack):
    """A batch of 3,000 slices comes back in many answers, each of a share of the slices."""
    volume = np.random.default_rng(1).integers(0, 256, (3000, 16, 64)).astype(np.uint8)
    rows = pd.DataFrame([("a", z, 16, 64, "uint8", image.tobytes()) for z, image in enumerate(volume)], columns=["volume_id", "z", "h", "w", "dtype", "data"])
    answers = []

    class Slices:
        def select(self, *_):
            return self

        def mapInPandas(self, kernel, _):
            answers.extend(kernel(iter([rows])))

    layouts.slices_to_hist(Slices())
    assert len(answers) > 4 and max(part["z"].nunique() for part in answers) <= layouts.PART_BYTES // 1024
    counted = pd.concat(answers).groupby("z")["n"].sum()
    assert (counted == 1024).all() and len(counted) == 3000
