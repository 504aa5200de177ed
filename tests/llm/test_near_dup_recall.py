"""Share of near pairs that meet in a bucket, by length, similarity and place of the edits."""

from __future__ import annotations

import numpy as np
import pytest

from forecourt.llm import near_dup


def _pair(rng, n: int, changed: int, clustered: bool):
    a = near_dup.mix(rng.integers(0, 1 << 63, n).astype(np.uint64))
    b = a.copy()
    at = np.arange(changed) + rng.integers(0, n - changed + 1) if clustered else rng.choice(n, changed, replace=False)
    b[at] = near_dup.mix(rng.integers(0, 1 << 63, changed).astype(np.uint64))
    return a, b


def _keys(words) -> set:
    return set(near_dup.sketch(near_dup.shingles(words)).tolist()) | set(near_dup.short_keys(words).tolist())


@pytest.mark.parametrize("clustered", [False, True])
@pytest.mark.parametrize("least", [0.80, 0.82, 0.85])
@pytest.mark.parametrize("n", [10, 17, 18, 20, 25, 30, 40, 60, 150, 400])
def test_pairs_of_each_band_meet(n, least, clustered):
    changed = int(n * (1 - least) / (1 + least) + 1e-9)
    if not changed:
        return
    rng, met = np.random.default_rng(n), 0
    for _ in range(200):
        a, b = _pair(rng, n, changed, clustered)
        assert near_dup.aligned_similarity((a >> np.uint64(32)).astype("<u4"), (b >> np.uint64(32)).astype("<u4")) >= least - 1e-9
        met += bool(_keys(a) & _keys(b))
    assert met >= 0.9 * 200, met / 200
