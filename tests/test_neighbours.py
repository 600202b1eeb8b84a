"""The search for the nearest rows in strips, against all distances."""

import numpy as np
import pytest

from sightline.operators import vectors as ve


@pytest.mark.parametrize("size", [1.0, 1e-9, 1e20])
@pytest.mark.parametrize("rows", [3, 64, 300])
def test_strips_find_what_all_distances_tell(monkeypatch, size, rows):
    monkeypatch.setattr(ve, "QUERIES", 7)
    monkeypatch.setattr(ve, "STRIP_ROWS", 128)
    monkeypatch.setattr(ve, "EXACT_PAIRS", 128)
    r = np.random.default_rng(rows)
    e = r.normal(size=(rows, 5)) * size
    e[rows // 2 :: 3] = e[0]  # equal rows
    own = np.array([f"s{k // 4}" for k in range(rows)])
    q, q_own = np.concatenate([e[::5], r.normal(size=(20, 5)) * size]), np.append(own[::5], ["s0"] * 20)
    i, j, v = ve._neighbours(e, own, 3)(q, q_own)
    square = np.einsum("ij,ij->i", e, e)
    want = []
    for a in range(len(q)):
        d = [(round(float(np.sqrt(max(0.0, np.einsum("i,i", q[a], q[a]) + square[b] - 2 * np.einsum("i,i", q[a], e[b])))), 9), b) for b in range(rows) if own[b] != q_own[a]]
        want += [(a, b, x) for x, b in sorted(d)[:3]]
    assert i.tolist() == [x[0] for x in want] and v == pytest.approx([x[2] for x in want], abs=2e-9 if size <= 1 else 1e-7 * size, rel=1e-7)
    if size <= 1:
        assert j.tolist() == [x[1] for x in want]
