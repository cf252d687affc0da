"""Nearest neighbours: repeated ids with equal vectors, and long vectors."""

import numpy as np
import pytest

from assayer.llm import ann


def search(q_id, q, ids, x, k):
    """search_block with codes and errors as nearest() makes them: {query index: [(id, score)]}."""
    unit = ann._unit(x)
    model = ann.fit_quantizer(unit[:: max(1, len(x) // 400)])
    codes = model.encode(unit)
    error = ann.padded(unit) - model.decode(codes)
    at, found, score = ann.search_block(model, q_id, q, ids, x, codes[:, 0::2] | codes[:, 1::2] << 4, np.sqrt((error**2).sum(1) / x.shape[1]), k)
    out = {i: [] for i in range(len(q))}
    for a, i, s in zip(at, found, score):
        out[a].append((int(i), float(s)))
    return out


def brute(q_id, q, ids, x, k):
    score = ann._unit(q) @ ann._unit(x).T
    return {a: sorted(((int(i), float(s)) for i, s in zip(ids, score[a]) if i != q_id[a]), key=lambda v: (-round(v[1], 9), v[0]))[:k] for a in range(len(q))}


def same(got, want):
    return all([i for i, _ in got[a]] == [i for i, _ in want[a]] and np.allclose([s for _, s in got[a]], [s for _, s in want[a]]) for a in want)


@pytest.mark.parametrize("times", [1, 2, 4, 9, 50])
def test_ties_behind_a_repeated_query_id(times):
    rng = np.random.default_rng(3)
    one, rest = rng.normal(size=16), rng.normal(size=(60, 16))
    ids = np.array([1] * times + [2] * times + [3, 4, 5, 6, 7, 8] + list(range(100, 160)))
    x = np.vstack([*[one] * (2 * times + 6), rest])
    q_id = np.array([1, 2, 5, 999])
    q = np.stack([one] * 4)
    assert same(search(q_id, q, ids, x, 5), brute(q_id, q, ids, x, 5))


def test_sums_of_long_vectors_do_not_wrap():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2048)) + 0.2
    x[1::2] = x[::2] + 0.3 * rng.normal(size=(150, 2048))
    ids = np.arange(300)
    assert same(search(ids[:40], x[:40], ids, x, 3), brute(ids[:40], x[:40], ids, x, 3))
