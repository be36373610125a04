"""The pruning of op3 on signatures of real sets."""

import numpy as np
import pytest

from blockloom.llm import bayes_jaccard as bj


def signatures(n, similarity, pairs=40):
    """Signatures of pairs of sets of n n-grams whose similarity is at least that given."""
    rng, left, right = np.random.default_rng(n), [], []
    shared = int(np.ceil(2 * n * similarity / (1 + similarity)))
    for _ in range(pairs):
        grams = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * n - shared, dtype=np.uint64)
        left.append(bj.signature(bj.minhashes(grams[:n])))
        right.append(bj.signature(bj.minhashes(grams[n - shared :])))
    return [np.frombuffer(b"".join(x), np.uint8).reshape(-1, bj.HASHES) for x in (left, right)]


@pytest.mark.parametrize("n", [50, 300, 500, 1000, 5000])
def test_disjoint_sets_are_dropped_and_those_at_the_threshold_stay(n):
    rules = bj.least_matches()
    a, b = signatures(n, 0)
    assert (a == b).mean() < 3 / 256
    assert not len(bj.plausible(a, b, rules)[0])
    a, b = signatures(n, 0.8)
    i, j = bj.plausible(a, b, rules)
    assert (i == j).sum() == len(a)
