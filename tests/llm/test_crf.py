from itertools import product

import numpy as np

from spanloom.llm.crf import Chains, forward_backward


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 0, 1, 4, 2])
    e, move, begin = rng.normal(size=(10, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    post, moves, firsts, z = forward_backward(e, Chains.of(lengths), move, begin, pairs=True)
    want, wm, wf, wz, at = np.zeros_like(e), np.zeros((3, 3)), np.zeros(3), 0.0, 0
    for n in lengths:
        if n:
            paths = list(product(range(3), repeat=n))
            score = np.array([begin[p[0]] + sum(e[at + i, l] for i, l in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
            weight = np.exp(score)
            wz += np.log(weight.sum())
            for p, w in zip(paths, weight / weight.sum(), strict=True):
                wf[p[0]] += w
                for i, l in enumerate(p):
                    want[at + i, l] += w
                for a, b in zip(p, p[1:], strict=False):
                    wm[a, b] += w
        at += n
    assert np.allclose(post, want) and np.allclose(moves, wm) and np.allclose(firsts, wf) and np.isclose(z, wz)
