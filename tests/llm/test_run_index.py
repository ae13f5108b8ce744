"""The run-length index against plain sorting and all-pairs matching."""

import numpy as np

from cartlens.llm import run_index as op


def texts():
    r = np.random.default_rng(1)
    for k in range(60):
        t = r.integers(0, r.integers(1, 4), r.integers(1, 60)).astype(np.uint8)
        yield np.tile(t, 3)[:80] if k % 3 == 0 else t
    passage = r.integers(97, 123, 400).astype(np.uint8)
    yield np.concatenate([np.append(passage[i:i + 50], 255) for i in r.integers(0, 300, 12)])


def longest(t):
    found = [0] * len(t)
    for i in range(len(t)):
        for j in range(i + 1, len(t)):
            k = 0
            while j + k < len(t) and t[i + k] == t[j + k]:
                k += 1
            found[i], found[j] = max(found[i], k), max(found[j], k)
    return found


def test_against_plain():
    for t in texts():
        order = op.Suffixes(t).order
        assert list(order) == sorted(range(len(t)), key=lambda i, t=t: bytes(t[i:]))
        index = op.RunLengthIndex(t)
        assert list(index.matching_statistics()) == longest(t)
        assert (np.diff(index.symbols) != 0).all()
        assert list(index.transform()) == [int(t[i - 1]) if i else -1 for i in order]


def test_copies_add_few_runs():
    r = np.random.default_rng(2)
    one = np.append(r.integers(97, 123, 2000).astype(np.uint8), 255)
    many = np.tile(one, 40)
    assert len(op.RunLengthIndex(many).symbols) < 1.1 * len(op.RunLengthIndex(one).symbols) + 50
