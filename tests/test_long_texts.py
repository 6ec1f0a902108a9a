import numpy as np

from quillstack.operators.text import common_lines


def plain_length(a, b):
    row = np.zeros(len(b) + 1, int)
    b = np.array(b)
    for line in a:
        row[1:] = np.maximum.accumulate(np.where(b == line, row[:-1] + 1, row[1:]))
    return row[-1]


def test_common_lines_are_longest_at_every_size():
    rng = np.random.default_rng(6)
    for n, m, kinds in [(1, 5, 2), (30, 20, 3), (200, 300, 8), (5_200, 5_100, 2_000)]:
        a, b = (list(map(str, rng.integers(0, kinds, k))) for k in (n, m))
        got = common_lines(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        assert len(got) == plain_length(a, b)
