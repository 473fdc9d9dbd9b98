import numpy as np
import pytest

from docquill.llm.eliasfano import EliasFano


@pytest.mark.parametrize("universe", [1, 2, 100, 10**6, 1 << 40, 1 << 48])
def test_access_and_search(universe):
    rng = np.random.default_rng(universe)
    for n in (0, 1, 5, 300, 5000):
        values = np.unique(rng.integers(0, universe, n)) if n else np.zeros(0, np.int64)
        seq = EliasFano.build(values.astype(np.uint64), universe)
        assert (seq.get(np.arange(len(values))) == values.astype(np.uint64)).all()
        asked = np.concatenate([rng.integers(0, universe, 200), values])
        place = np.searchsorted(values, asked)
        there = np.isin(asked, values)
        assert (seq.find(asked.astype(np.uint64)) == np.where(there, place, -1)).all()


def test_repeated_values_and_size():
    values = np.sort(np.random.default_rng(0).integers(0, 50, 500))
    assert (EliasFano.build(values, 51).get(np.arange(500)) == values.astype(np.uint64)).all()
    sparse = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 100_000))
    assert EliasFano.build(sparse, 1 << 40).bytes() < 100_000 * 4.5


def test_search_in_crowded_high_parts():
    """Runs of more than 64 ones, whole chunks and parts of them, and values beyond the universe."""
    values = np.unique(np.concatenate([np.arange(300), 10**6 + np.arange(64), 2 * 10**6 + np.arange(63), 10**9 + 3 * np.arange(40_000)]))
    seq = EliasFano.build(values.astype(np.uint64), 1 << 40)
    asked = np.concatenate([values, values + 1, [1 << 40, (1 << 40) + 10**9, 1 << 50, (1 << 40) - 1]])
    place = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    assert (seq.find(asked.astype(np.uint64)) == np.where(values[place] == asked, place, -1)).all()
    assert (seq.get(np.arange(len(values))) == values.astype(np.uint64)).all()
    assert (EliasFano.build(np.arange(0), 1).find(np.arange(3)) == -1).all()
