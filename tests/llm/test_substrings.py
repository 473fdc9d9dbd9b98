import hashlib
import random

import numpy as np
import pytest

from docquill.llm import substrings, suffixarray
from docquill.llm.suffixarray import common_prefixes, suffix_array


def brute(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            x = raw[s : s + length]
            if x in seen:
                gone[s : s + length] = True
            seen.add(x)
        edges = np.diff(gone.astype(int), prepend=0)
        out[d] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_arrays():
    rng = random.Random(3)
    for t in range(120):
        segs = [bytes(rng.choice(b"ab\0" if t % 2 else b"abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        segs += [segs[0]] * (t % 3)
        data, ends = np.frombuffer(b"".join(segs), np.uint8), np.cumsum([len(s) for s in segs])
        order = suffix_array(data, ends)
        starts = ends - [len(s) for s in segs]
        named = sorted((s[i:], k, int(starts[k]) + i) for k, s in enumerate(segs) for i in range(len(s)))
        assert order.tolist() == [p for _, _, p in named]
        common = [0] + [next((i for i, (a, b) in enumerate(zip(x[0], y[0], strict=False)) if a != b), min(len(x[0]), len(y[0]))) for x, y in zip(named, named[1:], strict=False)]
        assert common_prefixes(data, ends, order).tolist() == common


def sample_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé\0") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(5)]
    rows = [(k, text(rng.randrange(60)) + rng.choice([*passages, "", passages[0] + passages[1]]) + text(rng.randrange(30))) for k in range(60)]
    rows += [(100 + k, passages[0]) for k in range(8)] + [(200, None), (201, ""), (202, "x" * 700), (203, "ab" * 400), (204, "y" * 99), (205, "y" * 99), (206, "z" * 100), (207, "z" * 100), (208, rows[0][1])]
    return rows


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize(("block", "merge", "fan"), [(8_000_000, 400_000, 256), (3000, 200, 2)])
def test_against_brute_force(make, monkeypatch, block, merge, fan):
    """The second case has many small blocks and several rounds of merges."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "MERGE_STARTS", merge)
    monkeypatch.setattr(substrings, "FAN", fan)
    rows = sample_rows()
    assert result(substrings.deduplicated(make(rows))) == brute(rows, 100)


def test_corpus(make, corpus):
    assert result(substrings.deduplicated(make(corpus))) == brute(corpus, 100)


def test_repeated_rows_nulls_and_empty_table(make):
    a, b = "q1w2e3r4t5" * 20 + "tail", "".join(chr(97 + k % 26) + str(k) for k in range(60))
    got = substrings.deduplicated(make([(1, b), (1, b), (None, b), (2, a)])).collect()
    by = sorted((str(r["doc_id"]), r["n_removed"]) for r in got)
    assert by == [("1", 0), ("1", 0), ("2", brute([(2, a)], 100)[2][1]), ("None", len(b))]
    assert substrings.deduplicated(make([])).count() == 0


def test_prefixes_of_long_copies_take_few_rounds(monkeypatch):
    rounds = []
    plain = suffixarray.leading_bytes
    monkeypatch.setattr(suffixarray, "leading_bytes", lambda diff: rounds.append(len(diff)) or plain(diff))
    rng = random.Random(2)
    text = bytes(rng.randrange(256) for _ in range(20_000))
    segs = [text, text, text[:-1] + bytes([text[-1] ^ 1]), text[5:]]
    data, ends = np.frombuffer(b"".join(segs), np.uint8), np.cumsum([len(s) for s in segs])
    order = suffix_array(data, ends)
    common = common_prefixes(data, ends, order)
    left = ends[np.searchsorted(ends, order, "right")] - order
    assert common.max() == 20_000 and np.array_equal(np.sort(order), np.arange(len(data)))
    for k in range(1, len(order), 997):
        x, y = data[order[k - 1] :][: left[k - 1]].tobytes(), data[order[k] :][: left[k]].tobytes()
        n = int(common[k])
        assert x <= y and x[:n] == y[:n] and x[n : n + 1] != (y[n : n + 1] or None)
    assert len(rounds) < 100  # one for every eight bytes before


def test_merges_move_places_and_not_strings():
    import tracemalloc

    rng = np.random.default_rng(4)
    texts = {k: rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes() for k in range(1, 5)}
    texts[4] = texts[1][:30_000] + texts[4][30_000:]
    n = 60_000 - 99
    rows = substrings.as_table([substrings.packed(k, 0, [(k, 0, n)], lambda key, a, b: texts[key][a : b + 99]) for k in texts])
    run = substrings.merge_parts(100, True)
    tracemalloc.start()
    got = run(rows).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["key"], r["a"], r["b"]) for r in got] == [(4, 0, 30_000 - 99)]
    assert peak < 4 * n * 100  # the strings themselves, which were copied at each merge before
