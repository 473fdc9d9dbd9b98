import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from docquill.llm import lmscore


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + [""]


def is_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def rounded(p):
    """What a quantised probability stands for."""
    return 10 ** (-min(254, round(-lmscore.STEPS * math.log10(p))) / lmscore.STEPS)


def brute(rows):
    """Trigrams with a Dirichlet prior around pairs, and these around add-one words."""
    uni, pairs, grams = Counter(), Counter(), Counter()
    texts = {k: [-1, -2, *tokens(t), -3] for k, (_, t) in enumerate(rows)}
    for k, x in texts.items():
        if not is_held(rows[k][0]):
            uni.update(x[:-1])
            pairs.update(zip(x, x[1:], strict=False))
            grams.update(zip(x, x[1:], x[2:], strict=False))
    starts = uni.pop(-1, 0)
    uni.pop(-2, 0)
    n, v, prior = sum(uni.values()), len(uni), lmscore.PRIOR
    count = lambda w: starts if w in (-1, -2) else uni[w]
    out = []
    for k, x in texts.items():
        base = score = 0.0
        for u, v_, w in zip(x[:-1], x[1:-1], x[2:-1], strict=False):
            p = (uni[w] + 1) / (n + (v + 1))
            base += math.log10(p)
            two, own = pairs[v_, w], pairs[u, v_]
            p = (rounded(two / (count(v_) + prior)) if two else 0.0) + prior / (count(v_) + prior) * p
            if own:
                three = grams[u, v_, w]
                p = (rounded(three / (own + prior)) if three else 0.0) + rounded(prior / (own + prior)) * p
            score += math.log10(min(1.0, p))
        words = x[2:-1]
        out.append((rows[k][0], is_held(rows[k][0]), len(words), sum(uni[w] > 0 for w in words), n, base, score))
    return out


@pytest.mark.parametrize(("block", "words", "grams"), [(1_000_000, 2_000_000, 2_000_000), (700, 100, 300)])
def test_against_brute_force(make, corpus, monkeypatch, block, words, grams):
    monkeypatch.setattr(lmscore, "SHARD_WORDS", words)
    monkeypatch.setattr(lmscore, "SHARD_GRAMS", grams)
    rng = random.Random(1)
    rows = [(d, t[:1500]) for d, t in corpus[:60]] + [(1000 + k, " ".join(rng.choice("the a of Éa x".split()) for _ in range(rng.randrange(80)))) for k in range(60)]
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5003, "the the THE"), (5004, " ".join(f"long{k % 37}" for k in range(3000))), (5003, "the the THE"), (5003, "a")]
    expected = sorted(brute(rows))
    got = sorted(tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in lmscore.scored(make(rows), block).collect())
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for r, e in zip(got, expected, strict=True):
        assert math.isclose(r[5], e[5], rel_tol=1e-9) and math.isclose(r[6], e[6], rel_tol=1e-9)


def test_rows_without_an_id_are_scored_each_for_itself(make):
    got = lmscore.scored(make([(None, "a b"), (None, "a b c"), (1, "a b")])).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("1", 3), ("None", 3), ("None", 4)]


def test_levels_find_what_they_hold():
    rng = random.Random(2)
    grams = Counter(tuple(rng.randrange(3, 40) for _ in range(3)) for _ in range(3000))
    u, v, w = (np.array(x, np.int64) for x in zip(*sorted(grams), strict=True))
    firsts, pairs = Counter(), Counter()
    for (a, b, _), c in grams.items():
        firsts[a] += c
        pairs[a, b] += c
    levels = lmscore.Levels(u, v, w, np.array([grams[g] for g in sorted(grams)]), np.array([firsts[a] for a in u.tolist()]))
    for a, b, c in [tuple(rng.randrange(0, 45) for _ in range(3)) for _ in range(2000)]:
        one = np.ones(1, np.int64)
        got = levels.codes(np.array([a]), one, np.array([b]), one, np.array([c]))
        share = [pairs[a, b] / (firsts[a] + lmscore.PRIOR), lmscore.PRIOR / (pairs[a, b] + lmscore.PRIOR) if pairs[a, b] else 0, grams[a, b, c] / (pairs[a, b] + lmscore.PRIOR)]
        assert [int(x[0]) for x in got] == [int(lmscore.quantised(np.array([s]))[0]) if s else 0 for s in share]


def test_what_several_blocks_ask_is_sought_once(monkeypatch):
    sought = []
    find = lmscore.EliasFano.find
    monkeypatch.setattr(lmscore.EliasFano, "find", lambda self, x: (sought.append(len(x)), find(self, x))[1])
    c = lambda *x: lmscore.coded(np.array(x, np.int64))
    # Trigrams 3 4 5 (twice in training texts of each block), 3 4 6 (held out only), 3 7 5, 9 4 5; firsts are sent as steps.
    request = [c(3, 6), c(20, 10), c(2, 1), c(4, 7, 4), c(2, 1, 1), c(5, 6, 5, 5), c(2, 0, 1, 1)]
    got = lmscore.grams_answered(pa.Table.from_batches([lmscore.batch_of(lmscore.ASKED, [[0] * 4, list(range(4)), *[[x] * 4 for x in request]])]))
    assert sum(sought) == 2 + 3 + 4  # firsts, pairs, trigrams
    share = lambda *p: [int(x) for x in lmscore.quantised(np.array(p))]
    expected = share(8 / 24, 4 / 24, 4 / 14), share(4 / 12, 4 / 8, 4 / 8), share(8 / 12, 1, 4 / 8, 4 / 8)
    expected[2][1] = 0
    for r in got.to_pylist():
        assert tuple(list(zstandard.decompress(r[f])) for f in ("pairs", "weights", "grams")) == expected


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_texts(kind):
    rng = random.Random(4)
    letters = [*map(chr, range(0x24)), *"aAzZ@[`{éÉ\x85\xa0\u2003\u3000", *" " * 10]
    texts = [None, "", " ", *("".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000))]
    words = lmscore.words_of(pa.array(texts, kind).slice(0))
    assert words.to_pylist() == [tokens(t) for t in texts]
    part = lmscore.words_of(pa.array(texts, kind).slice(5, 700))
    bounds = part.offsets.to_pylist()
    assert [part.values[b:e].to_pylist() for b, e in zip(bounds, bounds[1:], strict=False)] == [tokens(t) for t in texts[5:705]]


def test_long_texts_are_split_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(lmscore, "PORTION", 100)
    texts = ["a" * 30, None, "", "b" * 70, "c", "d" * 1000, "e" * 99, "é" * 50, "f", *["g"] * 250]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = list(lmscore.portions(batch))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(len(texts)))
    assert all(sum(len((t or "").encode()) for t in b.column(1).to_pylist()[:-1]) <= 100 for b in got)
    assert len(got) == 7 and list(lmscore.portions(batch.slice(0, 0))) == []


def test_edge_tables(make):
    assert lmscore.scored(make([])).count() == 0
    held = next(k for k in range(100) if is_held(k))
    row = lmscore.scored(make([(held, "no training rows")])).collect()[0]
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["n_tokens"] == 4
    own = next(k for k in range(100) if not is_held(k))
    twice = lmscore.scored(make([(own, "a b"), (own, "a b")])).collect()
    assert twice[0]["score"] == twice[1]["score"] and twice[0]["train_tokens"] == 6


def test_model_beats_the_base_on_held_out_texts(spark):
    from tests.llm.conftest import SF

    rows = [r for r in lmscore.op5_lmscore(spark, SF).collect() if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
