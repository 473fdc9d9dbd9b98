import random
import re

import numpy as np
import pytest
import xxhash

from docquill.llm import simhash
from docquill.llm.common import components


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows):
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    group = list(range(len(fps)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, f"{fp:016x}", least[find(i)]) for i, (d, fp) in enumerate(fps))


def test_against_brute_force(make, corpus):
    rng = random.Random(2)
    words = "the quick brown fox jumps over a lazy dog and runs far away from it all today".split()
    rows = corpus[:120]
    base = [rng.choice(words) + str(rng.randrange(50)) for _ in range(200)]
    for k in range(40):  # chains of small edits
        base[rng.randrange(200)] = f"edit{k}"
        rows.append((10_000 + k, " ".join(base)))
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "One"), (20_004, "oNE"), (20_005, "a b"), (20_006, "Ä ä"), (5, None)]
    rows = list(dict(rows).items())
    got = sorted(tuple(r) for r in simhash.near_duplicates(make(rows)).select("doc_id", "fingerprint", "component_id").collect())
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(make):
    got = simhash.near_duplicates(make([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1)]
    assert simhash.near_duplicates(make([])).count() == 0
    kept = simhash.deduplicated(make([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "z")])).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "None"]


def test_forest_spans_the_links(monkeypatch):
    monkeypatch.setattr(simhash, "BRUTE", 8)
    rng = np.random.default_rng(1)
    start = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = {int(start)}
    while len(fps) < 300:
        x = int(rng.choice(np.array(sorted(fps), np.uint64)))
        for b in rng.integers(0, 40, rng.integers(1, 6)):
            x ^= 1 << int(b)
        fps.add(x)
    a = np.array(sorted(fps), np.uint64)

    def groups(edges):
        g = list(range(len(a)))
        find = lambda i: i if g[i] == i else find(g[i])
        for i, j in edges:
            g[find(i)] = find(j)
        return [find(i) for i in range(len(a))]

    def same(x, y):
        return len(set(zip(x, y, strict=True))) == len(set(x)) == len(set(y))

    true = [(i, j) for i in range(len(a)) for j in range(i) if (int(a[i]) ^ int(a[j])).bit_count() <= 3]
    assert same(groups(true), groups(simhash.forest(a, list(range(64)))))


def test_hot_keys_are_split(make, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 2)
    rng = random.Random(4)
    base = [f"w{rng.randrange(1000)}" for _ in range(400)]
    rows = []
    for k in range(60):
        base[rng.randrange(400)] = f"edit{k}"
        rows.append((k, " ".join(base)))
    got = sorted(tuple(r) for r in simhash.near_duplicates(make(rows)).select("doc_id", "fingerprint", "component_id").collect())
    assert got == brute(rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7)] + [(1000, 2000 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[300] == 100 and all(got[2000 + i] == 1000 for i in range(50))


def jaccard_kept(rows):
    """The least doc_id of each component of Jaccard >= 0.8 over five-word shingles, by all pairs."""

    def grams(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [(d, grams(t)) for d, t in sorted(rows)]
    group = list(range(len(sets)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i][1] & sets[j][1]) >= 4 * len(sets[i][1] | sets[j][1]):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    return sorted(d for i, (d, _) in enumerate(sets) if find(i) == i)


def test_similar_against_brute_force_jaccard(make, corpus, monkeypatch):
    monkeypatch.setattr(simhash, "COMMON", 4)
    rng = random.Random(5)
    rows = list(corpus[:100])
    passage = [f"p{k}" for k in range(60)]
    for group in range(6):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([30, 200, 600]))]
        for k in range(12):  # near copies at similarities about the bound
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            rows.append((10_000 + 100 * group + k, " ".join(words)))
    rows += [(20_000 + k, " ".join([*passage, *(f"u{k}x{i}" for i in range(80))])) for k in range(30)]  # share a passage only
    rows += [(30_000, ""), (30_001, " \n"), (30_002, "One"), (30_003, "oNE"), (30_004, "a b c d"), (30_005, "a b c d e")]
    got = sorted(r["doc_id"] for r in simhash.deduplicated(make(rows), 5, 0.8).collect())
    assert got == jaccard_kept(rows) and len(rows) - len(got) > 40


def test_rows_without_an_id_link_similar_groups(make):
    words = [f"w{k}" for k in range(100)]
    a, x, b = words, [*words[:-9], *(f"x{k}" for k in range(9))], [*(f"y{k}" for k in range(9)), *words[9:-9], *(f"x{k}" for k in range(9))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(make([(1, " ".join(a)), (None, " ".join(x)), (2, " ".join(b))]), 5, 0.8).collect()}
    assert got == {1: 1, 2: 1, None: 1}


def test_rows_of_one_id_are_told_apart_by_text(make):
    one, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"x{k}" for k in range(60))
    kept = simhash.deduplicated(make([(7, one), (7, other), (7, one), (8, one + " more"), (None, other)])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("7", one), ("7", other), ("None", other)])


def test_fingerprints_held_by_rows_without_an_id_link(make, monkeypatch):
    rows = [(7, 0b0001), (None, 0b0111), (9, 0b111111), (None, 0xFFFFF << 30)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", docs["text"].cast("long").alias("fp")))
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(make([(d, str(x)) for d, x in rows])).collect()]
    assert sorted(got, key=str) == sorted([(7, 7), (None, 7), (9, 7), (None, None)], key=str)


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, rng.integers(1, 4000), dtype=np.uint64) * np.uint64(2)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, len(pool) + 1), replace=False)) for _ in range(2))
        shared = len(np.intersect1d(a, b))
        assert shared <= simhash.most_shared(simhash.sketch(a), simhash.sketch(b), len(a), len(b)) <= min(len(a), len(b))
    same = np.arange(3000, dtype=np.uint64)  # all in one range
    assert simhash.most_shared(simhash.sketch(same), simhash.sketch(same), 3000, 3000) == 3000
    apart = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    assert simhash.most_shared(simhash.sketch(apart[:2000]), simhash.sketch(apart[1000:]), 2000, 2000) < 1500


def test_the_shared_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace

    from docquill.llm import common

    nothing = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nothing)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_a_turn_gives_each_node_of_a_large_key_several_partners(spark):
    """Of a large key a node meets a bounded number of nodes, not one hub that all share, and others each turn."""
    n = 300
    own = spark.createDataFrame([(7, k, 100, 0, k % 290, n) for k in range(n)] + [(8, 5, 100, 1, 5, 2), (8, 1000, 500, 0, 1000, 2)], "key long, node long, n long, place long, root long, c long")
    turns = [{(r["u"], r["v"]) for r in simhash.ring_pairs(own, turn, 0.8).collect()} for turn in range(2)]
    for pairs in turns:
        met = [sum(k in p for p in pairs) for k in range(n)]
        assert simhash.NEAR - 1 <= min(met) and max(met) <= 2 * simhash.NEAR and len(pairs) <= simhash.NEAR * n
        assert all(u < v < n and u % 290 != v % 290 for u, v in pairs)
    assert len(turns[0] & turns[1]) < len(turns[0]) // 2


def test_groups_take_in_links_turn_by_turn(spark, monkeypatch):
    """By one task or by rounds, groups after each turn are those of all links so far."""
    rng = random.Random(3)
    turns = [[(rng.randrange(80), rng.randrange(80)) for _ in range(n)] for n in (25, 0, 15, 10)]
    for few in (simhash.FEW, 4):
        monkeypatch.setattr(simhash, "FEW", few)
        roots, group = None, list(range(80))
        for turn in turns:
            roots = simhash.regrouped(spark.createDataFrame(turn, "u long, v long"), roots)
            for u, v in turn:
                a, b = sorted((group[u], group[v]))
                group = [a if x == b else x for x in group]
            got = {r["node"]: r["root"] for r in roots.collect()}
            assert roots.count() == len(got) and [got.get(k, k) for k in range(80)] == group


def test_turns_without_candidates_or_links_cost_the_driver_little(spark, make, corpus):
    """Each turn once joined up all links so far in rounds; what plans and jobs leave on the driver ended a run."""
    context = spark.sparkContext
    context.setJobGroup("similar", "")
    try:
        simhash.deduplicated(make(corpus[:100] + [(10_000 + d, t) for d, t in corpus[:20]])).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("similar")) < 130
