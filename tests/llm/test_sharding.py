import random
import zlib
from collections import defaultdict

from docquill.llm import sharding


def check(rows, got, shards=8):
    assert len(got) == len(rows)
    sizes, slots = [0] * shards, defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == expected
    return sizes


def test_sizes_are_near_equal(make, corpus):
    rng = random.Random(1)
    rows = corpus + [(5000 + k, "hot text " * 30) for k in range(800)] + [(9000 + k, "x" * rng.randrange(2000)) for k in range(500)] + [(1, None), (2, ""), (3, "é")]
    for ranges in (1000, 16):
        sizes = check(rows, sharding.sharded(make(rows), ranges=ranges).collect())
        mean, largest = sum(sizes) / 8, max(len((t or "").encode()) + 1 for _, t in rows)
        assert max(sizes) - min(sizes) <= max(largest, mean * (0.02 if ranges == 1000 else 0.5))


def test_equal_texts_stay_together_unless_they_overfill(make):
    rows = [(k, f"text number {k // 3} " * 20) for k in range(3000)]
    where = defaultdict(set)
    docs = dict(rows)
    for r in sharding.sharded(make(rows)).collect():
        where[docs[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    hot = [(k, "the same text") for k in range(1000)]
    sizes = check(hot, sharding.sharded(make(hot)).collect())
    assert max(sizes) < 2 * min(sizes)


def test_edge_tables(make):
    assert sharding.sharded(make([])).count() == 0
    check([(1, None)], sharding.sharded(make([(1, None)])).collect())
    check([(None, "a"), (None, "a"), (1, "a"), (1, "a")], sharding.sharded(make([(None, "a"), (None, "a"), (1, "a"), (1, "a")])).collect())


def test_a_heavy_text_of_one_doc_id_is_subdivided(make):
    for doc_id in (7, None):
        rows = [(doc_id, "the same text again and again") for _ in range(4000)] + [(100 + k, f"other {k}") for k in range(100)]
        sizes = check(rows, sharding.sharded(make(rows)).collect())
        assert max(sizes) < 1.3 * min(sizes)


def test_ranges_against_a_plain_reading(spark, make, monkeypatch):
    """Splitters are quantiles of the keys drawn, and a key's range is the number of splitters at or below it."""
    import xxhash

    rows = [(k, f"text {k} " * (1 + k % 7)) for k in range(700)]
    sizes = {d: (len(t.encode()) + 1, int.from_bytes(xxhash.xxh64(t.encode(), seed=42).digest(), "big", signed=True)) for d, t in rows}
    docs = spark.createDataFrame([(d, *s) for d, s in sizes.items()], "doc_id long, size long, key long")
    total, ranges = sum(s for s, _ in sizes.values()), 37
    got = sharding.drawn_splitters(docs, total, ranges)
    monkeypatch.setattr(sharding, "DRAWS", 10**9)  # every row
    every = sorted(k for _, k in sizes.values())
    assert sharding.drawn_splitters(docs, total, ranges) == sorted({every[i * len(every) // ranges] for i in range(1, ranges)})
    found = {r["doc_id"]: r["r"] for r in docs.select("doc_id", sharding.range_of(docs["key"], got).alias("r")).collect()}
    assert found == {d: sum(s <= k for s in got) for d, (_, k) in sizes.items()} and set(got) <= set(every)
