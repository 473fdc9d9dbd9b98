import hashlib
import random

import numpy as np

from docquill.llm import packing
from docquill.llm.bpe import vocabulary
from tests.llm.conftest import SF


def test_best_fit_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        length = rng.choice([1, 5, 16, 100])
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 60))]
        rooms = []
        for size in sorted(sizes, reverse=True):
            fit = [r for r in rooms if r >= size]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else length) - size)
        used = {}
        for size, row in zip(sizes, packing.best_fit(sizes, length), strict=True):
            used[row] = used.get(row, 0) + size
        assert sorted(length - u for u in used.values()) == sorted(rooms)


def test_round_trip(make):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "é", "\n"]) for _ in range(rng.randrange(60)))) for k in range(80)] + [(500, None), (501, ""), (502, "long text " * 3000), (503, "x")]
    path, pattern = vocabulary()
    encode = packing.tokenizer(path, pattern).encode_ordinary
    for window in (packing.WINDOW, 100):
        got = packing.packed(make(rows), path, pattern, length=64, window=window).collect()
        pieces = {}
        assert len({(r["part"], r["row"]) for r in got}) == len(got)
        for r in got:
            ids, places, cuts = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4"), r["cu_seqlens"]
            assert len(ids) == len(places) == 64 and cuts[0] == 0 and cuts[-1] == r["n_tokens"] and (ids[cuts[-1] :] == packing.PAD).all()
            for doc, start, a, b in zip(r["doc_ids"], r["piece_starts"], cuts, cuts[1:], strict=False):
                assert places[a:b].tolist() == list(range(b - a))
                pieces.setdefault(doc, []).append((start, ids[a:b].tolist()))
        back = {d: [x for _, part in sorted(p) for x in part] for d, p in pieces.items()}
        assert back == {d: encode(t) for d, t in rows if t}
    assert packing.packed(make([]), path, pattern).count() == 0


def test_written_matrices(make, spark, tmp_path):
    path, pattern = vocabulary()
    packing.write_packed(make([(1, "some text"), (1, "some text")]), str(tmp_path / "out"), path, pattern, 32)
    row = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(row) == 1 or sum(len(r["doc_ids"]) for r in row) == 2


def test_query_holds_every_token(spark, corpus):
    encode = packing.tokenizer(*vocabulary()).encode_ordinary
    pieces = {}
    for r in packing.op9_packing(spark, SF).collect():
        ids, places, cuts = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4"), r["cu_seqlens"]
        assert len(ids) == len(places) == packing.LENGTH and hashlib.sha256(r["input_ids"] + r["position_ids"]).hexdigest() == r["matrix_sha256"]
        for doc, start, a, b in zip(r["doc_ids"], r["piece_starts"], cuts, cuts[1:], strict=False):
            assert places[a:b].tolist() == list(range(b - a))
            pieces.setdefault(doc, []).append((start, ids[a:b].tolist()))
    assert {d: [x for _, part in sorted(p) for x in part] for d, p in pieces.items()} == {d: encode(t) for d, t in corpus if t}
