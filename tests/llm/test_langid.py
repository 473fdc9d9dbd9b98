import math
import zlib

import numpy as np

from docquill.llm import langid
from tests.llm.conftest import SF


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], (langid.Cell.new(rng, 3), langid.Cell.new(rng, 3)), rng.standard_normal((3, 6)).astype("f4"), np.zeros((3, 1), "f4"))
    for p in model.params():
        p[...] = p.astype("f8")
    x = rng.integers(0, 20, (7, 4)).astype(np.int16)
    x[5:, 1] = 256
    target = np.array([0, 1, 2, 0])

    def loss():
        p = model.labels(x)
        return float(-np.log(p[:, target, np.arange(4)])[x != 256].mean())

    grads = langid.gradients(model, x, target)
    for p, g in zip(model.params(), grads, strict=True):
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in p.shape)
            if p.shape[-1] == 257:
                at = (at[0], int(x[2, 0]))
            old = p[at]
            p[at] = old + 1e-2
            up = loss()
            p[at] = old - 1e-2
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3


def test_held_out_accuracy(spark):
    rows = langid.op1_langid(spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edge_cases(make):
    model = langid.train([b"the cat and the dog", "der Hund und die Katze".encode()] * 10, ["en", "de"] * 10, steps=60)
    texts = [None, "", "123 !?", "the dog and the cat " * 2000, "the dog and the cat", "the dog and the cat", "中"]
    got = [(r["lang_pred"], r["score"]) for r in langid.predicted(make(texts), model).orderBy("row.doc_id").collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[3][0] == got[4][0] == "en" and got[4] == got[5] and got[6][0] in ("en", "de")
    assert langid.predicted(make([]), model).count() == 0
    none = langid.identified(make(["text"], langs=[None])).collect()
    assert none[0]["lang_pred"] == "und" and none[0]["row"]["n"] == "src"


def test_windows_do_not_depend_on_neighbours():
    model = langid.train([b"the cat", b"der Hund"] * 5, ["en", "de"] * 5, steps=5)
    texts = [b"abc" * 200, b"x", b"yz" * 70]
    alone = np.concatenate([model.pooled([t]) for t in texts])
    assert np.allclose(model.pooled(texts, stack=2), alone, atol=1e-5)


def test_forward_pass_against_plain_loops():
    """A GRU written out over single numbers: every position's label probabilities, pooled over a text's windows."""
    rng = np.random.default_rng(5)
    h, langs = 3, ["a", "b"]
    model = langid.Model(langs, (langid.Cell.new(rng, h), langid.Cell.new(rng, h)), rng.standard_normal((2, 2 * h)).astype("f4"), rng.standard_normal((2, 1)).astype("f4"))
    for c in model.cells:
        c.bias[...] = rng.standard_normal((h, 1))
    sig = lambda x: 1 / (1 + math.exp(-x))

    def states(cell, data):
        s, out = [0.0] * h, []
        for byte in data:
            rec = [sum(float(cell.rec[i, j]) * s[j] for j in range(h)) for i in range(3 * h)]
            g = [float(cell.inputs[i, byte]) for i in range(3 * h)]
            r, z = ([sig(g[i + k] + rec[i + k]) for i in range(h)] for k in (0, h))
            c = [math.tanh(g[2 * h + i] + r[i] * (rec[2 * h + i] + float(cell.bias[i, 0]))) for i in range(h)]
            s = [z[i] * s[i] + (1 - z[i]) * c[i] for i in range(h)]
            out.append(s)
        return out

    for text in (b"x", bytes(rng.integers(0, 256, 100, dtype=np.uint8)), bytes(rng.integers(0, 256, 300, dtype=np.uint8))):
        total = [0.0, 0.0]
        for at in range(0, len(text), langid.WINDOW):
            data = [*text[at : at + langid.WINDOW]]
            data += [256] * (langid.WINDOW - len(data))
            both = zip(states(model.cells[0], data), states(model.cells[1], data[::-1])[::-1], data, strict=True)
            for a, b, byte in both:
                logits = [sum(float(w) * x for w, x in zip(model.out[k], [*a, *b], strict=True)) + float(model.bias[k, 0]) for k in range(2)]
                e = [math.exp(x - max(logits)) for x in logits]
                if byte != 256:
                    total = [t + x / sum(e) for t, x in zip(total, e, strict=True)]
        assert np.allclose(model.pooled([text])[0], np.array(total) / len(text), atol=1e-4)


def test_training_reads_whole_texts():
    """The language shows only behind the first windows."""
    texts, langs = [b"0" * 400 + b"abab" * 100, b"0" * 400 + b"cdcd" * 100] * 20, ["x", "y"] * 20
    model = langid.train(texts, langs, steps=60)
    assert [model.langs[int(p.argmax())] for p in model.pooled([b"abab" * 30, b"cdcd" * 30])] == ["x", "y"]
