"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of `WINDOW`; a GRU reads each window forwards and another backwards, a softmax
over both states labels every byte, and the probabilities of all bytes of all windows are averaged for the document.
Training is backpropagation through time in numpy with Adam, on windows drawn from the whole texts of at most `TRAIN_ROWS`
labelled rows, chosen by hash (a bounded sample of labelled rows; this is all that reaches the driver). Prediction
reads whole texts: windows of a batch of documents are stacked, so a very long text is many rows of the same matrix.

Defined results: null, empty and letterless texts are `und` with score 0; without any labelled row every text is `und`;
equal texts get equal results; ties between languages go to the first by name; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquill.llm.common import chosen, small_batches, table, trimmed

WINDOW, HIDDEN, STACK, PORTION = 128, 8, 4096, 8_000_000
TRAIN_ROWS, STEPS, BATCH, RATE, SEED = 4000, 240, 192, 0.03, 7
UND = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Cell:
    """One direction. inputs: a column of 3H gate inputs for each byte value and the pad 256; rec: 3H x H; bias: H, of the candidate's recurrent part."""

    inputs: np.ndarray
    rec: np.ndarray
    bias: np.ndarray

    @staticmethod
    def new(rng: np.random.Generator, hidden: int) -> Cell:
        return Cell((rng.standard_normal((3 * hidden, 257)) * 0.3).astype("f4"), (rng.standard_normal((3 * hidden, hidden)) * (0.6 / hidden**0.5)).astype("f4"), np.zeros((hidden, 1), "f4"))

    def forward(self, x: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """States after each row of x (time x batch), each H x batch; keep: gets what backward needs."""
        n = len(self.bias)
        h = np.zeros((n, x.shape[1]), "f4")
        for row in x:
            g, u = self.inputs.take(row, axis=1), self.rec @ h
            gates = g[: 2 * n]
            gates += u[: 2 * n]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            r, z = gates[:n], gates[n:]
            un = u[2 * n :]
            un += self.bias
            c = g[2 * n :]
            c += r * un
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c
            if keep is not None:
                keep.append((row, h, r, z, un, c))
            h = new
            yield h

    def backward(self, kept: list, dhs: list[np.ndarray]) -> list[np.ndarray]:
        """Gradients of inputs, rec and bias from those of the states."""
        n, (di, du, db) = len(self.bias), (np.zeros_like(x) for x in (self.inputs, self.rec, self.bias))
        dh = np.zeros_like(dhs[0])
        eye = np.eye(257, dtype="f4")
        for (row, h, r, z, un, c), own in zip(reversed(kept), reversed(dhs), strict=True):
            dh = dh + own
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            gates = np.concatenate([dr, dz, dc])
            rec = np.concatenate([dr, dz, dc * r])
            di += gates @ eye[row]
            du += rec @ h.T
            db += (dc * r).sum(1, keepdims=True)
            dh = dh * z + self.rec.T @ rec
        return [di, du, db]


@dataclass
class Model:
    langs: list[str]
    cells: tuple[Cell, Cell]
    out: np.ndarray  # L x 2H
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [*(p for c in self.cells for p in (c.inputs, c.rec, c.bias)), self.out, self.bias]

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each position: time x L x batch."""
        n = self.out.shape[1] // 2
        logits = np.empty((len(x), len(self.langs), x.shape[1]), "f4")
        for t, h in enumerate(self.cells[0].forward(x)):
            np.matmul(self.out[:, :n], h, out=logits[t])
        for t, h in enumerate(self.cells[1].forward(x[::-1])):
            logits[len(x) - 1 - t] += self.out[:, n:] @ h
        logits += self.bias
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def pooled(self, texts: list[bytes], stack: int = STACK) -> np.ndarray:
        """Mean probabilities over all bytes of each text: texts x L."""
        sizes = np.array([len(t) for t in texts], np.int64)
        grid, rows = gridded(texts)
        total = np.zeros((len(texts), len(self.langs)))
        owner = np.repeat(np.arange(len(texts)), rows)
        for at in range(0, len(grid), stack):
            x = np.ascontiguousarray(grid[at : at + stack].T)
            p = self.labels(x)
            p *= (x != 256)[:, None, :]
            np.add.at(total, owner[at : at + stack], p.sum(0).T)
        return total / np.maximum(sizes, 1)[:, None]


def gridded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, a row each, and how many each text has."""
    rows = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    flat = np.full(int(rows.sum()) * WINDOW, 256, np.int16)
    starts = (np.cumsum(rows) - rows) * WINDOW
    for t, at in zip(texts, starts.tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return flat.reshape(-1, WINDOW), rows


def train(texts: list[bytes], langs: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Model | None:
    """texts: the training rows' whole texts. Each step draws texts, and from each one of its windows."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    model = Model(names, (Cell.new(rng, hidden), Cell.new(rng, hidden)), (rng.standard_normal((len(names), 2 * hidden)) * 0.3).astype("f4"), np.zeros((len(names), 1), "f4"))
    grid, windows = gridded(texts)
    starts = np.cumsum(windows) - windows
    target = np.searchsorted(names, langs)
    share = np.bincount(target, minlength=len(names)).astype(float)
    chance = (share**-0.5)[target]  # rare languages are drawn more often than their share
    chance /= chance.sum()
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.params()]
    for step in range(1, steps + 1):
        own = rng.choice(len(texts), min(BATCH, len(texts)), p=chance)
        drawn = starts[own] + (rng.random(len(own)) * windows[own]).astype(np.int64)
        grads = gradients(model, np.ascontiguousarray(grid[drawn].T), target[own])
        norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
        rate = RATE * (1 - 0.9 * step / steps)
        for p, g, (m, v) in zip(model.params(), grads, moments, strict=True):
            g = g / norm
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype("f4")
    return model


def gradients(model: Model, x: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy over positions, by backpropagation through time."""
    n, steps = model.out.shape[1] // 2, len(x)
    kept: tuple[list, list] = ([], [])
    ahead = list(model.cells[0].forward(x, kept[0]))
    behind = list(model.cells[1].forward(x[::-1], kept[1]))
    weight = (x != 256).astype("f4") / max(1, int((x != 256).sum()))
    dout, dbias, da, db = np.zeros_like(model.out), np.zeros_like(model.bias), [], []
    for t in range(steps):
        h = np.concatenate([ahead[t], behind[steps - 1 - t]])
        d = model.out @ h + model.bias
        d = np.exp(d - d.max(0))
        d /= d.sum(0)
        d[target, np.arange(len(target))] -= 1
        d *= weight[t]
        dout += d @ h.T
        dbias += d.sum(1, keepdims=True)
        back = model.out.T @ d
        da.append(back[:n])
        db.append(back[n:])
    return [*model.cells[0].backward(kept[0], da), *model.cells[1].backward(kept[1], db[::-1]), dout, dbias]


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def fitted(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model of the whole texts of labelled rows that aren't held out, the `rows` first by hash."""
    own = docs.select("doc_id", "lang", "text").where(~held_out() & F.col("lang").isNotNull() & (F.char_length("text") > 0))
    got = chosen(own, F.xxhash64("doc_id", "text"), rows).select("lang", "text").collect()
    return train([r["text"].encode("utf-8", "replace") for r in got], [r["lang"] for r in got])


def portions(texts: list[str], named: list[bool]) -> Iterator[list[int]]:
    """The places of named texts, in lists of about PORTION characters together, so that memory doesn't follow a batch's size."""
    own, size = [], 0
    for k, ok in enumerate(named):
        if ok:
            own.append(k)
            size += len(texts[k])
            if size >= PORTION:
                yield own
                own, size = [], 0
    if own:
        yield own


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """Every column of docs with lang_pred and score, as struct columns row and found."""
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")
    schema = T.StructType([*src.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            named = [model is not None and any(map(str.isalpha, t)) for t in texts]
            langs, score = [UND] * len(texts), [0.0] * len(texts)
            for at in portions(texts, named):
                p = model.pooled([texts[k].encode("utf-8", "replace") for k in at])
                for k, row in zip(at, p, strict=True):
                    langs[k], score[k] = model.langs[int(row.argmax())], min(1.0, float(row.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["row", "text", "lang_pred", "score"])
        trimmed()

    small_batches(docs.sparkSession)
    return src.mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    return predicted(docs, fitted(docs))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predicted(docs.select("doc_id", "text"), fitted(docs))
    return out.select("row.doc_id", "lang_pred", "score").withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
