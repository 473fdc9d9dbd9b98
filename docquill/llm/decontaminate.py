"""Benchmark decontamination by a generalised suffix automaton of the items' words.

Items are normalised (A-Z lower-cased, words of `WORD`) and built into a suffix automaton over word numbers. Training
texts stream through it: at each word the automaton holds the longest suffix that occurs in some item. A word is hit if
it lies in an occurrence of a window: `WINDOW` consecutive item words, or a whole item that has fewer.

The items are the only side that is sent out. They are read in blocks of at most `BLOCK_WORDS` words, an automaton
each (some 600 bytes a word, so 60 MB a block); nothing is shuffled. More blocks than `AT_ONCE` are further passes over
the texts, whose hits are united, so the size of what is broadcast at once is bounded whatever the benchmark's size.

Defined results: a null or empty text has no words and no hits; an item without words has no window; repeated items
count once for each item_id; an empty items table leaves every document clean; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquill.llm.common import removed, small_batches, table, trimmed, written_at

WINDOW = 10
BLOCK_WORDS, AT_ONCE = 100_000, 4
# The upper-to-lower table and the words of the contract.
UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# The same classes as a byte table: what is no word byte becomes a blank, A-Z become a-z.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences: `next` by state, suffix `link`, `length`, and the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[str] = []
        self.owners: dict[int, set[int]] = {}  # by state: items with that window
        self.short: dict[int, tuple[int, set[int]]] = {}  # by state: length and items of whole short items ending there
        sequences = []
        for name, words in items:
            if words:
                self.items.append(name)
                sequences.append([self.number.setdefault(w, len(self.number)) for w in words])
                last = 0
                for c in sequences[-1]:
                    last = self._extend(last, c)
        for k, seq in enumerate(sequences):
            for i, state, _ in self.walk(seq):
                if len(seq) < window:
                    if i == len(seq) - 1:
                        n, who = self.short.setdefault(state, (len(seq), set()))
                        who.add(k)
                elif i >= window - 1:
                    self.owners.setdefault(self.above(state), set()).add(k)
        self.ends = self._short_ends()

    def _copy(self, p: int, q: int, c: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, q, c)
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, c)
        return cur

    def above(self, state: int) -> int:
        """The state of the suffix of `window` words."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def walk(self, seq: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, longest length that matches) for each word number with a match; -1 is a word of no item."""
        follow, link, length = self.next, self.link, self.length
        state = n = 0
        for i, c in enumerate(seq):
            if c < 0:
                state = n = 0
                continue
            while (to := follow[state].get(c)) is None and state:
                state = link[state]
                n = length[state]
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            yield i, state, n

    def _short_ends(self) -> dict[int, list[tuple[int, set[int]]]]:
        """By state: the short items that are suffixes of it, the state's own included."""
        ends: dict[int, list[tuple[int, set[int]]]] = {}
        if self.short:
            for state in sorted(range(len(self.next)), key=self.length.__getitem__):
                own = [self.short[state]] if state in self.short else []
                if got := own + ends.get(self.link[state], []) if state else own:
                    ends[state] = got
        return ends

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [from, to) of words hit (they may overlap) and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        get, window, ends = self.number.get, self.window, self.ends
        seq = [get(w, -1) for w in words]
        known = np.fromiter(seq, np.int64, len(seq)) >= 0
        cuts = np.nonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))[0]
        least = min([window, *(n for n, _ in self.short.values())])
        for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True):
            if b - a < least:  # a run of item words too short for any window
                continue
            for i, state, n in self.walk(seq[a:b]):
                if n >= window:
                    spans.append((a + i - window + 1, a + i + 1))
                    found |= self.owners.get(self.above(state), set())
                if state in ends:
                    for k, who in ends[state]:
                        if k <= n:
                            spans.append((a + i - k + 1, a + i + 1))
                            found |= who
        return spans, found


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items of at most block_words words together (an item of more is a block of its own), one block at a time."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = words_of(row[1])
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0] or "", words))
        size += len(words)
    yield block


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, result: T.StructType | None = None) -> DataFrame:
    """row (every column of docs but text), text, n_words, spans (of words hit, sorted, apart) and items (sorted ids).

    Items of more than `block_words` words are several automata, each broadcast. Up to `AT_ONCE` of them work in one pass over
    the texts; then the table so far is written, and the automata are given up, so memory doesn't grow with the items.
    then: turns each batch of the last pass into one of `result` (fields after row), within the same Python worker."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    small_batches(spark)
    held, path = [], None
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    out = docs.select(row, "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    blocks = item_blocks(items, block_words)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        last = then if following is None else None
        if len(held) == AT_ONCE:
            out, later = written_at(out, "hits")
            for old in held:
                old.destroy()
            if path:
                removed(spark, path)
            held, path = [], later
        shared = sc.broadcast(Automaton(block, window))
        held.append(shared)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                n, spans, names = [], [], []
                for text, had, who in zip(batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    words = words_of(text.as_py())
                    got, found = automaton.scan(words)
                    n.append(len(words))
                    spans.append([{"a": a, "b": b} for a, b in united(got + [(x["a"], x["b"]) for x in had])])
                    names.append(sorted({*who, *(automaton.items[k] for k in found)}))
                found = [pa.array(x, batch.column(k).type) for k, x in ((2, n), (3, spans), (4, names))]
                whole = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], batch.schema.names)
                yield last(whole) if last else whole
            trimmed()

        out = out.mapInArrow(run, T.StructType([out.schema["row"], *result.fields]) if last else out.schema)
        block = following
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return hits(docs.select("doc_id", "text"), items, window, block_words).select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text without the words of spans and what stands between them; bounds are on whole words, so UTF-8 stays whole."""
    if text is None or not spans:
        return text
    data = text.encode("utf-8", "replace")
    places = [m.span() for m in WORD_BYTES.finditer(data)]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def decontaminated(docs: DataFrame, items: DataFrame, max_words: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """docs with the spans of max_words hit words or more (or short whole items) cut from the text; a document of which
    more than max_coverage of the words is hit goes. Every column of docs stays."""

    def cleaned(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[(x["a"], x["b"]) for x in s] for s in batch.column(3).to_pylist()]
        text = [cut(t, s) for t, s in zip(batch.column(1).to_pylist(), spans, strict=True)]
        gone = [sum(b - a for a, b in s) > max_coverage * n for s, n in zip(spans, batch.column(2).to_pylist(), strict=True)]
        kept = pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["row", "text"])
        return kept.filter(pa.array([not x for x in gone], pa.bool_()))

    found = hits(docs, items, max_words, then=cleaned, result=T.StructType([T.StructField("text", T.StringType())]))
    return found.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
