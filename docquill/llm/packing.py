"""Packing of token ids into rows of a fixed length: best fit, longest first, by a segment tree over free room.

Each task packs its own documents, in windows of `WINDOW` tokens: a document longer than a row is split into whole rows
and a rest, the pieces of a window are placed longest first, each into the open row with the least room that still
holds it. The segment tree has a leaf for each amount of room and finds that row in log2(row length) steps. Nothing
is shuffled, and a task holds one window.

A packed row has its ids and positions (which start again with each piece) as little-endian matrices' rows, padded to
the row length, the cumulative lengths of its pieces, and for each piece its document and its place in that document.
Every token of every document is in exactly one row.

Defined results: null and empty texts have no tokens and are in no row; equal lengths are placed in order of arrival;
repeated rows are packed as often as they come; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from docquill.llm.bpe import vocabulary
from docquill.llm.common import table

LENGTH, WINDOW, PAD = 2048, 2_000_000, 50256


class Rooms:
    """Open rows by room: a segment tree of counts over 0..length, and the rows at each leaf."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room of at least `least`, taken out; None if there is none."""
        count, at = self.count, least + self.leaves
        while not count[at]:  # up to a tree whose right neighbour has a row, then to that
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, row


def best_fit(sizes: list[int], length: int) -> list[int]:
    """The row of each piece, pieces being placed longest first; no size is above length."""
    rooms, out, rows = Rooms(length), [0] * len(sizes), 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        got = rooms.take(sizes[k])
        if got is None:
            got, rows = (length, rows), rows + 1
        out[k] = got[1]
        if got[0] > sizes[k]:
            rooms.add(got[0] - sizes[k], got[1])
    return out


def packed_window(docs: list[tuple[int | None, np.ndarray]], length: int) -> list[tuple[list[int | None], list[int], list[np.ndarray]]]:
    """For each row: documents, places of the pieces in them, and pieces."""
    pieces = [(doc, at, ids[at : at + length]) for doc, ids in docs for at in range(0, len(ids), length)]
    placed = best_fit([len(p[2]) for p in pieces], length)
    rows: list[tuple[list[int | None], list[int], list[np.ndarray]]] = [([], [], []) for _ in range(max(placed, default=-1) + 1)]
    for (doc, at, ids), row in zip(pieces, placed, strict=True):
        for held, x in zip(rows[row], (doc, at, ids), strict=True):
            held.append(x)
    return rows


PACKED = "part int, row long, n_tokens int, doc_ids array<long>, piece_starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary, digest string"


def tokenizer(path: str, pattern: str):
    import tiktoken

    from docquill.llm.bpe import load_ranks

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def packed(docs: DataFrame, ranks_path: str, pattern: str, length: int = LENGTH, window: int = WINDOW, pad: int = PAD) -> DataFrame:
    """The packed rows: the matrices' rows, and their digest."""
    names = [x.split()[0] for x in PACKED.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, done = tokenizer(ranks_path, pattern).encode_ordinary, TaskContext.get().partitionId(), 0

        def rows(held: list[tuple[int | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            nonlocal done
            out: list[list] = [[] for _ in names]
            for ids_of, starts, pieces in packed_window(held, length):
                sizes = [len(p) for p in pieces]
                n = sum(sizes)
                ids, places = np.full(length, pad, "<u4"), np.zeros(length, "<u4")
                ids[:n] = np.concatenate(pieces)
                places[:n] = np.concatenate([np.arange(s) for s in sizes])
                a, b = ids.tobytes(), places.tobytes()
                one = (part, done, n, ids_of, starts, np.cumsum([0, *sizes]).tolist(), a, b, hashlib.sha256(a + b).hexdigest())
                done += 1
                for column, x in zip(out, one, strict=True):
                    column.append(x)
                if len(out[0]) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

        held, n = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array(encode(text.as_py() or ""), "<u4")
                held.append((doc, ids))
                n += len(ids)
                if n >= window:
                    yield from rows(held)
                    held, n = [], 0
        yield from rows(held)

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def write_packed(docs: DataFrame, path: str, ranks_path: str, pattern: str, length: int = LENGTH) -> None:
    """Packed rows as Parquet at path: ids and positions as fixed-width binary, one row of a matrix each."""
    packed(docs, ranks_path, pattern, length).write.parquet(path)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), *vocabulary()).withColumnRenamed("digest", "matrix_sha256")
