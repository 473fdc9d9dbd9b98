"""Byte-level BPE as a lazily determinised transducer, and streaming decoding by an incremental UTF-8 machine.

A BPE encoding is the one token sequence whose neighbours are all *stable*: no merge across the border of two neighbours
comes before those within them. So a text can be read left to right. While bytes arrive, each earlier boundary from which the bytes
read since are still the start of some token is an open hypothesis; a token is emitted as soon as all open hypotheses
share it. The bytes that are pending and those parts at the right edge of the last emitted token that could still merge
with them decide everything that follows, so this pair is the state: transitions are worked out when first met and kept, which determinises the machine as far as texts need it. Edges count
only while a token may start there, and a text's last byte emits without entering a state. The
pending bytes (the lookahead) never exceed a few token lengths.

Each match of the split pattern is encoded on its own. Results of whole matches are kept as packed ids, in two generations
of `PIECES`; the machine has `STATES` states and starts afresh when full. So a task's tables stay within some 100 MB
whatever the texts are.

Defined results: a null text is an empty one, with no tokens; very long matches (a megabyte of one letter) take time in
proportion; rows are independent, so ties, repeated rows and further columns change nothing.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquill.llm.common import small_batches, table, trimmed

STATES, PIECES, ROWS = 80_000, 120_000, 256
NO_MOVES: dict = {}  # of states that no text has left yet; never written to

PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
BYTES = [bytes((b,)) for b in range(256)]

Edge = tuple[tuple[bytes, int, int, int], ...]  # parts, the ranks at which each comes and goes, and its node in the trie
Boundary = tuple[int, int, "Boundary | None", int]  # its place, the token that ends there, the boundary before, the number of the token's right edge


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """States are (what of the last emitted token can still merge, pending bytes); see the module's text."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES) -> None:
        self.ranks, self.limit = ranks, states
        self.tokens = {i: t for t, i in ranks.items()}
        nodes = {b"": 0}  # the trie of all tokens' starts
        for t in ranks:
            for n in range(1, len(t) + 1):
                nodes.setdefault(t[:n], len(nodes))
        self.child = {nodes[x[:-1]] << 8 | x[-1]: k for x, k in nodes.items() if x}
        self.token = [ranks.get(x, -1) for x in nodes]  # by node
        self.more = bytearray(len(nodes))  # by node, whether it is the start of longer tokens
        for k in self.child:
            self.more[k >> 8] = 1
        self.spines: dict[int, tuple[Edge, Edge] | None] = {}
        self.clear()

    def clear(self) -> None:
        self.edges: list[Edge] = []  # states and tables have the numbers of edges, as tuples of tuples are slow keys
        self.edge_number: dict[Edge, int] = {}
        self.right: dict[int, int] = {}  # the number of a token's right edge
        self.number: dict[tuple[int, bytes], int] = {}
        self.state: list[tuple[tuple[int, bytes], int, tuple[tuple[int, Boundary], ...], Boundary]] = []  # what it is, where its pending bytes start, the open boundaries with the node that the bytes since have reached, and the boundary at the end
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.ends: dict[int, tuple[int, ...]] = {}  # by state and byte, what is emitted if that byte is the last; such bytes lead to no state
        self.stable: dict[int, bool] = {}
        self.enter((self.numbered(()), b""), 0, (), (0, -1, None, 0))

    def numbered(self, edge: Edge) -> int:
        at = self.edge_number.setdefault(edge, len(self.edges))
        if at == len(self.edges):
            self.edges.append(edge)
        return at

    def right_of(self, token: int) -> int:
        at = self.right.get(token)
        if at is None:
            at = self.right[token] = self.numbered(self.spine(token)[1])
        return at

    def enter(self, key: tuple[int, bytes], start: int, open_: tuple[tuple[int, Boundary], ...], end: Boundary) -> int:
        at = self.number.setdefault(key, len(self.state))
        if at == len(self.state):
            self.state.append((key, start, open_, end))
            self.moves.append(NO_MOVES)
        return at

    def renew(self, at: int) -> int:
        """Clears all tables but for one state, whose boundaries no longer hold those before it."""
        (edge, pending), start, open_, end = self.state[at]
        parts, made = self.edges[edge], {}

        def copied(b: Boundary) -> Boundary:
            way = []
            while b[0] != start and b[0] not in made:
                way.append(b)
                b = b[2]
            for x in (*([b] if b[0] not in made else []), *reversed(way)):
                made[x[0]] = (start, -1, None, edge) if x[0] == start else (x[0], x[1], made[x[2][0]], self.right_of(x[1]))
            return made[(way[0] if way else b)[0]]

        self.clear()
        edge = self.numbered(parts)
        return self.enter((edge, pending), start, tuple((node, copied(b)) for node, b in open_), copied(end))

    def merged(self, data: bytes) -> tuple[list[bytes], list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """Plain merging, lowest rank first and leftmost among equals: the parts at last, and those that stood at the
        left and at the right edge meanwhile, with the rank that made each. Used on single tokens only."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        left, right = [(parts[0], -1)], [(parts[-1], -1)]
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                left.append((parts[0], best))
            if at == len(parts) - 1:
                right.append((parts[-1], best))
        return parts, left, right

    def node(self, start: bytes) -> int:
        at = 0
        for byte in start:
            at = self.child[at << 8 | byte]
        return at

    def spine(self, token: int) -> tuple[Edge, Edge] | None:
        """The parts at the left and at the right edge while a token is being merged, each with the ranks at which it
        comes and goes; None if merging doesn't make the token."""
        if token not in self.spines:
            parts, *edges = self.merged(self.tokens[token])
            timed = [tuple((x, r, rows[k + 1][1] if k + 1 < len(rows) else 1 << 60, self.node(x)) for k, (x, r) in enumerate(rows)) for rows in edges]
            self.spines[token] = (timed[0], timed[1]) if len(parts) == 1 else None
        return self.spines[token]

    def fits(self, edge: Edge, token: int) -> bool:
        """Whether the token may follow one with that right edge: no merge across the border comes before the parts at
        it are used up. Among equal ranks the leftmost merge is first, so one before the border wins, one after loses."""
        own = self.spines[token] if token in self.spines else self.spine(token)
        if own is None:
            return False
        rank, child, first = self.ranks.get, self.child, self.tokens[token][0]
        for x, came_x, gone_x, node in edge:
            if node << 8 | first not in child:
                continue
            for y, came_y, gone_y, _ in own[0]:
                if came_y >= gone_x:  # the parts come in order, so no later one meets x either
                    break
                if gone_y > came_x:
                    r = rank(x + y)
                    if r is not None and came_x < r < gone_x and came_y < r <= gone_y:
                        return False
        return True

    def narrowed(self, edge: int, pending: bytes) -> int:
        """The parts of the edge that can still merge with what follows: those that with the pending bytes start a
        token, or with some of them are one that comes in time."""
        parts = self.edges[edge]
        if not parts:
            return edge
        child, token, kept = self.child.get, self.token, []
        for part in parts:
            _, came, gone, at = part
            for byte in pending:
                at = child(at << 8 | byte)
                if at is None:
                    break
                if came < token[at] < gone:
                    kept.append(part)
                    break
            else:
                if self.more[at]:
                    kept.append(part)
        return edge if len(kept) == len(parts) else self.numbered(tuple(kept))

    def move(self, at: int, byte: int) -> tuple[int, tuple[int, ...]]:
        (edge, pending), start, open_, end = self.state[at]
        pending += BYTES[byte]
        child, token, more, stable, right, found, still = self.child.get, self.token, self.more, self.stable, self.right.get, None, []
        for node, left in (*open_, (0, end)):
            node = child(node << 8 | byte)
            if node is None:
                continue
            if found is None and (t := token[node]) >= 0:
                key = left[3] << 32 | t
                ok = stable.get(key)
                if ok is None:
                    ok = stable[key] = self.fits(self.edges[left[3]], t)
                if ok:
                    at_right = right(t)
                    found = (end[0] + 1, t, left, self.right_of(t) if at_right is None else at_right)
            if more[node]:
                still.append((node, left))
        if found is None:
            raise ValueError("the ranks don't cover every byte")
        cut = found  # the last boundary that all hypotheses share: the start, if that is open
        if still:
            if still[0][1][0] == start:
                cut = still[0][1]
            else:
                for _, other in still:
                    while cut[0] != other[0]:
                        if cut[0] > other[0]:
                            cut = cut[2]
                        else:
                            other = other[2]
        out = ()
        if cut[0] != start:
            pending = pending[cut[0] - start :]
            ids, step = [], cut
            while step[0] != start:
                ids.append(step[1])
                step = step[2]
            out = tuple(reversed(ids))
            start, edge = cut[0], cut[3]
        if not still:
            found = (start, -1, None, edge)
        elif still[0][1][0] == start:
            edge = self.narrowed(edge, pending)
            if still[0][1][3] != edge or still[0][1][2]:
                still[0] = (still[0][0], (start, -1, None, edge))
        else:
            edge = 0  # no token starts there any more, so what is left of it doesn't matter
        got = (self.enter((edge, pending), start, tuple(still), found), out)
        if self.moves[at] is NO_MOVES:
            self.moves[at] = {byte: got}
        else:
            self.moves[at][byte] = got
        return got

    def end(self, at: int, byte: int) -> tuple[int, ...]:
        """What is emitted if the text ends with this byte."""
        _, start, open_, step = self.state[at]
        child, token, stable = self.child.get, self.token, self.stable
        for node, left in (*open_, (0, step)):
            node = child(node << 8 | byte)
            if node is None or (t := token[node]) < 0:
                continue
            key = left[3] << 32 | t
            ok = stable.get(key)
            if ok is None:
                ok = stable[key] = self.fits(self.edges[left[3]], t)
            if ok:
                break
        else:
            raise ValueError("the ranks don't cover every byte")
        out = [t]
        while left[0] != start:
            out.append(left[1])
            left = left[2]
        got = self.ends[at << 8 | byte] = tuple(reversed(out))
        return got

    def encode(self, data: bytes) -> list[int]:
        if (one := self.ranks.get(data)) is not None:
            return [one]
        if not data:
            return []
        if len(self.state) > self.limit:
            self.clear()
        elif len(self.ends) > 2 * self.limit:
            self.ends.clear()
        moves, at, out = self.moves, 0, []
        for byte in data[:-1]:
            got = moves[at].get(byte)
            if got is None:
                got = self.move(at, byte)
                if len(self.state) > 2 * self.limit:  # within one very long match
                    got = (self.renew(got[0]), got[1])
                    moves = self.moves
            at = got[0]
            if got[1]:
                out += got[1]
        end = self.ends.get(at << 8 | data[-1])
        out += self.end(at, data[-1]) if end is None else end
        return out


class Encoder(dict):
    """Packed little-endian ids of a match of the pattern, by the match."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int = PIECES, states: int = STATES) -> None:
        super().__init__()
        self.machine, self.split, self.limit = Transducer(ranks, states), regex.compile(pattern).findall, pieces
        self.old: dict[str, bytes] = {}  # the generation before, whose members come back when asked for

    def __missing__(self, piece: str) -> bytes:
        out = self.old.pop(piece, None)
        if out is None:
            ids = self.machine.encode(piece.encode("utf-8", "replace"))
            out = PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) < 100:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out

    def packed(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text or "")))


class Utf8Stream:
    """Incremental decoding of ids: `feed` gives the bytes of the characters that an id completes. The machine's state
    is the bytes of the character that is open; steps by (state, id) are worked out when first met."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.opens = np.array([bool(self.advance(b"", t)[0]) for t in tokens])  # tokens that leave a character open where none was
        self.steps: dict[bytes, dict[int, tuple[bytes, bytes]]] = {}
        self.open = b""

    @staticmethod
    def advance(held: bytes, data: bytes) -> tuple[bytes, bytes]:
        """(bytes still open, bytes of whole characters; a byte that can't continue goes out as it is)."""
        data = held + data
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            return (data[-back:], data[:-back]) if need > back else (b"", data)
        return b"", data

    def step(self, held: bytes, token: int) -> tuple[bytes, bytes]:
        own = self.steps.setdefault(held, {})
        if token not in own:
            if sum(map(len, self.steps.values())) > 1_000_000:
                self.steps = {}
                own = self.steps.setdefault(held, {})
            own[token] = self.advance(held, self.tokens[token])
        return own[token]

    def feed(self, token: int) -> bytes:
        self.open, out = self.step(self.open, token)
        return out

    def finish(self) -> bytes:
        out, self.open = self.open, b""
        return out

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        ids = np.asarray(ids, np.uint32)
        opening, ids = np.flatnonzero(self.opens[ids]), ids.tolist()
        out, held, at = list(map(self.tokens.__getitem__, ids)), b"", 0
        for first in opening.tolist():  # from such a token on the machine goes step by step, until no character is open
            if first < at:
                continue
            at = first
            while at < len(ids):
                held, out[at] = self.step(held, ids[at])
                at += 1
                if not held:
                    break
        out.append(held)
        return b"".join(out)


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        out[i] = t
    return out


def encoded(docs: DataFrame, ranks_path: str, pattern: str, keep: bool = True) -> DataFrame:
    """Every column of docs (text only if keep), n_tokens, ids (little-endian unsigned 32-bit), decoded_sha256, same.

    ids decode to the text's bytes if same. The rank file is read on the executors: it is part of an installed package,
    not of the machine's temporary files.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    src = docs.select(row, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        coder, stream = Encoder(ranks, pattern), Utf8Stream(token_table(ranks))
        gc.disable()  # the tables hold no cycles, and looking for some costs a fifth of the time
        try:
            for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
                n, ids, sha, same = [], [], [], []
                for text in batch.column(1):
                    text = text.as_py()
                    packed = coder.packed(text)
                    back = stream.decode(np.frombuffer(packed, "<u4"))
                    n.append(len(packed) // 4)
                    ids.append(packed)
                    sha.append(hashlib.sha256(back).hexdigest())
                    same.append(back == (text or "").encode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0), *([batch.column(1)] if keep else []), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sha), pa.array(same)], [f.name for f in schema.fields])
        finally:
            gc.enable()
            coder.clear()
            del coder, stream, ranks
            trimmed()

    found = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("same", T.BooleanType())]
    schema = T.StructType([src.schema["row"], *([T.StructField("text", T.StringType())] if keep else []), *found])
    small_batches(docs.sparkSession)
    return src.mapInArrow(run, schema)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary(), keep=False)
    return out.select("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")
