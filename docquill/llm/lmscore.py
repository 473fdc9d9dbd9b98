"""Language-model scores from an Elias-Fano n-gram trie.

A trigram model of three levels, each smoothed by a Dirichlet prior around the one below:
p(w | u v) = (c(u v w) + K p(w | v)) / (c(u v) + K), p(w | v) = (c(v w) + K p(w)) / (c(v) + K), p(w) = (c(w) + 1) / (N + V + 1).
A text is read as `before start w1 ... wn end after`; the three added signs are no tokens.

1. Texts become *blocks* of up to `BLOCK_TOKENS` tokens (a longer text goes on in the next block, with its context).
2. Each block sends its distinct words to shards by hash. A shard sums their counts and numbers its words, frequent ones
   first, so that ids are small and nearly dense. Blocks are written anew with ids and counts.
3. Each block sends its distinct trigrams, as runs of first, second and third words with counts in training texts, to the
   shard of the first word and three hash bits of the second (a word with very many successors is spread over `SLICES`
   shards). A trigram goes out once for each block, however often it occurs.
4. A shard sums the counts and builds its part of the trie as memory-mapped levels: first words, pointers to ranges of
   seconds, these, pointers to ranges of thirds, and these; successors are numbers relative to their context, made monotone
   by the context's offset, all Elias-Fano coded. With them are quantised smoothed probabilities: the n-gram's own part,
   c / (c(context) + K), and for pairs the weight K / (c + K) that they leave to the level below, each a byte (`STEPS` for a
   factor of ten). It answers the blocks' n-grams by successor search in the range of their context, each of them once.
5. Blocks meet their answers again and sum the log probabilities of each text.

Nothing is broadcast; what is gathered follows the input, and a task holds a block or a shard. Requests are a row for each
block and shard, as are the segments of any shuffle. The written blocks are bucketed, so only answers move in step 5.

Defined results: a null or empty text is the end token alone; equal texts get equal scores; an empty table gives an empty
table; a corpus without training rows gives p = 1 / (0 + 0 + 1) for every token; further columns are ignored; rows of one
doc_id, and rows without one, are scored each for itself. doc_ids are longs. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import mmap
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm.common import removed, shared_dir, table, trimmed
from docquill.llm.eliasfano import EliasFano

BLOCK_TOKENS, SHARD_WORDS, SHARD_GRAMS, SLICES = 1_000_000, 2_000_000, 1_500_000, 8
PORTION = 8 << 20  # bytes of texts that are split at once
PRIOR, STEPS = 4.0, 24.0  # K; steps of the quantiser for a factor of ten
BEFORE, START, AFTER, SIGNS = 0, 1, 2, 3  # numbers of the added signs, and of the first word
MIX, BITS = np.uint64(0x9E3779B97F4A7C15), 20  # a block has fewer than 2^20 words


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h * MIX) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def coded(a: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes by significance, so that high ones compress to nothing."""
    width = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
    flat = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.ZstdCompressor(level=3).compress(bytes((width,)) + flat.T.tobytes())


def decoded(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out = np.zeros(((len(flat) - 1) // int(flat[0]), 8), np.uint8)
    out[:, : int(flat[0])] = flat[1:].reshape(int(flat[0]), len(out)).T
    return out.view("<i8").reshape(-1)


def steps_of(a: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, the first from 0."""
    return np.diff(a, prepend=a.dtype.type(0))


def words_of(texts: pa.Array) -> pa.ListArray:
    """The lower-cased words of each text, and an empty one for its end."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ended = pc.binary_join_element_wise(trimmed, pa.scalar("", trimmed.type), pa.scalar(" ", trimmed.type))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, pa.scalar("", trimmed.type)), trimmed, ended))


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in portions of `PORTION` bytes of text and at most one text more, as each is held several times over."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.nonzero(np.diff((np.cumsum(sizes) - sizes) // PORTION, prepend=-1))[0].tolist()
    for begin, end in zip(starts, [*starts, batch.num_rows][1:], strict=True):
        yield batch.slice(begin, end - begin)


def hashed(words: pa.Array) -> np.ndarray:
    """A hash for each word, made once for equal ones."""
    seen = words.dictionary_encode()
    hashes = map(xxhash.xxh64_intdigest, seen.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False))
    return np.fromiter(hashes, np.uint64, len(seen.dictionary))[seen.indices.to_numpy()]


BLOCK = "block long, rows array<long>, doc_ids array<long>, held array<boolean>, sizes binary, last binary, vocabulary binary, word_counts binary, tokens binary, n_words long, n_grams long"
PIECES = "block", "rows", "doc_ids", "held", "sizes", "last"


def types(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def batch_of(ddl: str, columns: list[list]) -> pa.RecordBatch:
    schema = types(ddl)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)


def blocks_of(docs: DataFrame, tokens: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, row, room = TaskContext.get().partitionId(), 0, 0, tokens
        pieces: list[tuple] = []  # row, doc_id, held, tokens, whether it ends the text, signs before it
        parts: list[np.ndarray] = []  # hashes of two tokens before a piece, its own and one after it, as far as there are

        def block() -> pa.RecordBatch:
            nonlocal made, pieces, parts, room
            known, found = np.unique(np.concatenate(parts), return_inverse=True)
            rows, ids, held, sizes, last, signs = (list(x) for x in zip(*pieces, strict=True))
            n, signs, lengths = np.array(sizes), np.array(signs), np.array([len(x) for x in parts])
            begins = np.cumsum(n + 3) - (n + 3)
            flat = np.full(int(n.sum()) + 3 * len(n), AFTER, np.int64)
            flat[begins[signs == 2]] = BEFORE
            flat[(begins + signs - 1)[signs > 0]] = START
            flat[np.repeat(begins + signs - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())] = found + SIGNS
            own = Pieces(flat, n, np.array(held), np.array(last))
            counts = np.bincount(flat[own.thirds][own.train_tokens] - SIGNS, minlength=len(known))
            out = [(part << 24) + made, rows, ids, held, coded(n), coded(np.array(last)), coded(steps_of(known)), coded(counts), coded(flat), len(known), len(flat)]
            made, pieces, parts, room = made + 1, [], [], tokens
            return batch_of(BLOCK, [[x] for x in out])

        for batch in (x for b in batches for x in portions(b)):
            words = words_of(batch.column(1))
            hashes, bounds = hashed(words.values), words.offsets.to_pylist()
            del words
            for k, (doc_id, held) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                at, begin, end = 0, bounds[k], bounds[k + 1]
                while begin + at < end:
                    n = min(room, end - begin - at)
                    last = begin + at + n == end
                    parts.append(hashes[begin + max(0, at - 2) : begin + at + n + (not last)])
                    pieces.append(((part << 40) + row, doc_id, held, n, last, max(0, 2 - at)))
                    at, room = at + n, room - n
                    if not room:
                        yield block()
                row += 1
        if pieces:
            yield block()
        trimmed()

    return docs.select("doc_id", "text", held_out().alias("held")).mapInArrow(run, BLOCK)


class Pieces:
    """Places in a block's row of tokens, of which each piece has three more than its own."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, held: np.ndarray, last: np.ndarray) -> None:
        self.sizes, self.begins = sizes, np.cumsum(sizes + 3) - (sizes + 3)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(self.owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.firsts = self.begins[self.owner] + within  # of the trigram that ends with a token of the piece
        self.thirds = self.firsts + 2
        self.train_tokens = ~held[self.owner]
        # Trigrams: those that end with a token, and one more for each piece, which counts if the text ends there.
        self.places = np.concatenate((self.firsts, self.begins + sizes))
        self.counted = np.concatenate((self.train_tokens, ~held & last))


def words_asked(blocks: DataFrame, shards: int) -> DataFrame:
    ddl = "shard int, block long, words binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = np.cumsum(decoded(row["vocabulary"]).view(np.uint64)), decoded(row["word_counts"])
                own = shard_of(words, shards)
                for s in np.unique(own):
                    yield batch_of(ddl, [[int(s)], [row["block"]], [coded(steps_of(words[own == s]))], [coded(counts[own == s])]])

    return blocks.select("block", "vocabulary", "word_counts").mapInArrow(run, ddl)


NUMBERED = "shard int, block long, ids binary, counts binary, train_tokens long, train_words long"


def words_numbered(shards: int):
    def run(got: pa.Table) -> pa.Table:
        """For each block the ids and counts of its words, in its order."""
        rows = got.to_pylist()
        words = [np.cumsum(decoded(r["words"]).view(np.uint64)) for r in rows]
        known, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([decoded(r["counts"]) for r in rows]), len(known)).astype(np.int64)
        ids = np.empty(len(known), np.int64)
        ids[np.lexsort((known, -total))] = np.arange(len(known)) * shards + rows[0]["shard"] + SIGNS
        parts = np.split(inverse, np.cumsum([len(w) for w in words])[:-1])
        n, v = [0] * len(rows), [0] * len(rows)
        n[0], v[0] = int(total.sum()), int((total > 0).sum())
        return pa.Table.from_batches([batch_of(NUMBERED, [[r["shard"] for r in rows], [r["block"] for r in rows], [coded(ids[p]) for p in parts], [coded(total[p]) for p in parts], n, v])])

    return run


NUMBERED_BLOCK = "block long, rows array<long>, doc_ids array<long>, held array<boolean>, sizes binary, last binary, ids binary, counts binary, tokens binary"


def blocks_numbered(blocks: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """Blocks with the ids and counts of their words, ascending, and tokens as places among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                own = shard_of(np.cumsum(decoded(row["vocabulary"]).view(np.uint64)), shards)
                ids, counts = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                for a in row["answers"]:
                    ids[own == a["shard"]], counts[own == a["shard"]] = decoded(a["ids"]), decoded(a["counts"])
                order = np.argsort(ids)
                number = np.arange(len(ids) + SIGNS)
                number[order + SIGNS] = np.arange(len(ids)) + SIGNS
                out = [row[c] for c in PIECES] + [coded(steps_of(ids[order])), coded(counts[order]), coded(number[decoded(row["tokens"])])]
                yield batch_of(NUMBERED_BLOCK, [[x] for x in out])

    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "ids", "counts")).alias("answers"))  # as many as shards, whatever the block
    return blocks.join(gathered, "block").select(*PIECES, "vocabulary", "tokens", "answers").mapInArrow(run, NUMBERED_BLOCK)


class Block:
    """The distinct trigrams of a block and the pairs they begin with, in an order that its row decides: both request and
    answer follow it."""

    def __init__(self, row: dict, starts: int, shards: int) -> None:
        self.ids = np.concatenate((np.arange(SIGNS), np.cumsum(decoded(row["ids"]))))
        self.counts = np.concatenate(([starts, starts, 0], decoded(row["counts"])))
        self.tokens = decoded(row["tokens"])
        self.pieces = Pieces(self.tokens, decoded(row["sizes"]), np.array(row["held"], bool), decoded(row["last"]).astype(bool))
        at, x = self.pieces.places, self.tokens
        self.keys = (x[at] << 2 * BITS) | (x[at + 1] << BITS) | x[at + 2]
        self.order = np.argsort(self.keys)
        ascending = self.keys[self.order]
        self.cuts = np.nonzero(np.diff(ascending, prepend=-1))[0]
        self.grams = ascending[self.cuts]
        self.heads = np.nonzero(np.diff(self.grams >> BITS, prepend=-1))[0]  # where pairs begin
        self.pairs = self.grams[self.heads] >> BITS
        self.runs = np.diff(self.heads, append=len(self.grams))
        mask = (1 << BITS) - 1
        self.first, self.second, self.third = self.pairs >> BITS, self.pairs & mask, self.grams & mask
        u, v = self.ids[self.first].astype(np.uint64), self.ids[self.second].astype(np.uint64)
        slices = ((v * MIX) >> np.uint64(50)) % np.uint64(SLICES)
        self.shard = shard_of((u * np.uint64(SLICES) + slices) * MIX, shards)
        order = np.argsort(self.shard.astype(np.min_scalar_type(shards)), kind="stable")
        self.by_shard = np.split(order, np.searchsorted(self.shard[order], np.arange(1, shards)))

    def gram_counts(self) -> np.ndarray:
        return np.add.reduceat(self.pieces.counted[self.order].astype(np.int64), self.cuts)

    def grams_at(self) -> np.ndarray:
        """The number of the trigram at each of the places that `pieces` has."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(np.arange(len(self.cuts)), np.diff(self.cuts, append=len(self.order)))
        return out

    def grams_of(self, pairs: np.ndarray) -> np.ndarray:
        runs = self.runs[pairs]
        return np.repeat(self.heads[pairs] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())


ASKED = "shard int, block long, firsts binary, first_counts binary, first_runs binary, seconds binary, runs binary, thirds binary, counts binary"


def grams_asked(blocks: DataFrame, starts: int, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                b = Block(row, starts, shards)
                counts = b.gram_counts()
                for shard, pairs in enumerate(b.by_shard):
                    if len(pairs):
                        first, grams = b.first[pairs], b.grams_of(pairs)
                        at = np.nonzero(np.diff(first, prepend=-1))[0]
                        sent = steps_of(b.ids[first[at]]), b.counts[first[at]], np.diff(at, append=len(pairs)), b.ids[b.second[pairs]], b.runs[pairs], b.ids[b.third[grams]], counts[grams]
                        yield batch_of(ASKED, [[shard], [row["block"]], *[[coded(x)] for x in sent]])
                del b, counts
        trimmed()

    return blocks.mapInArrow(run, ASKED)


def quantised(share: np.ndarray) -> np.ndarray:
    """A byte for a number in (0, 1]; 0 stands for none."""
    return np.clip(1 + np.rint(-STEPS * np.log10(share)), 1, 255).astype(np.uint8)


VALUES = np.concatenate(([0.0], 10 ** (-np.arange(255) / STEPS)))  # by byte


class Levels:
    """A shard's part of the trie in one memory map."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, counts: np.ndarray, context: np.ndarray) -> None:
        """u, v, w: distinct trigrams, sorted; counts: theirs, above 0; context: the count of u, for each."""
        new_u = np.diff(u, prepend=-1) != 0
        new = new_u | (np.diff(v, prepend=-1) != 0)
        pair_at = np.nonzero(new)[0]
        first_at = np.nonzero(new_u[pair_at])[0]
        n, self.size = len(u), int(max(v.max(initial=0), w.max(initial=0))) + 1
        first_of, pair_of = np.cumsum(new_u[pair_at]) - 1, np.cumsum(new) - 1
        pair_counts = np.add.reduceat(counts, pair_at) if n else counts
        built = [
            EliasFano.build(u[pair_at][first_at], int(u.max(initial=0)) + 1),
            EliasFano.build(np.append(first_at, len(pair_at)), len(pair_at) + 1),
            EliasFano.build(first_of * self.size + v[pair_at], max(1, len(first_at)) * self.size),
            EliasFano.build(np.append(pair_at, n), n + 1),
            EliasFano.build(pair_of * self.size + w, max(1, len(pair_at)) * self.size),
        ]
        del first_of, new, new_u
        own = [quantised(pair_counts / (context[pair_at] + PRIOR)), quantised(PRIOR / (pair_counts + PRIOR)), quantised(counts / (pair_counts[pair_of] + PRIOR))]
        arrays = [a for e in built for a in e.arrays()] + own
        places = np.cumsum([0, *(-(-a.nbytes // 8) * 8 for a in arrays)]).tolist()
        flat = np.frombuffer(mmap.mmap(-1, places[-1] + 8), np.uint8)
        mapped = [flat[p : p + a.nbytes].view(a.dtype) for p, a in zip(places[:-1], arrays, strict=True)]
        for to, a in zip(mapped, arrays, strict=True):
            to[:] = a
        self.firsts, self.first_ranges, self.seconds, self.pair_ranges, self.thirds = (EliasFano(e.n, e.width, *mapped[4 * i : 4 * i + 4]) for i, e in enumerate(built))
        self.pair_codes, self.weights, self.gram_codes = mapped[20:]

    def successors(self, level: EliasFano, ranges: EliasFano, context: np.ndarray, runs: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of words, a run for each context (a number, or -1), among its successors, or -1: a word relative to its
        context is sought at the context's offset, and must lie in the range that the context's pointers give."""
        out = np.full(len(word), -1, np.int64)
        there = np.nonzero(context >= 0)[0]
        begin, end = np.zeros(len(context), np.uint64), np.zeros(len(context), np.uint64)
        begin[there], end[there] = ranges.get(context[there]), ranges.get(context[there] + 1)
        of = np.repeat(np.arange(len(context)), runs)
        ok = np.nonzero((context[of] >= 0) & (word < self.size))[0]
        of = of[ok]
        place = level.find((context[of] * self.size + word[ok]).astype(np.uint64))
        inside = (place >= begin[of].astype(np.int64)) & (place < end[of].astype(np.int64))
        out[ok[inside]] = place[inside]
        return out

    def codes(self, u: np.ndarray, first_runs: np.ndarray, v: np.ndarray, runs: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the pairs, of the weights they leave, and of the trigrams."""
        first = self.firsts.find(u.astype(np.uint64))
        pair = self.successors(self.seconds, self.first_ranges, first, first_runs, v)
        gram = self.successors(self.thirds, self.pair_ranges, pair, runs, w)
        return tuple(np.where(i >= 0, x[np.maximum(i, 0)] if len(x) else 0, 0).astype(np.uint8) for i, x in ((pair, self.pair_codes), (pair, self.weights), (gram, self.gram_codes)))


ANSWER = "shard int, block long, pairs binary, weights binary, grams binary"


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, ascending, and for each of a the place of its own among them."""
    order = np.argsort(a).astype(np.min_scalar_type(len(a)))
    ascending = a[order]
    new = np.diff(ascending, prepend=-1) != 0
    at = np.empty(len(a), order.dtype)
    at[order] = np.cumsum(new, dtype=order.dtype) - order.dtype.type(1)
    return ascending[new], at


def grams_answered(got: pa.Table) -> pa.Table:
    """A shard's answers: for each block the bytes of its pairs and trigrams, in its order. What several blocks ask is sought
    once, in ascending order."""
    rows = got.to_pylist()

    def asked(field: str, of=lambda x: x) -> tuple[np.ndarray, np.ndarray]:
        """A field of all blocks, and where those after the first begin."""
        parts = [of(decoded(r.pop(field))) for r in rows]
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])[:-1]

    (u, _), (context, _), (v, pair_cuts), (w, gram_cuts) = asked("firsts", np.cumsum), asked("first_counts"), asked("seconds"), asked("thirds")
    size = int(max(v.max(initial=0), w.max(initial=0))) + 1
    u, first_at = np.unique(u, return_inverse=True)
    contexts = np.zeros(len(u), np.int64)
    contexts[first_at] = context
    v += np.repeat(first_at, asked("first_runs")[0]) * size
    del first_at, context
    pairs, pair_at = distinct(v)
    w += np.repeat(pair_at, asked("runs")[0]).astype(np.int64) * size
    del v
    grams, gram_at = distinct(w)
    del w
    counts = np.bincount(gram_at, asked("counts")[0], len(grams)).astype(np.int64)
    first_of, v = np.divmod(pairs, size)
    pair_of, w = np.divmod(grams, size)
    del pairs, grams
    known = np.nonzero(counts)[0]
    pair, counts = pair_of[known], counts[known]
    first = first_of[pair]
    levels = Levels(u[first], v[pair], w[known], counts, contexts[first])
    del known, pair, first, counts
    pair_codes, weights, gram_codes = levels.codes(u, np.bincount(first_of, minlength=len(u)), v, np.bincount(pair_of, minlength=len(v)), w)
    del first_of, pair_of, u, v, w, levels
    sent = np.split(pair_codes[pair_at], pair_cuts), np.split(weights[pair_at], pair_cuts), np.split(gram_codes[gram_at], gram_cuts)
    out = pa.Table.from_batches([batch_of(ANSWER, [[r["shard"] for r in rows], [r["block"] for r in rows], *[[zstandard.compress(x.tobytes(), 3) for x in xs] for xs in sent]])])
    del rows, sent, pair_at, gram_at
    trimmed()
    return out


SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def summed(blocks: DataFrame, answers: DataFrame, starts: int, shards: int, below: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                b = Block(row, starts, shards)
                pair_codes, weights, gram_codes = np.zeros(len(b.pairs), np.uint8), np.zeros(len(b.pairs), np.uint8), np.zeros(len(b.grams), np.uint8)
                for a in row["answers"]:
                    own = b.by_shard[a["shard"]]
                    got = [np.frombuffer(zstandard.decompress(a[f]), np.uint8) for f in ("pairs", "weights", "grams")]
                    pair_codes[own], weights[own], gram_codes[b.grams_of(own)] = got
                word, first = b.tokens[b.pieces.thirds], b.tokens[b.pieces.firsts + 1]
                grams = b.grams_at()
                pair_at = np.empty(len(b.tokens), np.int64)  # the pair that begins at a place
                pair_at[b.pieces.places] = np.repeat(np.arange(len(b.pairs)), b.runs)[grams]
                context, pair = pair_at[b.pieces.firsts], pair_at[b.pieces.firsts + 1]
                base = (b.counts + 1) / below
                two = VALUES[pair_codes[pair]] + (PRIOR / (b.counts + PRIOR))[first] * base[word]
                three = VALUES[gram_codes[grams[: len(word)]]] + np.where(weights == 0, 1.0, VALUES[weights])[context] * two
                cuts = np.cumsum(b.pieces.sizes) - b.pieces.sizes
                sums = [np.add.reduceat(x, cuts) for x in ((b.counts > 0)[word].astype(np.int64), np.log10(base)[word], np.log10(np.minimum(1.0, three)))]
                yield batch_of(SCORES, [row["rows"], row["doc_ids"], row["held"], b.pieces.sizes, *sums])
                del b, word, first, grams, pair_at, context, pair, two, three
        trimmed()

    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "pairs", "weights", "grams")).alias("answers"))  # as many as shards, whatever the block
    return blocks.join(gathered, "block").select(*types(NUMBERED_BLOCK).names, "answers").mapInArrow(run, SCORES)


def kept(df: DataFrame, ddl: str, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "none").parquet(path)  # its columns are compressed already
    return spark.read.schema(ddl).parquet(path), path


def bucketed(df: DataFrame, name: str) -> DataFrame:
    """df in the shared folder, in buckets by block: a join on block doesn't move it."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", f"{shared_dir(spark).rstrip('/')}/{name}").option("compression", "none").bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


def scored(docs: DataFrame, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    raw, raw_path = kept(blocks_of(docs.select("doc_id", "text"), min(tokens, (1 << BITS) - 8)), BLOCK, "blocks")
    starts = F.aggregate(F.arrays_zip("rows", "held"), F.lit(0).cast("long"), lambda s, x: s + F.when(x["held"], 0).otherwise(1))
    ended = raw.select("n_words", "n_grams", starts.alias("starts"), F.size("rows").alias("pieces"))
    n_words, n_grams = (int(x or 0) for x in ended.agg(F.sum("n_words"), F.sum("n_grams")).first())
    word_shards, shards = max(4, -(-n_words // SHARD_WORDS)), max(8, -(-n_grams // SHARD_GRAMS))
    numbered, numbered_path = kept(words_asked(raw, word_shards).groupBy("shard").applyInArrow(words_numbered(word_shards), NUMBERED), NUMBERED, "words")
    n, v = (int(x or 0) for x in numbered.agg(F.sum("train_tokens"), F.sum("train_words")).first())
    train = int(docs.where(~held_out()).count())
    blocks = bucketed(blocks_numbered(raw, numbered, word_shards), "blocks")
    for path in (raw_path, numbered_path):
        removed(spark, path)
    answers, _ = kept(grams_asked(blocks, train, shards).groupBy("shard").applyInArrow(grams_answered, ANSWER), ANSWER, "answers")
    parts = summed(blocks, answers, train, shards, float(n + (v + 1)))
    out = parts.groupBy("row", "doc_id", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
