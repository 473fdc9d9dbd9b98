"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is 64 majority bits over the XXH64 of a text's word shingles. Two fingerprints at Hamming distance 3 or
less agree in at least `BLOCKS - 3` of `BLOCKS` bit blocks, so every close pair meets under one of the keys made of
`BLOCKS - 3` blocks. Keys are made of distinct fingerprints only (copies meet in one aggregate before that), lonely
keys are dropped by count, and a key with many fingerprints is split by further blocks of its free bits. A task
emits a spanning forest of a key's close pairs, never all pairs; components are then joined up by `components`.

Defined results: a null or empty text, or one without words, has fingerprint 0 and links like any other; ties and
repeated rows share a fingerprint; an empty table gives an empty table; further columns of the input are ignored;
rows with a null doc_id keep their fingerprint, and their component is the smallest doc_id reachable, if any.

`similar` groups by similarity of the texts themselves: documents are linked whose sets of word shingles have a Jaccard
similarity of `similarity` or more, and a group is a component of these links. Fingerprints that meet in the blocks give
the first candidates. But no bound on the bits of a 64-bit fingerprint holds all such pairs (at 0.8 some 10 bits differ),
so the rest come from prefixes: under any fixed order of shingles, two sets that alike share one of the first
n - ceil(similarity * n) + 1 of each. Common shingles come last in the order, so few unrelated texts meet. Two bounds that
never lose a pair leave out most candidates: places and sizes of the sets, then bitmaps of ranges of the hash, a short one
that goes with a node's keys and one for each pair (`sketch`); what is left is compared on whole sets. Within a key, documents first meet a
few others in turns, then those of other components, so a large group of near copies is linked before it is compared in pairs. Shingles are their XXH64.

doc_ids are longs. `deduplicated` tells rows apart by doc_id and text: rows of one doc_id with unlike texts are documents of
their own, equal rows are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquill.llm.common import LOWER, components, small_batches, table, trimmed, written

SHINGLE, SEED, DISTANCE = 3, 42, 3
BLOCKS = (13, 13, 13, 13, 12)
BRUTE = 1024  # fingerprints that a task compares pair by pair
HOT, SPLITS = 50_000, 4  # fingerprints under one key beyond which the key is split; how often that is needed at most
# Of similar, none of which touches the result: turns in which a node meets a few others, and how many; shingles that a task counts at a time; the count from which a shingle is
# common, and how many of these are told apart; sets that a task remembers; bits of a sketch for each member, and the power of
# two of the bits that go with keys; links between groups that one task joins up, more go in rounds.
RINGS, NEAR, COUNTED, COMMON, MOST_COMMON, REMEMBERED, PER_MEMBER, SHORT_BITS, FEW = 3, 16, 1 << 20, 32, 200_000, 1 << 20, 2, 9, 1 << 17
SHORT = [f"s{i}" for i in range(1 << SHORT_BITS >> 6)]


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(flat, SEED)], np.uint64)
    ends = [*accumulate(len(w) + 1 for w in words)]
    starts = [0, *ends]
    return np.fromiter((digest(flat[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bit b is set if more than half of the hashes have it."""
    n = len(hashes)
    if not n:
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], dtype="<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([majority(shingle_hashes(t)) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def bit_blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(bits, dtype=np.int64), parts)]


def mask_of(bits: list[int]) -> int:
    return sum(1 << int(b) for b in bits)


def keys() -> list[tuple[int, list[int]]]:
    """(mask of the bits that agree, free bits) for every choice of blocks that a close pair may share."""
    edges = [0, *accumulate(BLOCKS)]
    own = [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for chosen in combinations(range(len(own)), len(own) - DISTANCE):
        held = [b for i in chosen for b in own[i]]
        out.append((mask_of(held), [b for b in range(64) if b not in held]))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, free: list[int]) -> list[tuple[int, int]]:
    """Edges that span the components of the links among distinct fps, which differ in free bits only."""
    m = len(fps)
    parent = list(range(m))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def brute(own: np.ndarray) -> None:
        part = fps[own]
        for at in range(0, len(own), 256):
            near = np.bitwise_count(part[at : at + 256, None] ^ part[None, :]) <= DISTANCE
            for i, j in zip(*np.nonzero(near), strict=True):
                if at + i < j:
                    a, b = find(int(own[at + i])), find(int(own[j]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)

    work = [(np.arange(m), free)]
    while work:
        own, bits = work.pop()
        if len(own) <= BRUTE or len(bits) <= DISTANCE:
            brute(own)
            continue
        for block in bit_blocks(bits, DISTANCE + 1):
            value = fps[own] & np.uint64(mask_of(block))
            order = np.argsort(value, kind="stable")
            cuts = np.nonzero(np.diff(value[order]))[0] + 1
            rest = [b for b in bits if b not in block]
            work += [(g, rest) for g in np.split(own[order], cuts) if len(g) > 1]
    return [(i, r) for i in range(m) if (r := find(i)) != i]


def free_bits(kind: int, path: tuple[int, ...]) -> list[int]:
    """Bits in which the fingerprints under a key may differ: path has the block that each split has fixed."""
    free = keys()[kind][1]
    for part in path:
        block = bit_blocks(free, DISTANCE + 1)[part]
        free = [b for b in free if b not in block]
    return free


def split_hot(met: DataFrame) -> list[tuple[int, DataFrame]]:
    """(splits, rows kind, path, key, fp): keys of more than HOT fingerprints are split by blocks of their free bits, again
    and again; as fingerprints are distinct, a key of `SPLITS` splits and its 14 free bits has at most 16,384."""
    parts, done, splits = DISTANCE + 1, [], 0
    while True:
        n = met.groupBy("kind", "path", "key").agg(F.count("*").alias("n")).where("n > 1")
        if splits == SPLITS:
            return [*done, (splits, met.join(n.drop("n"), ["kind", "path", "key"]))]
        large = written(n.where(F.col("n") > HOT), "hot")
        done.append((splits, met.join(n.where(F.col("n") <= HOT).drop("n"), ["kind", "path", "key"])))
        if not large.limit(1).count():
            return done
        masks = [[mask_of(b) for b in bit_blocks(free_bits(kind, path), parts)] for kind in range(len(keys())) for path in product(range(parts), repeat=splits)]
        mask = lambda j: F.element_at(F.array(*[F.lit(signed(m[j])) for m in masks]), F.col("kind") * parts**splits + F.col("path") + 1)  # noqa: B023, E731
        sub = F.array(*[F.struct((F.col("path") * parts + j).alias("path"), F.col("key").bitwiseOR(F.col("fp").bitwiseAND(mask(j))).alias("key")) for j in range(parts)])
        met = written(met.join(large.drop("n"), ["kind", "path", "key"]).select("kind", "fp", F.explode(sub).alias("x")).select("kind", "x.path", "x.key", "fp"), "split")
        splits += 1


def links(fps: DataFrame) -> DataFrame:
    """(u, v) edges between fingerprints that span every component; fps: distinct fp."""
    kinds = keys()
    struct = [F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("key")) for k, (mask, _) in enumerate(kinds)]
    keyed = fps.select("fp", F.explode(F.array(*struct)).alias("x")).select("x.kind", F.lit(0).alias("path"), "x.key", "fp")
    cols = ["kind", "path", "key"]

    def run_of(splits: int):
        paths = list(product(range(DISTANCE + 1), repeat=splits))

        def out(rows: np.ndarray) -> pa.RecordBatch:
            fp = np.ascontiguousarray(rows[3])
            found = forest(fp.view(np.uint64), free_bits(int(rows[0, 0]), paths[rows[1, 0]]))
            return pa.RecordBatch.from_arrays([pa.array(fp[[i for i, _ in found]], pa.int64()), pa.array(fp[[r for _, r in found]], pa.int64())], ["u", "v"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((4, 0), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])], axis=1)
                cuts = np.nonzero((np.diff(rows[:3], axis=1) != 0).any(0))[0] + 1
                *whole, held = np.split(rows, cuts, axis=1)
                yield from (out(r) for r in whole)
            if held.shape[1]:
                yield out(held)

        return run

    found = [part.repartition(*cols).sortWithinPartitions(*cols, "fp").mapInArrow(run_of(splits), "u long, v long") for splits, part in split_hot(keyed)]
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    fps = written(fingerprints(docs), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")), "nodes")
    named = nodes.join(components(links(nodes.select("fp"))).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    of = named.join(firsts, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The set of a text's shingles, ascending; texts without words share a set of one."""
    return np.unique(hashes) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return distinct(shingle_hashes(text, size))


def node_of(own: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), SEED))


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending; counts) of shingles found often, as far as tasks see them twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[c > 1].view(np.int64)), pa.array(c[c > 1].astype(np.int64))], ["h", "c"])

        held, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), size))
                n += len(held[-1])
                if n >= COUNTED:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()
        trimmed()

    sums = docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON)
    top = sums.orderBy(F.desc("c"), "h").limit(MOST_COMMON).collect()
    h, c = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    """Which of 2^bits equal ranges of the hash have a member, as bytes of 0 and 1."""
    out = np.zeros(1 << bits, np.uint8)
    out[(own >> np.uint64(64 - bits)).astype(np.int64)] = 1
    return out


def sketch(own: np.ndarray) -> bytes:
    """A bitmap of a set with some `PER_MEMBER` to twice as many bits for each member, packed."""
    return np.packbits(bitmap(own, max(3, (PER_MEMBER * len(own)).bit_length()))).tobytes()


def most_shared(a: bytes, b: bytes, n: int, m: int) -> int:
    """At most so many members are in both of two sets of n and m members: a range in which only one of them has any has
    one at least that the other lacks."""
    x, y = (np.unpackbits(np.frombuffer(z, np.uint8)) for z in (a, b))
    size = min(len(x), len(y))
    x, y = (z.reshape(size, -1).max(1).astype(bool) for z in (x, y))
    return min(n - int((x & ~y).sum()), m - int((y & ~x).sum()))


def short_bits(own: np.ndarray) -> np.ndarray:
    """The bitmap of fixed size that goes with a node's keys, as longs."""
    return np.packbits(bitmap(own, SHORT_BITS), bitorder="little").view("<i8")


def alike(shared: Column | np.ndarray | int, a: Column | np.ndarray | int, b: Column | np.ndarray | int, similarity: float):
    """Whether sets of a and b members that share so many reach the similarity."""
    return shared >= similarity * (a + b - shared) - 1e-9


PREFIX = "doc_id long, text_hash long, node long, n long, fp long, sketch binary, short array<long>, heads array<long>"


def prefixes(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """For each row doc_id, text_hash, node (equal sets share one), n (shingles of the set) and fp; for a task's first row
    of each node also sketch and heads, the prefix in order."""
    common, count = common_shingles(docs, size)

    def head(own: np.ndarray) -> np.ndarray:
        n = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
        if not len(common):
            return own[:n]
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        return own[np.lexsort((own, np.where(common[at] == own, count[at], 0)))[:n]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, n, fps, sketches, shorts, heads = [], [], [], [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), size)
                own = distinct(hashes)
                nodes.append(node_of(own))
                n.append(len(own))
                fps.append(signed(majority(hashes)))
                new = nodes[-1] not in seen
                sketches.append(sketch(own) if new else None)
                shorts.append(short_bits(own) if new else None)
                heads.append(head(own).view(np.int64) if new else None)
                seen.add(nodes[-1])
                if len(seen) > REMEMBERED:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), pa.array(sketches, pa.binary()), pa.array(shorts, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int64()))], [x.split()[0] for x in PREFIX.split(", ")])
        trimmed()

    return docs.select("doc_id", text_hash(), "text").mapInArrow(run, PREFIX)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")


def met_keys(rows: DataFrame) -> DataFrame:
    """key, node, n, place of the prefixes' keys that two nodes or more have. Rows are streamed, whatever a key has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, known = ["key", "node", "n", "place"], np.zeros((4, 0), np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])], axis=1)
            new = new[:, np.append(True, (np.diff(new[:2], axis=1) != 0).any(0))]  # copies of a node
            same = np.diff(new[0]) == 0
            keep = np.append(known, same) | np.append(same, False)
            if new.shape[1] > 1:
                out = new[:, :-1][:, keep[:-1]]
                if out.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)
            held, known = new[:, -1:], bool(keep[-1])
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names)

    keyed = rows.where("heads IS NOT NULL").select(F.posexplode("heads").alias("place", "key"), "node", "n").select("key", "node", "n", F.col("place").cast("long").alias("place"))
    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long, n long, place long")


def possible(similarity: float) -> Column:
    """Whether two rows of a key (node n place, other other_n other_place) can be alike: at the first key that two sets
    share, what follows it in each bounds what they share."""
    rest = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    return alike(F.least("n", "other_n"), F.col("n"), F.col("other_n"), similarity) & alike(rest, F.col("n"), F.col("other_n"), similarity)


def ordered_pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def ring_pairs(own: DataFrame, turn: int, similarity: float) -> DataFrame:
    """(u, v): nodes and up to `NEAR` before them in one key of theirs, where components differ and sizes allow it. Keys with many
    nodes are preferred, and a turn prefers the same ones for all nodes; the order within a key changes with the turn as well.
    However large a key is, a node has so many pairs. own: key, node, n, place, root, c (nodes of the key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])], axis=1)
            first = held.shape[1]
            for back in range(1, min(NEAR, rows.shape[1] - 1) + 1):
                at = np.arange(max(first, back), rows.shape[1])
                key, node, n, root = rows[:, at]
                other_key, other, other_n, other_root = rows[:, at - back]
                keep = (key == other_key) & (root != other_root) & alike(np.minimum(n, other_n), n, other_n, similarity)
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node, other)[keep]), pa.array(np.maximum(node, other)[keep])], ["u", "v"])
            held = rows[:, -NEAR:]

    drawn = F.col("c") * F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(1 << 20))
    chosen = own.groupBy("node").agg(F.max(F.struct(drawn.alias("drawn"), "key", "n", "root")).alias("x")).select("x.key", "node", "x.n", "x.root")
    dealt = chosen.repartition("key").sortWithinPartitions("key", F.xxhash64("node", F.lit(turn))).select("key", "node", "n", "root")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def cross_pairs(own: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v): nodes of a key whose components differ, as far as sizes, places and short bitmaps allow it. Only the first key
    that two sets share counts, so keys are left out that follow upon another shared one."""
    mixed = own.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
    order = Window.partitionBy("node").orderBy("place")
    before, turn = F.coalesce(F.lag("key").over(order), F.lit(0)).alias("before"), F.row_number().over(order).alias("turn")
    placed = own.join(mixed, "key", "left_semi").select("key", "node", "n", "place", "root", before, turn)
    short = nodes.select("node", *[F.get("short", F.lit(i)).alias(c) for i, c in enumerate(SHORT)])
    left = written(placed.join(short, "node"), "mixed")
    right = left.select("key", *[F.col(c).alias(f"other_{c}") for c in ("n", "place", "root", "before", "turn", *SHORT)], F.col("node").alias("other"))
    first = (F.col("turn") == 1) | (F.col("other_turn") == 1) | (F.col("before") != F.col("other_before"))
    lacking = lambda x, y: reduce(Column.__add__, [F.bit_count(F.col(f"{x}{c}").bitwiseAND(F.bitwise_not(F.col(f"{y}{c}")))) for c in SHORT])
    shared = F.least(F.col("n") - lacking("", "other_"), F.col("other_n") - lacking("other_", ""))
    return ordered_pairs(left.join(right, "key").where("root < other_root").where(first).where(possible(similarity)).where(alike(shared, F.col("n"), F.col("other_n"), similarity)))


def block_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): nodes whose fingerprints are equal, or meet in blocks and differ in few bits."""
    of = written(rows.groupBy("fp").agg(F.min("node").alias("hub")), "hubs")
    equal = nodes.join(of, "fp").where("node <> hub").select("node", F.col("hub").alias("other"))
    near = links(of.select("fp")).join(of.select(F.col("fp").alias("u"), F.col("hub").alias("node")), "u").join(of.select(F.col("fp").alias("v"), F.col("hub").alias("other")), "v").select("node", "other")
    return ordered_pairs(equal.unionByName(near))


def paired(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
    """pairs with the value of either node."""
    return pairs.join(of.select(F.col("node").alias("u"), F.col(value).alias("a")), "u").join(of.select(F.col("node").alias("v"), F.col(value).alias("b")), "v")


def checked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, similarity: float) -> DataFrame | None:
    """The pairs (u, v) of nodes whose sets are similar; None if the bitmaps already leave out all."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k) for k in range(2, 6)), strict=True)
            keep = [alike(most_shared(a.as_py(), b.as_py(), n.as_py(), m.as_py()), n.as_py(), m.as_py(), similarity) for n, m, a, b in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                own = shingle_set(text.as_py(), size)
                yield pa.RecordBatch.from_arrays([pa.array([node_of(own)], pa.int64()), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], ["node", "own"])

    sized = nodes.select("node", F.struct("n", "sketch").alias("s"))
    drawn = paired(pairs, sized, "s").select("u", "v", "a.n", F.col("b.n").alias("m"), F.col("a.sketch").alias("a"), F.col("b.sketch").alias("b"))
    pairs = written(drawn.mapInArrow(passing, "u long, v long"), "pairs")
    if pairs.isEmpty():
        return None
    asked = nodes.select("node", "text_hash").join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi")
    texts = docs.select(text_hash(), "text").join(asked, "text_hash", "left_semi").select("text")
    own = texts.dropDuplicates(["text"]).mapInArrow(sets_of, "node long, own array<long>")
    sets = written(own, "sets").dropDuplicates(["node"])
    shared = paired(pairs, sets, "own").select("u", "v", F.size("a").alias("n"), F.size("b").alias("m"), F.size(F.array_intersect("a", "b")).alias("shared"))
    return shared.where(alike(F.col("shared"), F.col("n"), F.col("m"), similarity)).select("u", "v")


def spanned(edges: DataFrame) -> DataFrame:
    """What `components` returns, by one task that holds all nodes; for at most `FEW` edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(u), find(v)
                parent[max(a, b)] = min(a, b)
        own = [*parent]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([find(x) for x in own], pa.int64())], ["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long")


def regrouped(found: DataFrame, roots: DataFrame | None) -> DataFrame | None:
    """roots (node, root: the smallest node of its group; nodes without links may be missing) after further links (u, v) between
    nodes. Only links between groups are kept and joined up, so a turn's work follows what it has found, not all links so far."""
    if roots is not None:
        of = lambda end, to: roots.select(F.col("node").alias(end), F.col("root").alias(to))
        found = found.join(of("u", "a"), "u", "left").join(of("v", "b"), "v", "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    edges = written(found.where("u <> v"), "groups")
    n = edges.count()
    if not n:
        return roots
    joined = spanned(edges) if n <= FEW else components(edges)
    if roots is not None:
        later = joined.select(F.col("node").alias("root"), F.col("root").alias("later"))
        moved = roots.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
        joined = moved.unionByName(joined.join(roots.select("node"), "node", "left_anti"))
    return written(joined, "roots")


def rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows of nodes with the root of each."""
    return rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def similar(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """doc_id, text_hash, component_id (the smallest doc_id of each group of documents linked by similarity), first (whether
    the row is the group's first by doc_id, then text_hash; equal rows alike)."""
    small_batches(docs.sparkSession)
    rows = written(prefixes(docs, size, similarity), "prefixes")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    least = rows.groupBy("node").agg(F.min(place).alias("x"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.max("sketch").alias("sketch"), F.max("short").alias("short"))
    nodes = written(least.select("node", F.col("x.doc_id").alias("doc"), "x.text_hash", "n", "fp", "sketch", "short"), "nodes")
    met = written(met_keys(rows), "keys")
    met = written(met.join(met.groupBy("key").agg(F.count("*").alias("c")), "key"), "met")
    roots = None
    rings = [lambda own, turn=turn: ring_pairs(own, turn, similarity) for turn in range(RINGS)]
    for candidates in (lambda own: block_pairs(rows, nodes), *rings, lambda own: cross_pairs(own, nodes, similarity)):
        own = rooted(met, roots)
        found = checked(candidates(own), docs, nodes, size, similarity)
        roots = roots if found is None else regrouped(found, roots)
    named = rooted(nodes.select("node", "doc", "text_hash"), roots)
    firsts = named.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull(), F.col("doc").alias("first_doc"), F.col("text_hash").alias("first_hash"))).alias("x"))
    of = named.join(firsts, "root").select("node", "x.first_doc", "x.first_hash")
    joined = rows.select("doc_id", "text_hash", "node").join(of, "node")
    return joined.select("doc_id", "text_hash", F.col("first_doc").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_hash") == F.col("first_hash"))).alias("first"))


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of `similar`, that of the smallest doc_id; rows without a doc_id stay. Every column
    stays."""
    found = written(similar(docs, shingle, similarity), "components")
    gone = found.where("doc_id IS NOT NULL AND NOT first").select("doc_id", "text_hash").distinct()
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"), text_hash())
    out = marked.join(gone, ["doc_id", "text_hash"], "left_anti")
    if found.where("doc_id IS NOT NULL").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        out = out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text_hash"]).unionByName(out.where("doc_id IS NULL"))
    return out.select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
