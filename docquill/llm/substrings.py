"""Removal of repeated substrings: every byte covered by a `LENGTH`-byte string that also starts earlier.

1. Each text is winnowed: of the hashes of its `GRAM`-byte strings, the least in each window of LENGTH - GRAM + 1 is
   that window's mark. A window of marks is just a string of LENGTH bytes, so equal strings have equal marks.
2. Marks are counted by hash shards, once for each place that gives one; strings whose mark has one place can't be repeated. The others (*open* starts) go on.
3. Blocks of documents are the shards of the suffix arrays: a block's open stretches are sorted (`suffix_array`), common
   prefixes of LENGTH or more make groups, and all of a group but the earliest are repeated.
4. The earliest of each group go on, by mark, to merges over many blocks: sorted runs are merged in pairs by binary
   search, the later of two equal strings being repeated. A merge takes `FAN` blocks; while there are more, what stays goes
   through another round, so that a string that every block has never meets all blocks in one task.
5. Repeated starts come back to their documents, and the bytes they cover are cut.

Nothing is broadcast. Strings are compared as bytes; hashes only decide where they meet.

Order is by doc_id, then place. Defined results: a null or empty text has no bytes; null doc_ids come last; rows equal
in doc_id and text count as one document and get the same result each; rows of one doc_id with different texts are
documents in the order of a hash of the text; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.llm.common import table, written
from docquill.llm.suffixarray import common_prefixes, suffix_array, words

LENGTH, GRAM = 100, 32
BLOCK_BYTES, SHARD_MARKS, MERGE_STARTS, FAN = 4_000_000, 2_000_000, 400_000, 256
MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def drawn() -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte, and odd factors: the same in every process."""
    rng = np.random.default_rng(100)
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64), rng.integers(0, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rolled(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram-byte string, from those of half the length, and so on."""
    byte, factor = drawn()
    h, size, k = byte[data], 1, 0
    while size < gram:
        step = min(size, gram - size)  # a last step may overlap
        h = h[: len(h) - step] * factor[k] + h[step:]
        h ^= h >> np.uint64(29)
        size, k = size + step, k + 1
    return h


def sliding(a: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    size = 1
    while size < width:
        step = min(size, width - size)
        a = of(a[: len(a) - step], a[step:])
        size += step
    return a


def marks(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first start, mark) of each run of starts that share a mark; starts go up to len(data) - length."""
    least = sliding(rolled(data, gram), length - gram + 1)
    at = np.concatenate(([0], np.nonzero(least[1:] != least[:-1])[0] + 1))
    return at, least[at]


def anchors(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The mark at each place that is the least of some window: a mark that stands at two places of a text is there twice."""
    h, width = rolled(data, gram), length - gram + 1
    pad = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([pad, sliding(h, width), pad]), width, np.maximum)
    return h[h == most]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h * MIX) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def grouped(which: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by shard, and where each shard begins in it."""
    which = which.astype(np.uint16 if shards < 1 << 16 else np.int64)  # 16 bits are sorted by radix
    order = np.argsort(which, kind="stable")
    return order, np.searchsorted(which[order], np.arange(shards + 1))


MARKS = "shard int, keys binary, groups binary, sizes binary, marks binary"


def marked(docs: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """docs (key, data, group) -> for each shard and chunk of documents: keys and groups of documents, how many marks each
    has there, marks."""
    names = [x.split()[0] for x in MARKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(keys: list[int], groups: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
            owner = np.repeat(np.arange(len(keys)), [len(f) for f in found])
            all_ = np.concatenate(found)
            order, cuts = grouped(shard_of(all_, shards), shards)
            names_, places = np.array(keys, np.int64), np.array(groups, np.int64)
            rows: list[list] = [[] for _ in names]
            for s in range(shards):
                own = order[cuts[s] : cuts[s + 1]]
                if len(own):
                    at = np.concatenate(([0], np.nonzero(np.diff(owner[own]))[0] + 1))
                    who = owner[own[at]]
                    for column, x in zip(rows, (s, names_[who].tobytes(), places[who].tobytes(), np.diff(at, append=len(own)).astype("<i4").tobytes(), all_[own].tobytes()), strict=True):
                        column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names)

        keys, groups, found, size = [], [], [], 0
        for batch in batches:
            for key, data, group in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = data.as_py()
                if len(raw) < length:
                    continue
                keys.append(key)
                groups.append(group)
                found.append(anchors(np.frombuffer(raw, np.uint8), length, gram))
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield chunk(keys, groups, found)
                    keys, groups, found, size = [], [], [], 0
        if keys:
            yield chunk(keys, groups, found)

    return docs.mapInArrow(run, MARKS)


SHARED = "group long, keys binary, sizes binary, shared binary"


def shared_marks(got: pa.Table) -> pa.Table:
    """Of one shard, for each group of documents: keys, and of each its marks that occur twice or more anywhere."""
    flat, sizes, keys, groups = (np.concatenate([np.frombuffer(x.as_py(), t) for x in got[n]]) for n, t in (("marks", np.uint64), ("sizes", "<i4"), ("keys", np.int64), ("groups", np.int64)))
    order = np.argsort(flat)
    ranked = flat[order]
    same = np.concatenate(([False], ranked[1:] == ranked[:-1]))
    twice = np.zeros(len(flat), bool)
    twice[order] = same | np.concatenate((same[1:], [False]))
    hit = np.nonzero(twice)[0]
    owner = np.repeat(np.arange(len(keys)), sizes)[hit]
    by = np.lexsort((owner, groups[owner]))
    hit, owner = hit[by], owner[by]
    out: list[list] = [[], [], [], []]
    cuts = np.nonzero(np.diff(groups[owner], prepend=-1))[0] if len(owner) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(owner)).tolist(), strict=False):
        at = np.concatenate(([0], np.nonzero(np.diff(owner[a:b]))[0] + 1))
        who = owner[a:b][at]
        for column, x in zip(out, (int(groups[who[0]]), keys[who].tobytes(), np.diff(at, append=b - a).astype("<i4").tobytes(), flat[hit[a:b]].tobytes()), strict=True):
            column.append(x)
    return pa.table({n: pa.array(x, t) for n, x, t in zip(("group", "keys", "sizes", "shared"), out, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)})


# What a block or merge gives: repeated starts of a document as [a, b), or, with a bucket, sorted earliest strings.
PART = "bucket int, unit long, key long, a long, b long, keys binary, starts binary, sizes binary, bytes binary"
FIELDS = [x.split() for x in PART.split(", ")]
KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def as_table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
    return pa.table({n: pa.array(c, KINDS[k]) for c, (n, k) in zip(columns, FIELDS, strict=True)})


def spans(keys: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, a, b) runs of consecutive starts of the same document."""
    if not len(keys):
        return []
    k, s = keys, starts
    if not np.all((k[1:] > k[:-1]) | ((k[1:] == k[:-1]) & (s[1:] >= s[:-1]))):
        order = np.lexsort((starts, keys))
        k, s = keys[order], starts[order]
    cut = np.concatenate(([0], np.nonzero((k[1:] != k[:-1]) | (s[1:] != s[:-1] + 1))[0] + 1, [len(k)]))
    return list(zip(k[cut[:-1]].tolist(), s[cut[:-1]].tolist(), (s[cut[1:] - 1] + 1).tolist(), strict=True))


def packed(unit: int, bucket: int, runs: list[tuple[int, int, int]], bytes_of) -> tuple:
    """A row of strings: runs of starts (key, a, b) with the bytes [a, b + length - 1) that bytes_of gives."""
    keys = np.array([k for k, _, _ in runs], np.int64)
    a = np.array([a for _, a, _ in runs], np.int64)
    n = np.array([b - a for _, a, b in runs], "<i4")
    return (bucket, unit, None, None, None, keys.tobytes(), a.tobytes(), n.tobytes(), b"".join(bytes_of(k, x, y) for k, x, y in runs))


def block_parts(docs: list[tuple[int, bytes, np.ndarray]], unit: int, buckets: int, length: int, gram: int) -> list[tuple]:
    """Rows of PART of one block; docs: key, bytes, shared marks (at least one, sorted)."""
    docs = sorted(docs, key=lambda d: d[0])
    pieces, ends, keys, firsts, mark_of = [], [], [], [], []
    texts = {k: raw for k, raw, _ in docs}
    size = 0
    for key, raw, shared in docs:
        data = np.frombuffer(raw, np.uint8)
        at, mark = marks(data, length, gram)
        stop = np.append(at[1:], len(data) - length + 1)
        own = np.nonzero(shared[np.minimum(np.searchsorted(shared, mark), len(shared) - 1)] == mark)[0]
        if not len(own):
            continue
        joint = np.concatenate(([True], stop[own[:-1]] != at[own[1:]]))  # runs of starts that follow each other are one segment
        heads = np.nonzero(joint)[0]
        for x, y in zip(heads.tolist(), np.append(heads[1:], len(own)).tolist(), strict=True):
            a, b = int(at[own[x]]), int(stop[own[y - 1]])
            pieces.append(data[a : b + length - 1])
            size += b - a + length - 1
            ends.append(size)
            keys.append(key)
            firsts.append(a)
            mark_of.append(np.append(np.repeat(mark[own[x:y]], (stop - at)[own[x:y]]), np.zeros(length - 1, np.uint64)))
    if not pieces:
        return []
    data, bound = np.concatenate(pieces), np.array(ends, np.int64)
    eight = words(data)
    order = suffix_array(data, bound, eight)
    common = common_prefixes(data, bound, order, eight)
    owner = np.repeat(np.arange(len(bound)), np.diff(bound, prepend=0))
    left = bound[owner] - np.arange(len(data))
    new = common < length
    heads = np.nonzero(new)[0]
    earliest = np.minimum.reduceat(order, heads)  # places follow the order of documents
    first = np.repeat(earliest, np.diff(heads, append=len(order)))
    full = left[order] >= length
    again, alone = np.sort(order[full & (order != first)]), np.sort(order[full & (order == first)])
    key_of, start_of = np.array(keys, np.int64)[owner], np.arange(len(data)) - (bound - np.diff(bound, prepend=0))[owner] + np.array(firsts, np.int64)[owner]
    rows: list[tuple] = [(None, None, k, a, b, None, None, None, None) for k, a, b in spans(key_of[again], start_of[again])]
    which = shard_of(np.concatenate(mark_of)[alone], buckets)
    by, cuts = grouped(which, buckets)
    for bucket in range(buckets):
        own = alone[by[cuts[bucket] : cuts[bucket + 1]]]
        if len(own):
            rows.append(packed(unit, bucket, spans(key_of[own], start_of[own]), lambda k, a, b: texts[k][a : b + length - 1]))
    return rows


Sorted = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # places of strings in order, their first eight bytes, keys, starts


def strings_at(windows: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(windows[places]).view(f"S{windows.shape[1]}").reshape(-1)


def sorted_run(row: dict, base: int, windows: np.ndarray, eight: np.ndarray) -> Sorted:
    """The strings of a row, whose bytes begin at base."""
    keys, a, n = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["starts"], np.int64), np.frombuffer(row["sizes"], "<i4").astype(np.int64)
    ends, length = np.cumsum(n), windows.shape[1]
    within = np.arange(ends[-1]) - np.repeat(ends - n, n)
    places = base + np.repeat(np.cumsum(n + length - 1) - (n + length - 1), n) + within
    head, next_ = eight[places], eight[np.minimum(places + 8, len(eight) - 1)]
    order = np.lexsort((next_, head))
    h, x = head[order], next_[order]
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (x[1:] == x[:-1])))
    tied = np.nonzero(same | np.concatenate((same[1:], [False])))[0]  # 16 equal bytes: the whole strings decide
    order[tied] = order[tied][np.argsort(strings_at(windows, places[order[tied]]))]
    return places[order], head[order], np.repeat(keys, n)[order], (np.repeat(a, n) + within)[order]


def sought(x: Sorted, y: Sorted, windows: np.ndarray) -> np.ndarray:
    """Where each string of y belongs in x: by the first eight bytes, then by whole strings, halving the range."""
    low, high = np.searchsorted(x[1], y[1], "left"), np.searchsorted(x[1], y[1], "right")
    open_ = np.nonzero(low < high)[0]
    whole = strings_at(windows, y[0][open_])
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        less = strings_at(windows, x[0][mid]) < whole
        low[open_] = np.where(less, mid + 1, low[open_])
        high[open_] = np.where(less, high[open_], mid)
        still = low[open_] < high[open_]
        open_, whole = open_[still], whole[still]
    return low


def merged(x: Sorted, y: Sorted, windows: np.ndarray, later: list[tuple[np.ndarray, np.ndarray]]) -> Sorted:
    """The union of two sorted runs of distinct strings; of equal ones the later goes to `later`. Only places move."""
    if len(x[0]) < len(y[0]):
        x, y = y, x
    at = sought(x, y, windows)
    inside = np.minimum(at, len(x[0]) - 1)
    j = np.nonzero(x[1][inside] == y[1])[0]
    j = j[strings_at(windows, x[0][inside[j]]) == strings_at(windows, y[0][j])]
    i = at[j]
    keys, starts = x[2].copy(), x[3].copy()
    swap = (y[2][j] < keys[i]) | ((y[2][j] == keys[i]) & (y[3][j] < starts[i]))
    later.append((np.where(swap, keys[i], y[2][j]), np.where(swap, starts[i], y[3][j])))
    keys[i[swap]], starts[i[swap]] = y[2][j[swap]], y[3][j[swap]]
    fresh = np.ones(len(y[0]), bool)
    fresh[j] = False
    rest = np.nonzero(fresh)[0]
    total = len(keys) + len(rest)
    to = at[rest] + np.arange(len(rest))
    mask = np.ones(total, bool)
    mask[to] = False
    out = []
    for a, b in ((x[0], y[0]), (x[1], y[1]), (keys, y[2]), (starts, y[3])):
        z = np.empty(total, a.dtype)
        z[mask], z[to] = a, b[rest]
        out.append(z)
    return tuple(out)


def merge_parts(length: int, last: bool):
    """A function of the rows of a bucket (and a range of units): rows of PART."""

    def run(got: pa.Table) -> pa.Table:
        rows = got.to_pylist()
        data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        windows, eight = np.lib.stride_tricks.sliding_window_view(data, length), words(data)
        bases = np.cumsum([0] + [len(r["bytes"]) for r in rows]).tolist()
        runs = [sorted_run(r, base, windows, eight) for r, base in zip(rows, bases, strict=False)]
        later: list[tuple[np.ndarray, np.ndarray]] = []
        while len(runs) > 1:
            runs.sort(key=lambda r: -len(r[0]))
            runs = [merged(runs[k], runs[-1 - k], windows, later) for k in range(len(runs) // 2)] + ([runs[len(runs) // 2]] if len(runs) % 2 else [])
        out: list[tuple] = []
        if later:
            out = [(None, None, k, a, b, None, None, None, None) for k, a, b in spans(np.concatenate([k for k, _ in later]), np.concatenate([s for _, s in later]))]
        if not last:
            places, _, keys, starts = runs[0]
            strings = strings_at(windows, places)
            text = {(k, s): x for k, s, x in zip(keys.tolist(), starts.tolist(), strings.tolist(), strict=True)}
            whole = lambda k, a, b: b"".join([text[k, s][:1].ljust(1, b"\0") for s in range(a, b - 1)]) + text[k, b - 1].ljust(length, b"\0")
            out.append(packed(rows[0]["unit"] // FAN, rows[0]["bucket"], spans(keys, starts), whole))
        return as_table(out)

    return run


def repeated_starts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """key, a, b: runs of starts of strings that also start earlier; docs: key (unique, in order), data."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    per_mark = max(1, (length - gram + 2) // 2)
    shards = max(2, n_bytes // per_mark // SHARD_MARKS)
    groups = max(1, n_bytes // BLOCK_BYTES)
    dealt = docs.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    shared = marked(dealt, shards, length, gram).groupBy("shard").applyInArrow(shared_marks, SHARED)
    buckets = max(2, n_bytes // 6 // MERGE_STARTS)

    def block(own: pa.Table, got: pa.Table) -> pa.Table:
        """A group's documents (about BLOCK_BYTES of them) and their shared marks."""
        found: dict[int, list[np.ndarray]] = {}
        for row in got.to_pylist():
            ends = np.cumsum(np.frombuffer(row["sizes"], "<i4"))
            for key, part in zip(np.frombuffer(row["keys"], np.int64).tolist(), np.split(np.frombuffer(row["shared"], np.uint64), ends[:-1]), strict=True):
                found.setdefault(key, []).append(part)
        held = [(key, data.as_py(), np.unique(np.concatenate(found[key]))) for key, data in zip(own["key"].to_pylist(), own["data"], strict=True) if key in found]
        unit = own["group"][0].as_py() if own.num_rows else 0
        return as_table(block_parts(held, unit, buckets, length, gram))

    met = dealt.groupBy("group").cogroup(shared.groupBy("group"))
    parts = written(met.applyInArrow(block, PART), "parts")
    out = parts.where("bucket IS NULL").select("key", "a", "b")
    while True:
        strings = parts.where("bucket IS NOT NULL")
        units = strings.agg(F.max("unit")).first()[0] or 0
        last = units < FAN
        range_ = F.lit(0) if last else F.floor(F.col("unit") / FAN)
        got = strings.withColumn("range", range_).groupBy("bucket", "range").applyInArrow(merge_parts(length, last), PART)
        parts = written(got, "parts")
        out = out.unionByName(parts.where("bucket IS NULL").select("key", "a", "b"))
        if last:
            return out


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text, kept (the remaining bytes), n_bytes, n_removed, n_spans."""
    src = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n, ids = src.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == ids:
        keyed = src.select(F.col("doc_id").alias("key"), "doc_id", F.col("text").cast("binary").alias("data"))
        names = None
    else:  # keys in the order of (doc_id, text's hash), nulls last; equal rows share one
        places = written(src.select("doc_id", F.xxhash64("text").alias("h")).distinct(), "places")
        ranged = places.repartitionByRange(max(1, ids // 1_000_000), F.col("doc_id").asc_nulls_last(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "h")
        names = written(ranged.select("doc_id", "h", F.monotonically_increasing_id().alias("key")), "names")
        both = src.withColumn("h", F.xxhash64("text"))
        on = both["doc_id"].eqNullSafe(names["doc_id"]) & (both["h"] == names["h"])
        keyed = both.join(names, on).select("key", both["doc_id"], F.col("text").cast("binary").alias("data"))
    unique = keyed.select("key", "data") if names is None else keyed.select("key", "data").dropDuplicates(["key"])
    runs = repeated_starts(unique, length, gram)
    found = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, gone, n_spans = [], [], [], []
            for data, own in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw, out, at, cut, count = data.as_py(), [], 0, 0, 0
                end = -1  # of the span so far
                for r in own or ():
                    a, b = r["a"], r["b"] + length - 1
                    if a > end:
                        out.append(raw[at:a])
                        count += 1
                        cut += b - a
                        end = b
                    elif b > end:
                        cut += b - end
                        end = b
                    at = end
                kept.append(b"".join([*out, raw[at:]]))
                size.append(len(raw))
                gone.append(cut)
                n_spans.append(count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (size, gone, n_spans)]], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return keyed.join(found, "key", "left").select("doc_id", "data", "runs").mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
