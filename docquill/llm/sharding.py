"""Sharding by sampled splitters, sizes near equal.

Records are keyed by a hash of their text, so that equal texts are neighbours. Keys are drawn with a chance in
proportion to their record's size; quantiles of the draw are the splitters of many small ranges. Exact sums per range
follow. A range that came out overfull is subdivided: a key that alone outweighs a mean range (a large group of equal
texts; there can't be more of those than ranges) is dealt by doc_id, the rest of the range by a further hash. The
pieces go to the shards, largest first, each to the emptiest shard. Slots are numbered by piece, so no task sees a shard.

What reaches the driver: the draw (about `DRAWS` keys for each 1,000 ranges), sums of ranges, and at most one heavy key
for each range. The number of ranges grows with the rows, so that a piece stays a task's work.

Defined results: a null text has size 1 and the key and crc32 of an empty one; repeated rows each have a place of
their own; an empty table gives an empty table; further columns are ignored; ties are broken by key and doc_id.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquill.llm.common import table, written

SHARDS, RANGES, RANGE_ROWS, DRAWS = 8, 1000, 200_000, 8000


def constant(values: list[int], kind: str) -> Column:
    """An array literal; folded once, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at or below the key: first among every `step`-th, then within one step."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    heads, all_ = constant(splitters[step - 1 :: step], "bigint"), constant(splitters, "bigint")
    first = F.size(F.filter(heads, lambda s: s <= key)) * step
    return first + F.size(F.filter(F.slice(all_, first + 1, F.lit(step)), lambda s: s <= key))


def drawn_splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Distinct quantiles of keys that are drawn by hash, each row with a chance in proportion to its size."""
    draws = DRAWS * ranges / 1000
    chance = F.pmod(F.xxhash64("doc_id", "key", F.lit(11)), F.lit(1 << 53)) / float(1 << 53)
    keys = sorted(r["key"] for r in rows.where(chance * float(total) < F.col("size") * F.lit(float(draws))).select("key").collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def dealt(sizes: list[int], shards: int) -> list[int]:
    """A shard for each piece: largest first, to the shard with the least so far."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (load + sizes[k], s))
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("number")), "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(ranges, n // RANGE_ROWS)
    splitters = drawn_splitters(rows, total, ranges)
    ranged = rows.withColumn("range", range_of(F.col("key"), splitters))
    mean = max(1.0, total / ranges)
    sums = {r["range"]: r["b"] for r in ranged.groupBy("range").agg(F.sum("size").alias("b")).collect()}
    keys = ranged.groupBy("key").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") > mean) & (F.col("n") > 1))
    heavy = {r["key"]: r["b"] for r in keys.collect()}
    own = rows.where(F.col("key").isin([]) if not heavy else F.array_contains(constant(sorted(heavy), "bigint"), F.col("key")))
    ids = {r["key"]: r["ids"] for r in own.groupBy("key").agg(F.approx_count_distinct("doc_id").alias("ids")).collect()}
    # Numbers of pieces: of each range without its heavy keys, then of each heavy key.
    rest = [sums.get(r, 0) for r in range(len(splitters) + 1)]
    for key, b in heavy.items():
        rest[range_at(splitters, key)] -= b
    names = sorted(heavy)
    parts = [max(1, round(b / mean)) for b in (*rest, *(heavy[k] for k in names))]
    offsets = [0]
    for p in parts:
        offsets.append(offsets[-1] + p)
    place = F.array_position(constant(names, "bigint"), F.col("key")).cast("int")
    group = F.when(place > 0, place - 1 + len(rest)).otherwise(F.col("range"))
    grouped = ranged.withColumn("group", group)
    few = constant([int(ids.get(k, 0) < 20 * p) for k, p in zip(names, parts[len(rest) :], strict=True)], "int")
    by_row = F.coalesce(F.get(few, F.col("group") - len(rest)), F.lit(0)) == 1
    spread = F.when(by_row, F.xxhash64("number", F.lit(5))).when(F.col("group") >= len(rest), F.xxhash64("doc_id", F.lit(5))).otherwise(F.xxhash64("key", F.lit(5)))
    piece = F.get(constant(offsets, "int"), F.col("group")) + F.pmod(spread, F.get(constant(parts, "int"), F.col("group"))).cast("int")
    pieced = written(grouped.select("doc_id", "size", "text_crc32", "key", piece.alias("piece")), "pieces")
    sizes, counts = [0] * offsets[-1], [0] * offsets[-1]
    for r in pieced.groupBy("piece").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        sizes[r["piece"]], counts[r["piece"]] = r["b"], r["n"]
    shard = dealt(sizes, shards)
    before, held = [0] * len(sizes), [0] * shards
    for k, s in enumerate(shard):
        before[k] = held[s]
        held[s] += counts[k]
    rank = F.row_number().over(Window.partitionBy("piece").orderBy("key", "doc_id", "size", "text_crc32")) - 1
    return pieced.select("doc_id", "size", "text_crc32", F.get(constant(shard, "int"), F.col("piece")).alias("shard"), (F.get(constant(before, "bigint"), F.col("piece")) + rank).alias("slot"))


def range_at(splitters: list[int], key: int) -> int:
    return bisect_left(splitters, key + 1)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
