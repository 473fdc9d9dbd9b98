"""Headline queries at $BENCH_SF_DIR, on local[$BENCH_CPUS]; one JSON line.

Documents are made and written once, untimed: books, a list of ten records of some 300 bytes each in a document, 3,300
documents (10 MB) for each 0.01 of scale, so that sf0.1 has 100 MB, and the orders of the test tables for edits. Each query
then reads, parses and evaluates them end to end (`noop` sink), best of `REPEATS`. `exact` is the RFC-exact evaluator,
`native` the Catalyst plans over VARIANT, `loaded` the same over a cached VARIANT column (parsing left out), `table` a stored
node table.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

REPEATS = 2
# The six queries of the baseline.
QUERIES = {
    "filter": "$.items[?@.price < 10]",
    "descendant": "$..price",
    "wildcard": "$.items[*].author.last",
    "filterString": "$.items[?@.category == 'poetry']",
    "filterMatch": "$.items[?match(@.author.last, 'L1.*7 .')]",
    "index": "$.items[-1].id",
}


def book_docs(spark: SparkSession, n: int) -> DataFrame:
    """key, doc: ten books each."""
    row, pick = F.col("id"), lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m))
    kinds = F.get(F.array(*map(F.lit, ("fiction", "poetry", "history", "science"))), pick(1, 4).cast("int"))
    author = F.struct(F.concat(F.lit("F"), pick(2, 1000).cast("string")).alias("first"), F.concat(F.lit("L"), pick(3, 100_000).cast("string"), F.lit(" "), F.substring(F.hex(pick(4, 256)), 1, 1)).alias("last"))
    text = F.concat_ws(" ", *[F.sha2(F.concat(row.cast("string"), F.lit(k)), 224) for k in range(3)])
    book = F.struct(row.alias("id"), kinds.alias("category"), author.alias("author"), (pick(5, 10_000) / 100).alias("price"), text.alias("title"))
    return spark.range(n * 10).groupBy((row / 10).cast("long").alias("key")).agg(F.sort_array(F.collect_list(book)).alias("items")).select("key", F.to_json(F.struct("items")).alias("doc"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from docquill.operators.documents import merge_documents, patch_documents, resolve_pointer, select_nodes
    from docquill.operators.nodes import named, shred
    from docquill.plans.native import native_nodes
    from docquill.queries import order_docs

    work = tempfile.mkdtemp(prefix="bench-")
    try:
        order_docs(spark, sf).repartition(int(cpus) * 2).write.parquet(f"{work}/orders")
        scale = float(os.path.basename(sf.rstrip("/")).removeprefix("sf") or 0.1)
        book_docs(spark, int(330_000 * scale)).repartition(int(cpus) * 2).write.parquet(f"{work}/books")
        books, orders = (lambda name=name: spark.read.parquet(f"{work}/{name}") for name in ("books", "orders"))
        loaded = books().select("key", F.parse_json("doc").alias("doc")).cache()
        loaded.count()
        shred(books(), "doc", ["key"]).write.parquet(f"{work}/table")
        runs = {f"exact_{k}": lambda q=q: select_nodes(books(), "doc", q, json=False) for k, q in QUERIES.items()}
        flat = {k: q for k, q in QUERIES.items() if ".." not in q}
        runs |= {f"native_{k}": lambda q=q: native_nodes(books(), "doc", q) for k, q in flat.items()}
        runs |= {f"loaded_{k}": lambda q=q: native_nodes(loaded, "doc", q) for k, q in flat.items()}
        runs |= {
            "table_descendant": lambda: named(spark.read.parquet(f"{work}/table"), "price").select("key", "path", "nval"),
            "pointer": lambda: resolve_pointer(orders(), "doc", "/items/0/qty"),
            "patch": lambda: patch_documents(orders(), "doc", '[{"op":"replace","path":"/status","value":"X"},{"op":"remove","path":"/total"}]'),
            "merge_patch": lambda: merge_documents(orders(), "doc", '{"status":null,"seen":true}'),
            "shred": lambda: shred(orders(), "doc", ["key"]),
        }
        took = {}
        for name, run in runs.items():
            best = 1e9
            for _ in range(REPEATS):
                began = time.time()
                run().write.format("noop").mode("overwrite").save()
                best = min(best, time.time() - began)
            took[name] = round(best, 3)
        print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    finally:
        shutil.rmtree(work, ignore_errors=True)
        spark.stop()


if __name__ == "__main__":
    main()
