"""Holding the tiers against each other: what the exact operators and the hybrid tier give of the same documents."""

from __future__ import annotations

import contextlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquill.operators.documents import select_each, select_nodes
from docquill.plans.native import Unsupported, exact_part, hybrid_nodes, native_part

COLUMNS = "path", "kind", "sval", "nval"


def disagreements(df: DataFrame, key: list[str], doc: str, query: str) -> DataFrame:
    """key, path, kind, sval, nval, code and tier of nodes or errors that only one tier gives, repeated ones by their number.
    Empty if the tiers agree. One shuffle by whole rows."""
    code = F.col("error.code").alias("code")
    exact = select_nodes(df.select(*key, doc), doc, query, json=False).select(*key, *COLUMNS, code)
    hybrid = hybrid_nodes(df.select(*key, doc), doc, query).select(*key, *COLUMNS, code)
    return exact.exceptAll(hybrid).withColumn("tier", F.lit("exact")).unionAll(hybrid.exceptAll(exact).withColumn("tier", F.lit("hybrid")))


def agreement(df: DataFrame, key: list[str], doc: str, queries: list[str]) -> DataFrame:
    """query, native (whether the VARIANT plan covers it) and n, the rows of `disagreements`.

    Documents are made once and parsed once for the exact nodes of all queries. A row counts 1 from the exact tier and -1 from
    the hybrid one, and what is left over are the disagreements; rows are shuffled once, by key. Where the native plan doesn't cover
    a query, the hybrid tier is the exact operator on every document, so there is nothing to hold it against: n is 0."""
    docs = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col(doc).alias("_doc")).repartition(*[f"_k{i}" for i in range(len(key))])
    keys = [f"_k{i}" for i in range(len(key))]
    native: dict[int, DataFrame] = {}
    for k, query in enumerate(queries):
        with contextlib.suppress(Unsupported):
            native[k] = native_part(docs, "_doc", query)
    covered = [queries[k] for k in native]
    place = F.element_at(F.array(*map(F.lit, native)), F.col("q") + 1) if native else F.lit(0)
    row = lambda x, q, sign: x.select(*keys, q.cast("int").alias("q"), *COLUMNS, F.col("error.code").alias("code"), F.lit(sign).alias("sign"))
    rows = [row(select_each(docs, "_doc", covered), place, 1), row(select_each(exact_part(docs, "_doc"), "_doc", covered), place, -1)]
    rows += [row(x, F.lit(k), -1) for k, x in native.items()]
    left = reduce(DataFrame.unionAll, rows).repartition(*keys).groupBy(*keys, "q", *COLUMNS, "code").agg(F.sum("sign").alias("left"))
    sums = left.agg(*[F.coalesce(F.sum(F.when(F.col("q") == k, F.abs("left"))), F.lit(0)).alias(f"n{k}") for k in range(len(queries))])
    out = F.array(*[F.struct(F.lit(q).alias("query"), F.lit(k in native).alias("native"), F.col(f"n{k}").alias("n")) for k, q in enumerate(queries)])
    return sums.select(F.explode(out).alias("x")).select("x.query", "x.native", "x.n")
