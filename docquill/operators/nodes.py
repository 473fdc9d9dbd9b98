"""The node table: documents shredded once, then asked by ordinary relational operators.

A row for each value: pre (its number in document order), post (that of its last descendant), parent (pre of the parent), depth,
name or idx, kind, sval, nkey (number order as a struct that sorts as numbers do), path. Partition or bucket a stored table by the document's
id and the joins below need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquill.operators.documents import ERROR, column, failure, mapped
from docquill.plans.writer import quoted
from docquill.sources import jsontext
from docquill.sources.jsontext import JsonError, Members, Num

TABLE = f"pre long, post long, parent long, depth int, name string, idx long, kind string, sval string, nval double, nkey struct<sign:int,magnitude:bigint,digits:string>, path string, {ERROR}, ntext string"
NAMES = "pre", "post", "parent", "depth", "name", "idx", "kind", "sval", "nval", "nkey", "path", "error", "ntext"
NODES = 8192  # of an Arrow batch


class Columns:
    """The columns of node rows, filled document by document."""

    def __init__(self) -> None:
        self.place: list[int] = []
        self.pre, self.post, self.parent, self.depth, self.name, self.idx, self.kind, self.sval, self.ntext, self.path = ([] for _ in range(10))
        self.errors: dict[int, dict] = {}

    def document(self, place: int, root: Any) -> None:
        base = len(self.place)
        parents, depths, names, idx, kinds, svals, ntexts, paths = self.parent, self.depth, self.name, self.idx, self.kind, self.sval, self.ntext, self.path
        stack: list[tuple[Any, int | None, int, Any, str]] = [(root, None, 0, None, "$")]
        pre = 0
        while stack:
            v, parent, depth, key, path = stack.pop()
            parents.append(parent)
            depths.append(depth)
            named = isinstance(key, str)
            names.append(key if named else None)
            idx.append(None if named else key)
            paths.append(path)
            is_text, is_number = isinstance(v, str), isinstance(v, Num)
            svals.append(v if is_text else None)
            ntexts.append(v.text if is_number else None)
            kinds.append("string" if is_text else "number" if is_number else jsontext.kind(v))
            if isinstance(v, list) and not jsontext.is_object(v):
                depth += 1
                stack += [(v[i], pre, depth, i, f"{path}[{i}]") for i in range(len(v) - 1, -1, -1)]
            elif not is_text and not is_number and jsontext.is_object(v):
                depth += 1
                below = [(x, pre, depth, k, f"{path}[{step(k)}]") for k, x in v.items()]
                below.reverse()
                stack += below
            pre += 1
        self.place += [place] * pre
        self.pre += range(pre)
        last = list(range(pre))
        for i in range(pre - 1, 0, -1):
            up = parents[base + i]
            if last[i] > last[up]:
                last[up] = last[i]
        self.post += last

    def failed(self, place: int, e: JsonError) -> None:
        self.errors[len(self.place)] = failure(e)
        self.place.append(place)
        for c in (self.pre, self.post, self.parent, self.depth, self.name, self.idx, self.kind, self.sval, self.ntext, self.path):
            c.append(None)

    def batch(self, rows: pa.Array) -> pa.RecordBatch:
        keys = [None if t is None else number_order(t) for t in self.ntext]
        parts = [pa.array([None if k is None else k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string()))]
        nkey = pa.StructArray.from_arrays(parts, ["sign", "magnitude", "digits"], mask=pa.array([k is None for k in keys], pa.bool_()))
        error = pa.array([self.errors.get(i) for i in range(len(self.place))] if self.errors else [None] * len(self.place), pa.struct([("code", pa.string()), ("detail", pa.string())]))
        n = len(self.place)
        nval = pa.array([None if t is None else float(t) for t in self.ntext], pa.float64())
        columns = [rows.take(pa.array(self.place, pa.int64())), pa.array(self.pre, pa.int64()), pa.array(self.post, pa.int64()), pa.array(self.parent, pa.int64()), pa.array(self.depth, pa.int32()), pa.array(self.name, pa.string()), pa.array(self.idx, pa.int64()), pa.array(self.kind, pa.string()), pa.array(self.sval, pa.string()), nval, nkey, pa.array(self.path, pa.string()), error, pa.array(self.ntext, pa.string())]
        assert all(len(c) == n for c in columns)
        return pa.RecordBatch.from_arrays(columns, ["_row", *NAMES])


@lru_cache(maxsize=4096)
def step(name: str) -> str:
    return quoted(name)


@lru_cache(maxsize=1 << 16)
def number_order(text: str) -> tuple[int, int, str]:
    sign, magnitude, digits = jsontext.number_key(text)
    return sign, max(-(2**63), min(2**63 - 1, magnitude)), digits


def shred(df: DataFrame, doc: str | Column, keep: list[str]) -> DataFrame:
    """The node table of the documents, with the columns `keep` of df (the document's id) on each row; `keep` must not have
    names of the table."""
    if clash := sorted({*keep} & {*NAMES}):
        raise ValueError(f"names of the node table: {', '.join(clash)}")
    src = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("_row"), column(df, doc).alias("_doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Columns()
            for place, text in enumerate(batch.column(1)):
                if (text := text.as_py()) is None:
                    continue
                try:
                    out.document(place, jsontext.parse(text))
                except JsonError as e:
                    out.failed(place, e)
                if len(out.place) >= NODES:
                    yield out.batch(batch.column(0))
                    out = Columns()
            if out.place:
                yield out.batch(batch.column(0))

    schema = T.StructType([src.schema["_row"], *T.StructType.fromDDL(TABLE).fields])
    return src.mapInArrow(run, schema).select(*[F.col(f"_row.`{c}`") for c in keep], *NAMES)


def assembled(nodes: DataFrame, key: list[str], name: str = "doc") -> DataFrame:
    """The documents of a node table as JSON texts again: key, and a text without blanks, in document order, with numbers as
    they were written. One shuffle by document; a document's nodes meet in one row, as its text did."""
    own = F.sort_array(F.collect_list(F.struct("pre", "parent", "name", "kind", "sval", "ntext"))).alias("_nodes")
    grouped = nodes.where("pre IS NOT NULL").groupBy(*key).agg(own)

    def rows(found: list[dict]) -> Iterator[tuple]:
        made: list[Any] = []
        for n in found:
            kind = n["kind"]
            value = [] if kind in ("array", "object") else n["sval"] if kind == "string" else Num(n["ntext"]) if kind == "number" else {"true": True, "false": False, "null": None}[kind]
            value = Members() if kind == "object" else value
            made.append(value)
            if n["parent"] is not None:
                up = made[n["parent"]]
                up.append((n["name"], value) if isinstance(up, Members) else value)
        yield (jsontext.render(made[0]),)

    return mapped(grouped, [F.col("_nodes")], f"{name} string", rows).drop("_nodes")


def children(nodes: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Rows of nodes whose parent is a row of parents: an equi-join on the document and the parent's number."""
    return nodes.join(parents.select(*key, F.col("pre").alias("parent")), [*key, "parent"], "left_semi")


def without(nodes: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Rows of parents of which no row of nodes is a child: an anti-join on the document and the parent's number."""
    return parents.join(nodes.select(*key, F.col("parent").alias("pre")), [*key, "pre"], "left_anti")


def equal_nodes(a: DataFrame, b: DataFrame, a_key: list[str], b_key: list[str]) -> DataFrame:
    """Pairs of scalar nodes of two node tables that are equal values: a_key, b_key (unlike names), by an equi-join on kind,
    text and exact number."""
    value = [F.col("kind"), F.coalesce("sval", F.lit("")).alias("_s"), F.coalesce("nkey.sign", F.lit(0)).alias("_g"), F.coalesce("nkey.magnitude", F.lit(0)).alias("_m"), F.coalesce("nkey.digits", F.lit("")).alias("_d")]
    left, right = (t.where("kind NOT IN ('array', 'object')").select(*k, *value) for t, k in ((a, a_key), (b, b_key)))
    return left.join(right, ["kind", "_s", "_g", "_m", "_d"]).select(*a_key, *b_key)


def descendants(nodes: DataFrame, ancestors: DataFrame, key: list[str]) -> DataFrame:
    """Rows of nodes within a row of ancestors (itself excluded): equal documents, and numbers within the ancestor's."""
    a = ancestors.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("pre").alias("_pre"), F.col("post").alias("_post"))
    on = [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("pre") > F.col("_pre"), F.col("pre") <= F.col("_post")]
    return nodes.join(a, on, "left_semi")


def named(nodes: DataFrame, name: str) -> DataFrame:
    """`$..name`: a scan with a pushed filter, no walk."""
    return nodes.where(F.col("name") == name)


def duplicate_names(nodes: DataFrame, key: list[str]) -> DataFrame:
    """(document, parent, name, n) of names that an object repeats."""
    return nodes.where("name IS NOT NULL").groupBy(*key, "parent", "name").agg(F.count("*").alias("n")).where("n > 1")
