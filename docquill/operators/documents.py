"""Exact operators over a column of JSON text, batch by batch over Arrow: queries, pointers, patches, checks.

Each is a row transform: no shuffle, valid on streams, and errors are values in an error column (code and detail) of the
document's row. A NULL document is Nothing: it has no nodes, and what is made of it is NULL.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquill.functions.registry import DEFAULT, Registry
from docquill.operators.evaluate import NOTHING, EvaluationError, Evaluator, Limits, render
from docquill.operators.merge import MergeError, checked, merge
from docquill.operators.patch import PatchError, apply_patch, parse_patch
from docquill.operators.pointer import Pointer, PointerError
from docquill.plans.ast import Query
from docquill.plans.parser import parse
from docquill.sources import jsontext
from docquill.sources.jsontext import JsonError, Num

ERROR = "error struct<code:string,detail:string>"
NODE = f"ord long, path string, kind string, json string, sval string, nval double, {ERROR}"


def as_query(query: str | Query, registry: Registry = DEFAULT) -> Query:
    return parse(query, registry) if isinstance(query, str) else query


def failure(e: Exception) -> dict[str, str]:
    return {"code": getattr(e, "code", type(e).__name__), "detail": str(e)}


def number(v: Any) -> float | None:
    return float(v.text) if isinstance(v, Num) else None


def mapped(df: DataFrame, columns: list[Column], schema: str, rows: Callable[..., Iterator[tuple]], keep: bool = True) -> DataFrame:
    """Every column of df with the columns of schema added, a row for each tuple that rows(*values) gives; a name in the
    schema hides the column of df that has it."""
    added = T.StructType.fromDDL(schema)
    own = [c for c in df.columns if c not in added.names] if keep else []
    src = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in own]).alias("_row"), *[c.alias(f"_in{k}") for k, c in enumerate(columns)])
    out = T.StructType([src.schema["_row"], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            if kinds is None:
                kinds = [pa_type(f.dataType) for f in added.fields]
            place: list[int] = []
            made: list[list] = [[] for _ in kinds]
            for k, values in enumerate(zip(*[batch.column(i).to_pylist() for i in range(1, batch.num_columns)], strict=True)):
                for row in rows(*values):
                    place.append(k)
                    for column, x in zip(made, row, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int64())), *[pa.array(c, t) for c, t in zip(made, kinds, strict=True)]], ["_row", *added.names])

    return src.mapInArrow(run, out).select(*[F.col(f"_row.`{c}`") for c in own], *added.names)


def pa_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, pa_type(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return pa.list_(pa_type(t.elementType))
    return {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}[t.simpleString()]


def column(df: DataFrame, c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def select_nodes(df: DataFrame, doc: str | Column, query: str | Query, registry: Registry = DEFAULT, limits: Limits = Limits(), json: bool = True) -> DataFrame:
    """A row for each node in nodelist order: ord, path, kind, json (left out of the work unless json), sval of strings,
    nval of numbers. A document that fails has one row, with its error and no node."""
    run = Evaluator(as_query(query, registry), registry, limits)

    def rows(text: str | None) -> Iterator[tuple]:
        if text is None:
            return
        try:
            nodes = run(jsontext.parse(text))
        except (JsonError, EvaluationError) as e:
            yield None, None, None, None, None, None, failure(e)
            return
        for n, (v, p) in enumerate(nodes):
            yield n, render(p), jsontext.kind(v), jsontext.render(v) if json else None, v if isinstance(v, str) else None, number(v), None

    return mapped(df, [column(df, doc)], NODE, rows)


def select_each(df: DataFrame, doc: str | Column, queries: list[str | Query], registry: Registry = DEFAULT, limits: Limits = Limits()) -> DataFrame:
    """The nodes of several queries, each text being parsed once: q (the query's place in the list), path, kind, sval, nval. A
    document that fails has a row with its error for each query that it fails."""
    runs = [Evaluator(as_query(q, registry), registry, limits) for q in queries]

    def rows(text: str | None) -> Iterator[tuple]:
        if text is None:
            return
        try:
            root = jsontext.parse(text)
        except JsonError as e:
            yield from ((k, None, None, None, None, failure(e)) for k in range(len(runs)))
            return
        for k, run in enumerate(runs):
            try:
                nodes = run(root)
            except EvaluationError as e:
                yield k, None, None, None, None, failure(e)
                continue
            for v, p in nodes:
                yield k, render(p), jsontext.kind(v), v if isinstance(v, str) else None, number(v), None

    return mapped(df, [column(df, doc)], f"q int, path string, kind string, sval string, nval double, {ERROR}", rows)


def nodelist(df: DataFrame, doc: str | Column, query: str | Query, name: str = "nodes", registry: Registry = DEFAULT, limits: Limits = Limits()) -> DataFrame:
    """df with the nodelist of each document as an array of (path, kind, json), and error."""
    run = Evaluator(as_query(query, registry), registry, limits)

    def rows(text: str | None) -> Iterator[tuple]:
        try:
            yield None if text is None else [{"path": render(p), "kind": jsontext.kind(v), "json": jsontext.render(v)} for v, p in run(jsontext.parse(text))], None
        except (JsonError, EvaluationError) as e:
            yield None, failure(e)

    return mapped(df, [column(df, doc)], f"{name} array<struct<path:string,kind:string,json:string>>, {ERROR}", rows)


def count_nodes(df: DataFrame, doc: str | Column, query: str | Query, name: str = "n", registry: Registry = DEFAULT, limits: Limits = Limits()) -> DataFrame:
    """df with the number of nodes of each document (more than 0: the query exists), and error."""
    run = Evaluator(as_query(query, registry), registry, limits)

    def rows(text: str | None) -> Iterator[tuple]:
        try:
            yield None if text is None else len(run(jsontext.parse(text))), None
        except (JsonError, EvaluationError) as e:
            yield None, failure(e)

    return mapped(df, [column(df, doc)], f"{name} long, {ERROR}", rows)


VALUE = f"kind string, json string, sval string, nval double, {ERROR}"


def described(v: Any) -> tuple:
    return jsontext.kind(v), jsontext.render(v), v if isinstance(v, str) else None, number(v), None


def value_of(df: DataFrame, doc: str | Column, query: str | Query, registry: Registry = DEFAULT, limits: Limits = Limits()) -> DataFrame:
    """df with the value of the query's only node (kind NULL if there isn't exactly one)."""
    run = Evaluator(as_query(query, registry), registry, limits)

    def rows(text: str | None) -> Iterator[tuple]:
        try:
            nodes = [] if text is None else run(jsontext.parse(text))
            yield described(nodes[0][0]) if len(nodes) == 1 else (None,) * 5
        except (JsonError, EvaluationError) as e:
            yield None, None, None, None, failure(e)

    return mapped(df, [column(df, doc)], VALUE, rows)


def resolve_pointer(df: DataFrame, doc: str | Column, pointer: str | Column, fragment: bool = False) -> DataFrame:
    """df with the value that the pointer (a text, or a column of texts) locates in each document."""
    read = Pointer.parse_fragment if fragment else Pointer.parse
    fixed = read(pointer) if isinstance(pointer, str) else None

    def rows(text: str | None, where: str | None = None) -> Iterator[tuple]:
        if text is None or fixed is None and where is None:
            yield (None,) * 5
            return
        try:
            yield described((fixed if fixed is not None else read(where)).resolve(jsontext.parse(text)))
        except (JsonError, PointerError) as e:
            yield None, None, None, None, failure(e)

    return mapped(df, [column(df, doc)] + ([] if fixed is not None else [pointer]), VALUE, rows)


def patch_documents(df: DataFrame, doc: str | Column, patch: str | Column, name: str = "patched") -> DataFrame:
    """df with the patched documents (NULL where the patch fails, with the error). A literal patch is read once."""
    fixed = parse_patch(jsontext.parse(patch)) if isinstance(patch, str) else None

    def rows(text: str | None, own: str | None = None) -> Iterator[tuple]:
        if text is None or fixed is None and own is None:
            yield None, None
            return
        try:
            ops = fixed if fixed is not None else parse_patch(jsontext.parse(own))
            yield jsontext.render(apply_patch(jsontext.parse(text), ops)), None
        except (JsonError, PatchError) as e:
            yield None, failure(e)

    return mapped(df, [column(df, doc)] + ([] if fixed is not None else [patch]), f"{name} string, {ERROR}", rows)


def merge_documents(df: DataFrame, doc: str | Column, patch: str | Column, name: str = "merged") -> DataFrame:
    """df with the documents merged with a Merge Patch, a text or a column of texts."""
    fixed = checked(jsontext.parse(patch)) if isinstance(patch, str) else NOTHING

    def rows(text: str | None, own: str | None = None) -> Iterator[tuple]:
        if text is None or fixed is NOTHING and own is None:
            yield None, None
            return
        try:
            yield jsontext.render(merge(jsontext.parse(text), fixed if fixed is not NOTHING else checked(jsontext.parse(own)))), None
        except (JsonError, MergeError) as e:
            yield None, failure(e)

    return mapped(df, [column(df, doc)] + ([] if fixed is not NOTHING else [patch]), f"{name} string, {ERROR}", rows)


def validate(df: DataFrame, doc: str | Column) -> DataFrame:
    """df with valid, the root's kind, and the error's code, its offset in characters and in bytes, and what was expected
    there. Documents may be texts or bytes."""

    def rows(text: str | bytes | None) -> Iterator[tuple]:
        try:
            yield (None,) * 6 if text is None else (True, jsontext.kind(jsontext.parse(text)), None, None, None, None)
        except JsonError as e:
            if e.code == "InvalidUtf8":
                yield False, None, e.code, None, e.offset, e.expected
            else:
                read = text if isinstance(text, str) else text.decode()
                yield False, None, e.code, e.offset, len(read[: e.offset].encode("utf-8", "surrogatepass")), e.expected or None

    return mapped(df, [column(df, doc)], "valid boolean, kind string, error_code string, error_offset long, error_byte long, error_expected string", rows)


def decimals(df: DataFrame, number: str | Column, precision: int, scale: int, name: str = "dec") -> DataFrame:
    """df with a column of number texts as DECIMAL(precision, scale), where it holds them exactly; else NULL with an error.
    Any exponent is read, and nothing is rounded."""
    kind = pa.decimal128(precision, scale)

    def value(text: str) -> decimal.Decimal | None:
        sign, order, digits = jsontext.number_key(text)
        if not sign:
            return decimal.Decimal(0)
        digits, order = (digits[:-1].translate(jsontext.NINES), -order) if sign < 0 else (digits, order)
        if order > precision - scale or len(digits) - order > scale:
            return None
        return decimal.Decimal((int(sign < 0), tuple(map(int, digits)), order - len(digits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            bad = [t is not None and not jsontext.NUMBER.fullmatch(t) for t in texts]
            found = [None if t is None or b else value(t) for t, b in zip(texts, bad, strict=True)]
            with decimal.localcontext(prec=precision + 1):
                exact = pa.array([x if x is None else x.quantize(decimal.Decimal(1).scaleb(-scale)) for x in found], kind)
            errors = ["NotANumber" if b else "ValueNotRepresentable" if t is not None and x is None else None for t, b, x in zip(texts, bad, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), exact, pa.array([None if e is None else {"code": e, "detail": t} for e, t in zip(errors, texts, strict=True)], pa.struct([("code", pa.string()), ("detail", pa.string())]))], ["_row", name, "error"])

    own = [c for c in df.columns if c not in (name, "error")]
    src = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in own]).alias("_row"), column(df, number).alias("_in"))
    out = T.StructType([src.schema["_row"], T.StructField(name, T.DecimalType(precision, scale)), *T.StructType.fromDDL(ERROR).fields])
    return src.mapInArrow(run, out).select(*[F.col(f"_row.`{c}`") for c in own], name, "error")


def pointer_ancestors(df: DataFrame, pointer: str | Column) -> DataFrame:
    """df with a row for each prefix of a pointer, the empty one first: depth, ancestor, parent (NULL for the root) and the
    last token, unescaped. Column expressions only."""
    text = column(df, pointer)
    parts = F.split(text, "/", -1)
    out = df.withColumn("_parts", parts).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)))
    head = lambda n: F.array_join(F.slice("_parts", F.lit(1), n), "/")
    token = F.replace(F.replace(F.get("_parts", F.col("depth")), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    return out.withColumn("ancestor", head(F.col("depth") + 1)).withColumn("parent", F.when(F.col("depth") > 0, head(F.col("depth")))).withColumn("token", F.when(F.col("depth") > 0, token)).drop("_parts")


def scan_until(df: DataFrame, doc: str | Column, query: str | Query, most: int, registry: Registry = DEFAULT, limits: Limits = Limits()) -> DataFrame:
    """Nodes as `select_nodes` gives them, at most `most` in all: partitions are read until there are so many, and the rest of
    the input is left alone (Spark's limit takes few partitions first)."""
    found = select_nodes(df, doc, query, registry, limits)
    return found.where("error IS NULL").limit(most)


def canonical(df: DataFrame, doc: str | Column, name: str = "canon") -> DataFrame:
    """df with a canonical text, equal exactly for equal documents: deep equality as an ordinary join or group key."""

    def rows(text: str | None) -> Iterator[tuple]:
        try:
            yield None if text is None else jsontext.canon(jsontext.parse(text)), None
        except JsonError as e:
            yield None, failure(e)

    return mapped(df, [column(df, doc)], f"{name} string, {ERROR}", rows)
