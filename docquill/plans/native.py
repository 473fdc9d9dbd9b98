"""Queries as Catalyst plans over VARIANT: names by path, children by a lateral generator, filters as predicates.

For queries of names, indexes, slices, wildcards and filters without `..`. Numbers are compared as doubles, and objects'
members come in name order, as VARIANT keeps them; where this matters, or a query isn't covered, use the exact
operators, or `hybrid_nodes`, which takes this tier where it agrees with them. Each predicate is two-valued: NULL never leaves it.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquill.functions.iregexp import TooComplex, compiled, java_pattern, risky
from docquill.operators.documents import select_nodes
from docquill.plans.ast import And, Call, Compare, Exists, Filter, Holds, Index, Literal, Name, Not, Or, Query, Slice, Wildcard
from docquill.plans.parser import parse
from docquill.plans.writer import quoted
from docquill.sources.jsontext import Num

NUMERIC = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


class Unsupported(ValueError):
    pass


def member(name: str) -> str:
    if "'" in name and '"' in name or "\\" in name:
        raise Unsupported(name)
    return f"['{name}']" if '"' in name else f'["{name}"]'


def singular(q: Query, current: Column, root: Column) -> Column:
    """The value of a singular query as VARIANT, NULL for Nothing."""
    v = current if not q.absolute else root
    path = "$"
    for s in q.segments:
        x = s.selectors[0]
        if isinstance(x, Name):
            path += member(x.name)
        elif x.index >= 0:
            path += f"[{x.index}]"
        else:
            array = elements(F.try_variant_get(v, path, "variant"))
            v, path = F.get(array, F.size(array) + x.index), "$"
    return F.try_variant_get(v, path, "variant") if path != "$" else v


def elements(v: Column) -> Column:
    return v.try_cast("array<variant>")


def kind_is(v: Column, pattern: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).rlike(pattern), F.lit(False))


def exact_double(n: Num) -> bool:
    """Whether no other number of at most 15 digits shares this one's double."""
    return len(n.key[2].rstrip("~")) <= 15 and abs(n.key[1]) < 300


class Operand:
    """A comparison's side: whether it exists, is a number or a string, and these."""

    def __init__(self, exists: Column, is_number: Column, number: Column, is_text: Column, text: Column, other: Column) -> None:
        self.exists, self.is_number, self.number, self.is_text, self.text, self.other = exists, is_number, number, is_text, text, other


def of_variant(v: Column) -> Operand:
    return Operand(v.isNotNull(), kind_is(v, NUMERIC), F.try_variant_get(v, "$", "double"), kind_is(v, "^STRING"), F.try_variant_get(v, "$", "string"), F.when(kind_is(v, "^(BOOLEAN|VOID)$"), F.to_json(v)))


def operand(x, current: Column, root: Column) -> Operand:
    no, none = F.lit(False), F.lit(None)
    if isinstance(x, Query):
        return of_variant(singular(x, current, root))
    if isinstance(x, Literal):
        if isinstance(x.value, Num):
            if not exact_double(x.value):
                raise Unsupported(x.value.text)
            return Operand(F.lit(True), F.lit(True), F.lit(float(x.value.text)), no, none.cast("string"), none.cast("string"))
        if isinstance(x.value, str):
            return Operand(F.lit(True), no, none.cast("double"), F.lit(True), F.lit(x.value), none.cast("string"))
        return Operand(F.lit(True), no, none.cast("double"), no, none.cast("string"), F.lit(json.dumps(x.value)))
    if isinstance(x, Call) and x.name == "length" and isinstance(x.args[0], Query):
        v = singular(x.args[0], current, root)
        n = F.when(kind_is(v, "^STRING"), F.char_length(F.try_variant_get(v, "$", "string"))).when(kind_is(v, "^(ARRAY|OBJECT)"), members(v))
        return Operand(n.isNotNull(), n.isNotNull(), n.cast("double"), no, none.cast("string"), none.cast("string"))
    if isinstance(x, Call) and x.name == "count" and isinstance(x.args[0], Query) and (above := all_below(x.args[0])):
        return Operand(F.lit(True), F.lit(True), members(singular(above, current, root)).cast("double"), no, none.cast("string"), none.cast("string"))
    raise Unsupported(str(x))


def members(v: Column) -> Column:
    """How many children a value has."""
    return F.coalesce(F.size(elements(v)), F.size(F.map_keys(v.try_cast("map<string,variant>"))), F.lit(0))


def all_below(q: Query) -> Query | None:
    """The singular query whose children q selects, if it is of that kind."""
    if not q.segments or q.segments[-1].descendant or q.segments[-1].selectors != (Wildcard(),):
        return None
    above = Query(q.segments[:-1], q.absolute)
    return above if above.singular else None


def compared(c: Compare, current: Column, root: Column) -> Column:
    if all(isinstance(x, Query) for x in (c.left, c.right)) and c.op in ("==", "!=", "<=", ">="):
        raise Unsupported("comparison of two queries")  # deep equality needs the exact operators
    a, b, op = operand(c.left, current, root), operand(c.right, current, root), c.op
    if op in (">", ">="):
        a, b, op = b, a, {">": "<", ">=": "<="}[op]
    both = lambda x: F.coalesce(x, F.lit(False))
    # Kinds are asked last, as they cost more than the values.
    equal = both(~a.exists & ~b.exists) | both((a.number == b.number) & a.is_number & b.is_number) | both((a.text == b.text) & a.is_text & b.is_text) | both(a.other == b.other)
    less = both((a.number < b.number) & a.is_number & b.is_number) | both((a.text < b.text) & a.is_text & b.is_text)
    return {"==": equal, "!=": ~equal, "<": less, "<=": less | equal}[op]


def plain_pattern(pattern: str, whole: bool) -> str | None:
    """The pattern for rlike; Unsupported if backtracking may explode, or if it is beyond the size limit."""
    try:
        found = compiled(pattern)
    except TooComplex:
        raise Unsupported(pattern[:80]) from None
    if found is not None and risky(found.node):
        raise Unsupported(pattern[:80])
    return java_pattern(pattern, whole)


def condition(c, current: Column, root: Column) -> Column:
    match c:
        case Or(terms):
            return reduce(lambda a, b: a | b, [condition(t, current, root) for t in terms])
        case And(terms):
            return reduce(lambda a, b: a & b, [condition(t, current, root) for t in terms])
        case Not(term):
            return ~condition(term, current, root)
        case Exists(query) if query.singular:
            return singular(query, current, root).isNotNull()
        case Exists(query) if (above := all_below(query)) is not None:
            return members(singular(above, current, root)) > 0
        case Compare():
            return compared(c, current, root)
        case Holds(Call(name, (Query() as text, Literal(pattern)))) if name in ("match", "search") and text.singular:
            found = plain_pattern(pattern, name == "match") if isinstance(pattern, str) else None
            v = singular(text, current, root)
            return F.coalesce(F.try_variant_get(v, "$", "string").rlike(found), F.lit(False)) & kind_is(v, "^STRING") if found is not None else F.lit(False)
    raise Unsupported(str(c))


def escaped(name: Column) -> Column:
    """A name as Normalized Paths write it."""
    plain = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    for c, short in (("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(c), F.lit(short))
    for c in (*range(8), 11, *range(14, 32)):
        plain = F.replace(plain, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return F.concat(F.lit("['"), plain, F.lit("']"))


def selected(df: DataFrame, s) -> DataFrame:
    """One selector on every node: columns _row, _root, _v, _path, _ord."""
    held, path, order = ["_row", "_root"], F.col("_path"), F.col("_ord")
    if isinstance(s, Name):
        return df.select(*held, F.try_variant_get("_v", "$" + member(s.name), "variant").alias("_v"), F.concat(path, F.lit(f"[{quoted(s.name)}]")).alias("_path"), F.concat(order, F.array(F.lit(0))).alias("_ord")).where("_v IS NOT NULL")
    if isinstance(s, Index) and s.index >= 0:
        return df.select(*held, F.try_variant_get("_v", f"$[{s.index}]", "variant").alias("_v"), F.concat(path, F.lit(f"[{s.index}]")).alias("_path"), F.concat(order, F.array(F.lit(0))).alias("_ord")).where("_v IS NOT NULL")
    if isinstance(s, (Index, Slice)):
        n = F.size("_a")
        if isinstance(s, Index):
            places = F.when(n + s.index >= 0, F.array(n + s.index))
        else:
            places = slice_places(s, n)
        arrays = df.withColumn("_a", elements(F.col("_v"))).where("_a IS NOT NULL")
        out = arrays.select(*held, "_path", "_ord", "_a", F.posexplode(places).alias("_k", "_i"))
        return out.select(*held, F.get("_a", F.col("_i")).alias("_v"), F.concat(path, F.lit("["), F.col("_i").cast("string"), F.lit("]")).alias("_path"), F.concat(order, F.array("_k")).alias("_ord"))
    exploded = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    if isinstance(s, Filter):
        exploded = exploded.where(condition(s.condition, F.col("value"), F.col("_root")))
    elif not isinstance(s, Wildcard):
        raise Unsupported(str(s))
    step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(escaped(F.col("key")))
    return exploded.select(*held, F.col("value").alias("_v"), F.concat(path, step).alias("_path"), F.concat(order, F.array("pos")).alias("_ord"))


def slice_places(s: Slice, n: Column) -> Column:
    step = 1 if s.step is None else s.step
    if not step:
        return F.array().cast("array<int>")
    at = lambda i: F.lit(i) if i >= 0 else n + i
    if step > 0:
        low = F.least(F.greatest(at(s.start or 0), F.lit(0)), n)
        high = F.least(F.greatest(n if s.end is None else at(s.end), F.lit(0)), n)
        return F.when(low < high, F.sequence(low, high - 1, F.lit(step)))
    up = n - 1 if s.start is None else F.least(F.greatest(at(s.start), F.lit(-1)), n - 1)
    low = F.lit(-1) if s.end is None else F.least(F.greatest(at(s.end), F.lit(-1)), n - 1)
    return F.when(up > low, F.sequence(up, low + 1, F.lit(step)))


def native_nodes(df: DataFrame, doc: str | Column, query: str | Query) -> DataFrame:
    """df's columns with path, ord (an array that orders a document's nodes) and value (VARIANT) for each node; these names
    hide columns of df that have them. doc is a text, or a VARIANT that has been read before. A text that VARIANT doesn't take (no JSON, a repeated name, one too large) has no
    nodes here: `hybrid_nodes` gives those to the exact tier. Raises Unsupported for queries beyond this tier."""
    q = parse(query) if isinstance(query, str) else query
    own = [c for c in df.columns if c != doc and c not in ("path", "ord", "value")]
    text = F.col(doc) if isinstance(doc, str) else doc
    read = df.select(text).schema[0].dataType.typeName() == "variant"
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in own])
    nodes = df.select(row.alias("_row"), (text if read else F.try_parse_json(text)).alias("_root")).select("_row", "_root", F.col("_root").alias("_v"), F.lit("$").alias("_path"), F.array().cast("array<int>").alias("_ord")).where("_v IS NOT NULL")
    for s in q.segments:
        if s.descendant:
            raise Unsupported("..")
        parts = [selected(nodes.withColumn("_ord", F.concat("_ord", F.array(F.lit(k)))) if len(s.selectors) > 1 else nodes, x) for k, x in enumerate(s.selectors)]
        nodes = reduce(DataFrame.unionAll, parts)
    return nodes.select(*[F.col(f"_row.`{c}`") for c in own], F.col("_path").alias("path"), F.col("_ord").alias("ord"), F.col("_v").alias("value"))


# A number that a double may not tell from another one: 16 digits or more, or an exponent.
INEXACT = r"[0-9][0-9.]{15,}|[0-9][eE][+-]?[0-9]"


def plain(doc: str) -> Column:
    """Whether the native tier takes a document: VARIANT reads it, and a double tells its numbers apart."""
    return F.try_parse_json(F.col(doc)).isNotNull() & ~F.col(doc).rlike(INEXACT)


def native_part(df: DataFrame, doc: str, query: str | Query) -> DataFrame:
    """What `hybrid_nodes` has of the native tier: the nodes of plain documents. Raises Unsupported."""
    kept = [c for c in df.columns if c == doc or c not in ("path", "kind", "sval", "nval", "error")]
    out = [c for c in kept if c != doc] + ["path", "kind", "sval", "nval", "error"]
    found = native_nodes(df.select(kept).where(plain(doc)), doc, query)
    v = F.col("value")
    number = kind_is(v, NUMERIC)
    kind = F.when(number, "number").when(kind_is(v, "^STRING"), "string").when(kind_is(v, "^OBJECT"), "object").when(kind_is(v, "^ARRAY"), "array").when(kind_is(v, "^VOID"), "null").otherwise(F.to_json(v))
    return found.withColumns({"kind": kind, "sval": F.when(kind_is(v, "^STRING"), F.try_variant_get(v, "$", "string")), "nval": F.when(number, F.try_variant_get(v, "$", "double")), "error": F.lit(None).cast("struct<code:string,detail:string>")}).select(out)


def exact_part(df: DataFrame, doc: str) -> DataFrame:
    """The documents that `hybrid_nodes` gives to the exact tier, for queries that the native tier covers."""
    return df.where(F.col(doc).isNotNull() & ~plain(doc))


def hybrid_nodes(df: DataFrame, doc: str, query: str | Query) -> DataFrame:
    """df's columns with path, kind, sval, nval and error for each node, in no order: as a VARIANT plan where that gives what
    the exact operators give, and by these for the rest: documents that VARIANT refuses or whose numbers a double may not
    tell apart, and whole queries that the native tier doesn't cover."""
    q = parse(query) if isinstance(query, str) else query
    kept = [c for c in df.columns if c == doc or c not in ("path", "kind", "sval", "nval", "error")]
    out = [c for c in kept if c != doc] + ["path", "kind", "sval", "nval", "error"]
    exact = lambda rows: select_nodes(rows.select(kept), doc, q, json=False).select(out)
    try:
        native = native_part(df, doc, q)
    except Unsupported:
        return exact(df)
    return native.unionAll(exact(exact_part(df, doc)))
