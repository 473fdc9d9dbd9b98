"""Queries over documents that are made from the test tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquill.functions.registry import DEFAULT, LOGICAL, NODES, VALUE, Function
from docquill.operators import nodes
from docquill.operators.agreement import agreement
from docquill.operators.documents import canonical, count_nodes, decimals, merge_documents, nodelist, patch_documents, pointer_ancestors, resolve_pointer, select_nodes, validate, value_of
from docquill.operators.evaluate import Limits
from docquill.plans.native import hybrid_nodes, native_nodes
from docquill.plans.parser import parse
from docquill.plans.writer import write
from docquill.sources.jsontext import Num
from docquill.sources.readers import from_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Documents. Items are sorted by all of their columns, as line numbers repeat within an order.


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, doc: {"key", "status", "total", "items": [{"n", "part", "supp", "qty", "price", "flag"}]}."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    joined = orders.join(items, F.col("key") == F.col("l_orderkey"), "left").withColumn("items", F.coalesce("items", F.array()))
    return from_columns(joined, ["key", "status", "total", "items"]).select("key", "doc")


ITEMS = """
WITH it AS (SELECT o_orderkey AS key, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, l_quantity AS qty, l_extendedprice AS price, l_returnflag AS flag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS c
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
"""
FIRST = "(SELECT key, qty AS first_qty FROM it WHERE i = 0)"


def path(field: str) -> str:
    return f"'$[''items''][' || i || '][''{field}'']'"


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.col("props").alias("doc"))


def region_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, doc: {"name", "nations": [{"name", "customers": [{"id", "segment", "bal"}]}]}."""
    who = F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal"))
    customers = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(who)).alias("customers"))
    nations = read(spark, sf_dir, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    nation = F.struct(F.col("n_nationkey").alias("k"), F.struct(F.col("n_name").alias("name"), F.coalesce("customers", F.array()).alias("customers")).alias("v"))
    grouped = nations.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(nation)), lambda x: x["v"]).alias("nations"))
    regions = read(spark, sf_dir, "region").join(grouped, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), "nations")
    return from_columns(regions, ["name", "nations"]).select("name", "doc")


def conversation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, doc: {"id", "turns": [{"role", "text"}]}."""
    turn = F.struct("turn", F.struct("role", "text").alias("v"))
    got = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["v"]).alias("turns"))
    return from_columns(got.withColumn("id", F.col("conv_id")), ["id", "turns"]).select("conv_id", "doc")


TURNS = "WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)\n"

# Selectors.


@query(ITEMS + f"SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS BIGINT) AS ord, {path('qty')} AS path, CAST(qty AS DOUBLE) AS nval FROM it WHERE price < 1000")
def jsonpath_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(order_docs(spark, sf_dir), "doc", "$.items[?@.price < 1000].qty", json=False).select("key", "ord", "path", "nval")


@query(ITEMS + f"SELECT key, {path('qty')} AS path, CAST(qty AS DOUBLE) AS nval FROM it WHERE price < 1000")
def native_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = native_nodes(order_docs(spark, sf_dir), "doc", "$.items[?@.price < 1000].qty")
    return out.select("key", "path", F.try_variant_get("value", "$", "double").alias("nval"))


@query("SELECT event_id, '$[''k'']' AS path, CAST(json_extract(props, '$.k') AS DOUBLE) AS nval FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def jsonpath_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(event_docs(spark, sf_dir), "doc", "$.k").select("event_id", "path", "nval")


@query("SELECT event_id, CAST(1 AS BIGINT) AS n, props AS doc FROM events")
def jsonpath_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_nodes(event_docs(spark, sf_dir), "doc", "$").select("event_id", "n", "doc")


@query(ITEMS + f"SELECT key, CAST(i AS BIGINT) AS ord, {path('qty')} AS path, CAST(qty AS DOUBLE) AS nval FROM it")
def jsonpath_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(order_docs(spark, sf_dir), "doc", "$.items[*].qty", json=False).select("key", "ord", "path", "nval")


@query(ITEMS + f"SELECT key, {path('qty')} AS path, CAST(qty AS DOUBLE) AS nval FROM it WHERE i = c - 1")
def jsonpath_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(order_docs(spark, sf_dir), "doc", "$.items[-1].qty").select("key", "path", "nval")


@query(ITEMS + f"SELECT key, {path('part')} AS path, CAST(part AS DOUBLE) AS nval FROM it WHERE i = c - 2 OR i = 1")
def native_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = order_docs(spark, sf_dir)
    return native_nodes(docs, "doc", "$.items[-2].part").union(native_nodes(docs, "doc", "$.items[1].part")).select("key", "path", F.try_variant_get("value", "$", "double").alias("nval")).distinct()


@query(ITEMS + f"SELECT key, CAST((c - 1 - i) // 2 AS BIGINT) AS ord, {path('qty')} AS path, CAST(qty AS DOUBLE) AS nval FROM it WHERE (c - 1 - i) % 2 = 0")
def jsonpath_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(order_docs(spark, sf_dir), "doc", "$.items[::-2].qty").select("key", "ord", "path", "nval")


@query(ITEMS + f"SELECT key, {path('qty')} AS path, CAST(qty AS DOUBLE) AS nval FROM it WHERE i >= 1 AND i < c - 1")
def native_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native_nodes(order_docs(spark, sf_dir), "doc", "$.items[1:-1].qty").select("key", "path", F.try_variant_get("value", "$", "double").alias("nval"))


@query("SELECT o_orderkey AS key, CAST(0 AS BIGINT) AS ord, '$[''status'']' AS path, o_orderstatus AS sval FROM orders UNION ALL SELECT o_orderkey, 1, '$[''key'']', NULL FROM orders UNION ALL SELECT o_orderkey, 2, '$[''status'']', o_orderstatus FROM orders")
def jsonpath_selector_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(order_docs(spark, sf_dir), "doc", "$['status', 'key', 'status']").select("key", "ord", "path", "sval")


@query("""
SELECT r_name AS name, CAST(0 AS BIGINT) AS ord, '$[''name'']' AS path, r_name AS sval FROM region
UNION ALL SELECT r_name, CAST(i + 1 AS BIGINT), '$[''nations''][' || i || '][''name'']', n_name
FROM (SELECT r_name, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation JOIN region ON r_regionkey = n_regionkey)
""")
def jsonpath_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(region_docs(spark, sf_dir), "doc", "$..name").select("name", "ord", "path", "sval")


# Conditions.


@query(ITEMS + f"SELECT key, {path('price')} AS path, CAST(price AS DOUBLE) AS nval FROM it WHERE (qty > 40 OR flag = 'R') AND NOT price >= 50000")
def jsonpath_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(order_docs(spark, sf_dir), "doc", "$.items[?(@.qty > 40 || @.flag == 'R') && !(@.price >= 50000)].price").select("key", "path", "nval")


@query(ITEMS + f"SELECT key, {path('price')} AS path, CAST(price AS DOUBLE) AS nval FROM it WHERE (qty > 40 OR flag = 'R') AND NOT price >= 50000")
def native_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = native_nodes(order_docs(spark, sf_dir), "doc", "$.items[?(@.qty > 40 || @.flag == 'R') && !(@.price >= 50000)].price")
    return out.select("key", "path", F.try_variant_get("value", "$", "double").alias("nval"))


@query(ITEMS + "SELECT o_orderkey AS key, CAST(count(i) AS BIGINT) AS n FROM orders LEFT JOIN it ON key = o_orderkey AND flag = 'R' GROUP BY o_orderkey")
def jsonpath_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_nodes(order_docs(spark, sf_dir), "doc", "$.items[?@.part && @.flag == 'R' && !@.none]").select("key", "n")


@query(ITEMS + f"SELECT key, {path('qty')} AS path FROM it JOIN {FIRST} USING (key) WHERE qty = first_qty")
def jsonpath_root_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(order_docs(spark, sf_dir), "doc", "$.items[?@.qty == $.items[0].qty].qty").select("key", "path")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS nval FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) <= 50 AND CAST(json_extract(props, '$.k') AS DOUBLE) <> 7")
def jsonpath_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(event_docs(spark, sf_dir), "doc", "$[?@ <= 50.0 && @ != 7 && @.none <= $.none]").select("event_id", "nval")


# Functions.


@query(ITEMS + "SELECT key, '$[''items'']' AS path FROM (SELECT DISTINCT key, c FROM it) WHERE c >= 5")
def function_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(order_docs(spark, sf_dir), "doc", "$[?count(@[*]) >= 5]", json=False).select("key", "path")


@query(TURNS + "SELECT conv_id, '$[''turns''][' || i || '][''role'']' AS path, role AS sval FROM t WHERE length(text) > 60")
def function_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(conversation_docs(spark, sf_dir), "doc", "$.turns[?length(@.text) > 60].role").select("conv_id", "path", "sval")


@query(TURNS + "SELECT conv_id, '$[''turns''][' || i || '][''role'']' AS path, role AS sval FROM t WHERE length(text) > 60")
def native_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = native_nodes(conversation_docs(spark, sf_dir), "doc", "$.turns[?length(@.text) > 60].role")
    return out.select("conv_id", "path", F.try_variant_get("value", "$", "string").alias("sval"))


@query(ITEMS + "SELECT key, '$[''items'']' AS path FROM it WHERE qty > 45 GROUP BY key HAVING count(*) = 1 AND min(flag) = 'N'")
def function_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(order_docs(spark, sf_dir), "doc", "$[?value(@[?@.qty > 45].flag) == 'N']", json=False).select("key", "path")


@query(TURNS + "SELECT conv_id, '$[''turns''][' || i || '][''role'']' AS path FROM t WHERE regexp_full_match(role, 'user|assist.*')")
def function_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(conversation_docs(spark, sf_dir), "doc", "$.turns[?match(@.role, 'user|assist.*')].role").select("conv_id", "path")


@query(TURNS + "SELECT conv_id, '$[''turns''][' || i || ']' AS path FROM t WHERE regexp_matches(text, 'th[aeiou]n|er{2,}')")
def function_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_nodes(conversation_docs(spark, sf_dir), "doc", "$.turns[?search(@.text, 'th[aeiou]n|er{2,}')]", json=False).select("conv_id", "path")


@query(TURNS + "SELECT conv_id, '$[''turns''][' || i || ']' AS path FROM t WHERE regexp_matches(text, 'th[aeiou]n|er{2,}')")
def native_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native_nodes(conversation_docs(spark, sf_dir), "doc", "$.turns[?search(@.text, 'th[aeiou]n|er{2,}')]").select("conv_id", "path")


def is_even(v: object) -> bool:
    return isinstance(v, Num) and float(v.text) % 2 == 0


@query(ITEMS + f"SELECT key, {path('part')} AS path FROM it WHERE part % 2 = 0")
def function_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = DEFAULT.with_functions(Function("even", (VALUE,), LOGICAL, is_even))
    return select_nodes(order_docs(spark, sf_dir), "doc", "$.items[?even(@.part)].part", registry).select("key", "path")


@query(ITEMS + "SELECT o_orderkey AS key, CASE WHEN count(i) = 1 THEN CAST(sum(qty) AS DOUBLE) END AS nval FROM orders LEFT JOIN it ON key = o_orderkey AND flag = 'R' GROUP BY o_orderkey")
def value_of_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_of(order_docs(spark, sf_dir), "doc", "$.items[?@.flag == 'R'].qty").select("key", "nval")


@query(ITEMS + f"SELECT key, CAST(count(*) AS BIGINT) AS n, min({path('qty')}) AS first_path FROM it WHERE i < 2 GROUP BY key")
def nodelist_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nodelist(order_docs(spark, sf_dir), "doc", "$.items[:2].qty")
    return out.where(F.size("nodes") > 0).select("key", F.size("nodes").cast("long").alias("n"), F.col("nodes")[0]["path"].alias("first_path"))


# Location and edits.


@query(ITEMS + "SELECT o_orderkey AS key, CAST(qty AS DOUBLE) AS nval, CASE WHEN qty IS NULL THEN 'IndexOutOfRange' END AS code FROM orders LEFT JOIN it ON key = o_orderkey AND i = 0")
def pointer_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_pointer(order_docs(spark, sf_dir), "doc", "/items/0/qty").select("key", "nval", F.col("error.code").alias("code"))


@query(ITEMS + "SELECT o_orderkey AS key, flag AS sval, CASE WHEN flag IS NULL THEN 'IndexOutOfRange' END AS code FROM orders LEFT JOIN it ON key = o_orderkey AND i = o_orderkey % 4")
def pointer_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = F.concat(F.lit("/items/"), (F.col("key") % 4).cast("string"), F.lit("/flag"))
    return resolve_pointer(order_docs(spark, sf_dir), "doc", where).select("key", "sval", F.col("error.code").alias("code"))


@query("SELECT event_id, '{\"k\":' || (user_id % 5) || ',\"list\":[1,2,3]}' AS patched FROM events")
def patch_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "events").select("event_id", F.col("props").alias("doc"), F.concat(F.lit('[{"op":"add","path":"/list","value":[1,3]},{"op":"add","path":"/list/1","value":2},{"op":"copy","from":"/k","path":"/old"},{"op":"replace","path":"/k","value":'), (F.col("user_id") % 5).cast("string"), F.lit('},{"op":"move","from":"/old","path":"/gone"},{"op":"remove","path":"/gone"}]')).alias("patch"))
    return patch_documents(docs, "doc", F.col("patch")).select("event_id", "patched")


@query("SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) = 7 THEN '{\"k\":7,\"seven\":true}' END AS patched, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) = 7 THEN NULL ELSE 'TestFailed' END AS code FROM events")
def patch_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = '[{"op":"test","path":"/k","value":7.0},{"op":"add","path":"/seven","value":true}]'
    return patch_documents(event_docs(spark, sf_dir), "doc", patch).select("event_id", "patched", F.col("error.code").alias("code"))


@query("SELECT event_id, CAST(json_merge_patch(CAST(props AS JSON), CAST('{\"m\":{\"x\":1},\"u\":' || user_id || '}' AS JSON)) AS VARCHAR) AS merged FROM events")
def merge_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "events").select("event_id", F.col("props").alias("doc"), F.concat(F.lit('{"m":{"x":1,"y":null},"u":'), F.col("user_id").cast("string"), F.lit("}")).alias("patch"))
    out = merge_documents(docs, "doc", F.col("patch"))
    return out.select("event_id", F.regexp_replace("merged", '"k": ', '"k":').alias("merged"))


# Sources and the node table.


@query("SELECT event_id, event_id % 10 <> 0 AS valid, CASE WHEN event_id % 10 <> 0 THEN 'object' END AS kind, CASE WHEN event_id % 10 = 0 THEN 'TrailingContent' END AS error_code FROM events")
def validate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = event_docs(spark, sf_dir).withColumn("doc", F.when(F.col("event_id") % 10 == 0, F.concat("doc", F.lit(" x"))).otherwise(F.col("doc")))
    return validate(docs, "doc").select("event_id", "valid", "kind", "error_code")


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def canonical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal though written differently fall in one group."""
    spelled = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("doc", r"(\d+)", "$1.0")).otherwise(F.col("doc"))
    keyed = canonical(event_docs(spark, sf_dir).withColumn("doc", spelled), "doc")
    return keyed.groupBy("canon").agg(F.count("*").alias("n"), F.min(F.regexp_extract("doc", r"(\d+)", 1).cast("long")).alias("k")).select("k", "n")


@query("""
SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'object' AS kind, count(*) AS n FROM region UNION ALL SELECT 'object', count(*) FROM nation UNION ALL SELECT 'object', count(*) FROM customer
  UNION ALL SELECT 'array', count(*) FROM region UNION ALL SELECT 'array', count(*) FROM nation
  UNION ALL SELECT 'string', count(*) FROM region UNION ALL SELECT 'string', count(*) FROM nation UNION ALL SELECT 'string', count(*) FROM customer
  UNION ALL SELECT 'number', 2 * count(*) FROM customer) GROUP BY kind
""")
def nodes_shred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shredded(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


def shredded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.shred(region_docs(spark, sf_dir).withColumnRenamed("name", "region"), "doc", ["region"])


@query("SELECT r_name AS region, n_name AS sval FROM nation JOIN region ON r_regionkey = n_regionkey")
def nodes_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$.nations[*].name by joins."""
    all_ = shredded(spark, sf_dir)
    root = all_.where("parent IS NULL")
    nations = nodes.children(all_, root, ["region"]).where("name = 'nations'")
    return nodes.children(all_, nodes.children(all_, nations, ["region"]), ["region"]).where("name = 'name'").select("region", "sval")


@query("SELECT r_name AS region, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS rich FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def nodes_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """$.nations..bal, as numbers that end within the interval of `nations`; the order key compares exactly."""
    all_ = shredded(spark, sf_dir)
    within = nodes.descendants(nodes.named(all_, "bal"), all_.where("name = 'nations' AND depth = 1"), ["region"])
    big = F.struct(F.lit(1).alias("sign"), F.lit(4).cast("bigint").alias("magnitude"), F.lit("5").alias("digits"))
    return within.groupBy("region").agg(F.count("*").alias("n"), F.sum(F.when(F.col("nkey") > big, 1).otherwise(0)).alias("rich"))


@query("SELECT event_id, 'k' AS name, CAST(2 AS BIGINT) AS n FROM events WHERE event_id % 3 = 0")
def nodes_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = event_docs(spark, sf_dir).withColumn("doc", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k":1,'), F.substring("doc", 2, 1000))).otherwise(F.col("doc")))
    return nodes.duplicate_names(nodes.shred(docs, "doc", ["event_id"]), ["event_id"]).select("event_id", "name", "n")


# Limits, patterns from documents, further functions.


@query(ITEMS + "SELECT o_orderkey AS key, CASE WHEN count(i) <= 3 THEN CAST(count(i) AS BIGINT) END AS n, CASE WHEN count(i) > 3 THEN 'NodelistTooLarge' END AS code FROM orders LEFT JOIN it ON key = o_orderkey GROUP BY o_orderkey")
def limit_nodelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_nodes(order_docs(spark, sf_dir), "doc", "$.items[*]", limits=Limits(max_nodes=3)).select("key", "n", F.col("error.code").alias("code"))


def pattern_docs(spark: SparkSession, sf_dir: str, patterns: list[str]) -> DataFrame:
    """key, doc: {"re": one of the patterns, by key, "v": the order's status}."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("v"), F.get(F.array(*map(F.lit, patterns)), (F.col("o_orderkey") % len(patterns)).cast("int")).alias("re"))
    return from_columns(orders, ["re", "v"]).select("key", "doc")


@query("SELECT o_orderkey AS key, '$[''v'']' AS path, o_orderstatus AS sval FROM orders WHERE (o_orderkey % 4 = 0 AND o_orderstatus IN ('F', 'P')) OR (o_orderkey % 4 = 1 AND o_orderstatus <> 'O') OR o_orderkey % 4 = 3")
def function_pattern_from_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second pattern negates a class, the third isn't I-Regexp and matches nothing, the fourth is a category."""
    docs = pattern_docs(spark, sf_dir, ["F|P", "[^O]", "(?:O)", "\\p{Lu}"])
    return select_nodes(docs, "doc", "$[?match(@, $.re)]").select("key", "path", "sval")


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS n, CASE WHEN o_orderkey % 2 = 1 THEN 'RegexTooComplex' END AS code FROM orders")
def limit_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern of more than 50 instructions is an error of its document."""
    docs = pattern_docs(spark, sf_dir, [".*", "(x{10}){10}"])
    return count_nodes(docs, "doc", "$[?search(@, $.re) && length(@) == 1]", limits=Limits(max_regex=50)).select("key", F.col("n").cast("int").alias("n"), F.col("error.code").alias("code"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM events WHERE event_id % 3 = 0")
def function_member_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = event_docs(spark, sf_dir).withColumn("doc", F.concat(F.lit('{"o":'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"more":[],'), F.substring("doc", 2, 1000))).otherwise(F.col("doc")), F.lit("}")))
    return count_nodes(docs, "doc", "$[?count(@.*) == 2].*").where("n > 0").select("event_id", "n")


@query(ITEMS + "SELECT key, '$[''items'']' AS path FROM it GROUP BY key HAVING max(qty) > 45")
def function_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension of a nodelist that gives a value, compared."""
    most = Function("most", (NODES,), VALUE, lambda nodes: max((v for v, _ in nodes if isinstance(v, Num)), key=lambda v: v.key, default=None))
    return select_nodes(order_docs(spark, sf_dir), "doc", "$[?most(@[*].qty) > 45]", DEFAULT.with_functions(most), json=False).select("key", "path")


@query(ITEMS + f"SELECT key, {path('n')} AS path FROM it WHERE (qty > 30) <> (flag = 'R')")
def function_of_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension of two conditions."""
    either = Function("either", (LOGICAL, LOGICAL), LOGICAL, lambda a, b: a != b)
    return select_nodes(order_docs(spark, sf_dir), "doc", "$.items[?either(@.qty > 30, @.flag == 'R')].n", DEFAULT.with_functions(either)).select("key", "path")


@query(ITEMS + "SELECT o_orderkey AS key, CASE WHEN count(i) > 0 THEN 'ExtensionResultMismatch' END AS code FROM orders LEFT JOIN it ON key = o_orderkey GROUP BY o_orderkey")
def function_wrong_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an extension gives is checked against its declaration; the error is the document's."""
    wrong = Function("wrong", (VALUE,), LOGICAL, lambda v: 1)
    return count_nodes(order_docs(spark, sf_dir), "doc", "$.items[?wrong(@.n)]", registry=DEFAULT.with_functions(wrong)).select("key", F.col("error.code").alias("code"))


@query("SELECT event_id, '$[''p'']' AS path FROM events WHERE event_id % 3 <> 1")
def deep_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects are equal whatever the order of members and the spelling of numbers; arrays are not whatever their order."""
    k = F.get_json_object("props", "$.k")
    other = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"l":[1.0,{"x":null}],"k":'), k, F.lit(".0}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"k":'), k, F.lit(',"l":[{"x":null},1]}'))).otherwise(F.concat(F.lit('{"k":'), k, F.lit('e0,"l":[10e-1,{"x":null}]}')))
    docs = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"p":{"a":{"k":'), k, F.lit(',"l":[1,{"x":null}]},"b":'), other, F.lit("}}")).alias("doc"))
    return select_nodes(docs, "doc", "$[?@.a == @.b]", json=False).select("event_id", "path")


# Query texts, paths, numbers, pointers.


@query(ITEMS + "SELECT key, '$[''items''][?@[''qty''] > 45 && @[''flag''] == ''N''][''qty'']' AS query, CAST(qty AS DOUBLE) AS nval FROM it WHERE qty > 45 AND flag = 'N'")
def written_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query is read, written in the one normal spelling, and run from that."""
    text = write(parse('$ .items [? (@["qty"]>45&&@.flag=="N") ] ["qty"]'))
    return select_nodes(order_docs(spark, sf_dir), "doc", text, json=False).select("key", F.lit(text).alias("query"), "nval")


@query(ITEMS + f"SELECT key, {path('qty')} AS path FROM it WHERE i < 2")
def path_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes are the same if their Normalized Paths are: the nodes that two queries share, by a join on document and path."""
    docs = order_docs(spark, sf_dir)
    a, b = (select_nodes(docs, "doc", q, json=False).select("key", "path") for q in ("$..qty", "$.items[:2]['n','qty']"))
    return a.join(b, ["key", "path"])


@query("SELECT event_id, '-' || CAST(json_extract(props, '$.k') AS VARCHAR) || '.500E+00' AS json, -CAST(json_extract(props, '$.k') AS DOUBLE) - 0.5 AS nval FROM events")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number's spelling is kept."""
    docs = event_docs(spark, sf_dir).withColumn("doc", F.regexp_replace("doc", r"(\d+)", "-$1.500E+00"))
    return select_nodes(docs, "doc", "$.k").select("event_id", "json", "nval")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(CAST(json_extract(props, '$.k') AS DECIMAL(12,3)) + 0.125 AS DECIMAL(12,3)) END AS dec, CASE WHEN event_id % 2 = 1 THEN 'ValueNotRepresentable' END AS code FROM events")
def number_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact decimals out: three places are held, four are not."""
    text = F.concat(F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 2 == 0, ".12500e0").otherwise(".1255"))
    out = decimals(read(spark, sf_dir, "events").select("event_id", text.alias("num")), "num", 12, 3)
    return out.select("event_id", "dec", F.col("error.code").alias("code"))


@query(ITEMS + "SELECT o_orderkey AS key, flag AS sval, CASE WHEN flag IS NULL THEN 'IndexOutOfRange' END AS code FROM orders LEFT JOIN it ON key = o_orderkey AND i = 1")
def pointer_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_pointer(order_docs(spark, sf_dir), "doc", "#/it%65ms/1/fl%61g", fragment=True).select("key", "sval", F.col("error.code").alias("code"))


@query("""
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, depth, CASE depth WHEN 0 THEN '' WHEN 1 THEN '/a~1b' WHEN 2 THEN '/a~1b/' || c_custkey ELSE '/a~1b/' || c_custkey || '/x~0' END AS ancestor,
  CASE depth WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '/a~1b' ELSE '/a~1b/' || c_custkey END AS parent, CASE depth WHEN 1 THEN 'a/b' WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 3 THEN 'x~' END AS token
FROM customer, (SELECT unnest([0, 1, 2, 3]) AS depth)
""")
def pointer_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of a pointer, a row each."""
    own = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.concat(F.lit("/a~1b/"), F.col("c_custkey").cast("string"), F.lit("/x~0")).alias("p"))
    return pointer_ancestors(own, "p").select("c_custkey", "depth", "ancestor", "parent", "token")


# Edits that fail, bytes that aren't UTF-8.


PATCHES = {
    "NotAnArray": '{"op":"test"}',
    "NotAnObject": "[1]",
    "MissingMember": '[{"op":"add","path":"/x"}]',
    "DuplicateMember": '[{"op":"remove","op":"remove","path":"/k"}]',
    "NotAString": '[{"op":"remove","path":7}]',
    "UnknownOperation": '[{"op":"put","path":"/x","value":1}]',
    "InvalidPointer": '[{"op":"remove","path":"k"}]',
    "PathNotFound": '[{"op":"add","path":"/x","value":{}},{"op":"remove","path":"/none"}]',
    "FromNotFound": '[{"op":"copy","from":"/none","path":"/x"}]',
    "RootRemoved": '[{"op":"remove","path":""}]',
    "MoveIntoChild": '[{"op":"move","from":"","path":"/x"}]',
    "TestFailed": '[{"op":"test","path":"/k","value":null}]',
}


@query("SELECT event_id, [" + ", ".join(f"'{c}'" for c in PATCHES) + f"][CAST(event_id % {len(PATCHES)} AS BIGINT) + 1] AS code, CASE event_id % {len(PATCHES)} WHEN 0 THEN '' WHEN 7 THEN '1' ELSE '0' END AS operation FROM events")
def patch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way for a patch to fail, with the number of the operation."""
    own = F.get(F.array(*map(F.lit, PATCHES.values())), (F.col("event_id") % len(PATCHES)).cast("int"))
    out = patch_documents(event_docs(spark, sf_dir).withColumn("patch", own), "doc", F.col("patch"))
    return out.select("event_id", F.col("error.code").alias("code"), F.regexp_extract("error.detail", r"in operation (\d+)", 1).alias("operation"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'TargetDuplicateName' WHEN 1 THEN 'DuplicateName' END AS code, CASE event_id % 3 WHEN 2 THEN '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"n\":{}}' END AS merged FROM events")
def merge_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the target or the patch repeats; a name that the target repeats elsewhere does no harm."""
    docs = event_docs(spark, sf_dir).withColumn("doc", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"n":1,"n":2,'), F.substring("doc", 2, 1000))).otherwise(F.col("doc")))
    own = F.when(F.col("event_id") % 3 == 1, '{"n":{},"n":{}}').otherwise('{"n":{"x":null}}')
    out = merge_documents(docs.withColumn("patch", own), "doc", F.col("patch"))
    return out.select("event_id", F.col("error.code").alias("code"), F.regexp_replace("merged", '"k": ', '"k":').alias("merged"))


@query("SELECT event_id, false AS valid, 'InvalidUtf8' AS error_code, CAST(5 AS BIGINT) AS error_byte FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, false, 'InvalidJson', CAST(9 AS BIGINT) FROM events WHERE event_id % 4 = 2 UNION ALL SELECT event_id, true, NULL, NULL FROM events WHERE event_id % 4 IN (0, 3)")
def validate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes; places in bytes."""
    wrong = F.when(F.col("event_id") % 4 == 1, F.unhex(F.lit("7B226B22" + "3AFF7D"))).when(F.col("event_id") % 4 == 2, F.encode(F.lit('{"é中":?}'), "UTF-8")).otherwise(F.encode("doc", "UTF-8"))
    return validate(event_docs(spark, sf_dir).withColumn("doc", wrong), "doc").select("event_id", "valid", "error_code", "error_byte")


# The hybrid tier, and more of the node table.


@query(ITEMS + f"SELECT key, {path('qty')} AS path, CAST(qty AS DOUBLE) AS nval FROM it WHERE price < 1000 OR c % 5 = 0")
def hybrid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a repeated name (every fifth count of items) are refused by VARIANT and go through the exact tier; with
    the name's first value 1e0 every item of theirs is found."""
    docs = order_docs(spark, sf_dir)
    again = F.when(F.size(F.from_json("doc", "items array<struct<n:int>>")["items"]) % 5 == 0, F.regexp_replace("doc", '"price":', '"price":1e0,"price":')).otherwise(F.col("doc"))
    return hybrid_nodes(docs.withColumn("doc", again), "doc", "$.items[?@.price < 1000].qty").select("key", "path", "nval")


@query(ITEMS + "SELECT key, '$[''items'']' AS path FROM it GROUP BY key HAVING count(*) >= 5")
def native_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native_nodes(order_docs(spark, sf_dir), "doc", "$[?count(@[*]) >= 5 && @.*]").select("key", "path")


@query("SELECT r_name AS region, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_mktsegment <> 'BUILDING' GROUP BY r_name")
def nodes_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a member segment of that value: an anti-join."""
    all_ = shredded(spark, sf_dir)
    building = all_.where("name = 'segment' AND sval = 'BUILDING'")
    return nodes.without(building, all_.where("kind = 'object' AND depth = 4"), ["region"]).groupBy("region").agg(F.count("*").alias("n"))


@query("SELECT CAST(e.event_id AS BIGINT) AS event_id, n.n_name FROM events e JOIN nation n ON CAST(json_extract(e.props, '$.k') AS BIGINT) = n.n_nationkey")
def nodes_equal_across_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal values of two frames' documents, however the numbers are written: an equi-join on the exact number."""
    events = nodes.shred(event_docs(spark, sf_dir).withColumn("event_id", F.col("event_id").cast("long")), "doc", ["event_id"])
    own = read(spark, sf_dir, "nation").select("n_name", F.concat(F.lit('{"id":'), F.col("n_nationkey").cast("string"), F.lit(".0e0}")).alias("doc"))
    return nodes.equal_nodes(events, nodes.shred(own, "doc", ["n_name"]), ["event_id"], ["n_name"])


@query("SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"l\":[1.50,{\"k\":null},\"x\"],\"k\":true}' AS doc FROM events")
def nodes_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From text to the node table and back: order, spellings and repeated names stay."""
    text = F.concat(F.lit(' {"k" : '), F.get_json_object("doc", "$.k"), F.lit(', "l": [1.50, {"k":null}, "x"],\n"k":true}'))
    return nodes.assembled(nodes.shred(event_docs(spark, sf_dir).withColumn("doc", text), "doc", ["event_id"]), ["event_id"]).select("event_id", "doc")


@query("SELECT CAST(json_extract(props, '$.k') AS DOUBLE) AS nval, CAST(count(*) AS BIGINT) AS n FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 90 GROUP BY 1")
def stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files: nodes by a row transform, counts by a stateful aggregate, read when all has come."""
    batch = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/event[s].parquet").select(F.col("props").alias("doc"))
    found = select_nodes(stream, "doc", "$[?@ >= 90]", json=False).groupBy("nval").agg(F.count("*").alias("n"))
    name = f"stream_{uuid.uuid4().hex}"
    running = found.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


TIERS = {"$[*].k": True, "$.items[?@.qty > 10 || @.flag == 'R'].price": True, "$..qty": False, "$.items[?@.part == $.key]": False, "$.items[?count(@.*) == 6 && @.n != 1]": True, "$.items[?search(@.flag, '[NR]+x*')]": True, "$.items[?search(@.flag, '(N|R)+x*')]": False}


@query(" UNION ALL ".join(f"SELECT '{q.replace(chr(39), chr(39) * 2)}' AS query, {str(covered).lower()} AS native, CAST(0 AS BIGINT) AS n" for q, covered in TIERS.items()))
def tier_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that only one of the exact and the hybrid tier finds, by query: none."""
    return agreement(order_docs(spark, sf_dir), ["key"], "doc", [*TIERS])
