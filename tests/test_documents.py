import json

import pytest
from pyspark.sql import functions as F

from docquill.functions.registry import DEFAULT, LOGICAL, VALUE, Function
from docquill.operators import nodes
from docquill.operators.documents import canonical, count_nodes, decimals, merge_documents, nodelist, patch_documents, pointer_ancestors, resolve_pointer, scan_until, select_nodes, validate, value_of
from docquill.operators.evaluate import Evaluator, Limits, render
from docquill.plans.native import Unsupported, hybrid_nodes, native_nodes
from docquill.plans.parser import parse
from docquill.sources import jsontext, readers
from tests.test_jsonpath import EXAMPLES

DOCS = [(1, '{"a":[{"p":5,"s":"x"},{"p":15.5},{"q":null}],"lim":10}'), (2, '{"a":{"z":{"p":1},"y":[]}}'), (3, "[1,"), (4, None), (5, '{"p":1e400,"p":2}'), (6, '"text"')]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, doc string").withColumn("kind", F.lit("clash"))


def test_select_nodes(docs):
    rows = select_nodes(docs, "doc", "$.a[?@.p]").orderBy("id", "ord").collect()
    assert [(r["id"], r["ord"], r["path"], r["kind"]) for r in rows] == [(1, 0, "$['a'][0]", "object"), (1, 1, "$['a'][1]", "object"), (2, 0, "$['a']['z']", "object"), (3, None, None, None)]
    assert rows[-1]["error"]["code"] == "InvalidJson" and json.loads(rows[0]["json"]) == {"p": 5, "s": "x"}
    assert [r["nval"] for r in select_nodes(docs, "doc", "$..p").where("id < 3").orderBy("id", "ord").collect()] == [5.0, 15.5, 1.0]


def test_columns(docs):
    got = {r["id"]: r for r in count_nodes(docs, "doc", "$..p").collect()}
    assert [got[k]["n"] for k in (1, 2, 3, 4, 5, 6)] == [2, 1, None, None, 1, 0] and got[3]["error"]["code"] == "InvalidJson"
    got = {r["id"]: r for r in nodelist(docs, "doc", "$.a[*]").collect()}
    assert [n["path"] for n in got[2]["nodes"]] == ["$['a']['z']", "$['a']['y']"] and got[4]["nodes"] is None and got[6]["nodes"] == []
    got = {r["id"]: r for r in value_of(docs, "doc", "$.lim").collect()}
    assert (got[1]["nval"], got[2]["kind"]) == (10.0, None)
    got = {r["id"]: r for r in validate(docs, "doc").collect()}
    assert [got[k]["valid"] for k in (1, 3, 4, 6)] == [True, False, None, True] and got[3]["error_offset"] == 3


def test_limits_and_extensions(docs):
    got = {r["id"]: r for r in count_nodes(docs, "doc", "$.a[*]", limits=Limits(max_nodes=2)).collect()}
    assert got[1]["error"]["code"] == "NodelistTooLarge" and got[2]["n"] == 2
    registry = DEFAULT.with_functions(Function("is_x", (VALUE,), LOGICAL, lambda v: v == "x"))
    assert select_nodes(docs.where("id = 1"), "doc", "$.a[?is_x(@.s)]", registry).count() == 1


def test_locate_and_edit(docs):
    got = {r["id"]: r for r in resolve_pointer(docs, "doc", "/a/0/p").collect()}
    assert got[1]["nval"] == 5.0 and got[2]["error"]["code"] == "MemberNotFound" and got[6]["error"]["code"] == "NotAContainer" and got[4]["error"] is None
    assert {r["id"]: r["kind"] for r in resolve_pointer(docs, "doc", "#/a", fragment=True).collect()}[2] == "object"
    got = {r["id"]: r for r in patch_documents(docs, "doc", '[{"op":"add","path":"/new","value":[1]},{"op":"remove","path":"/lim"}]').collect()}
    assert got[1]["patched"].endswith('"new":[1]}') and got[2]["patched"] is None and got[2]["error"]["code"] == "PathNotFound" and got[4]["patched"] is None
    got = {r["id"]: r for r in merge_documents(docs, "doc", F.lit('{"lim":null,"k":{"x":null}}')).collect()}
    assert got[6]["merged"] == '{"k":{}}' and "lim" not in got[1]["merged"] and got[5]["error"]["code"] == "TargetDuplicateName"


def test_canonical_equality_joins(spark):
    a = canonical(spark.createDataFrame([(1, '{"a":1,"b":[2.0]}'), (2, "[1e2]")], "id long, doc string"), "doc")
    b = canonical(spark.createDataFrame([(7, '{"b":[2],"a":1.0}'), (8, "[1e3]")], "other long, doc string"), "doc").drop("doc", "error")
    assert [(r["id"], r["other"]) for r in a.join(b, "canon").collect()] == [(1, 7)]


def test_node_table(spark, docs):
    table = nodes.shred(docs, "doc", ["id"])
    one = table.where("id = 1").orderBy("pre").collect()
    assert [r["path"] for r in one][:3] == ["$", "$['a']", "$['a'][0]"] and one[0]["post"] == len(one) - 1
    assert [r["path"] for r in nodes.named(table, "p").where("id = 1").orderBy("pre").collect()] == [render(p) for _, p in Evaluator(parse("$..p"))(jsontext.parse(DOCS[0][1]))]
    assert [(r["id"], r["name"], r["n"]) for r in nodes.duplicate_names(table, ["id"]).collect()] == [(5, "p", 2)]
    arrays = table.where("kind = 'array' AND id = 1")
    assert nodes.children(table, arrays, ["id"]).count() == 3 and nodes.descendants(table, arrays, ["id"]).count() == 7
    assert [r["nval"] for r in table.where("name = 'p' AND id < 5").orderBy("nkey").collect()] == [1.0, 5.0, 15.5]
    assert table.where("error IS NOT NULL").count() == 1


@pytest.mark.parametrize("query", ["$.a[*].p", "$.a[0]", "$.a[-1]", "$.a[9]", "$.a[::2]", "$.a[::-1].p", "$['a','lim']", "$.a[?@.p]", "$.a[?!@.p]", "$.a[?@.p > 5]", "$.a[?@.p >= 5 && @.s == 'x' || @.q == null]", "$.a[?@.none == $.none2]", "$.a[?@.s != 'x']", "$.a[?search(@.s, '[x-z]')].s", "$.a[?match(@.s, '(')]", "$.a[?length(@.s) == 1]", "$.a[?13 == '13']", "$[?@ == 10]", "$.lim.x"])
def test_native_agrees_with_exact(docs, query):
    valid = docs.where("id in (1, 2, 6)")
    exact = sorted((r["id"], r["path"]) for r in select_nodes(valid, "doc", query).collect())
    try:
        native = sorted((r["id"], r["path"]) for r in native_nodes(valid, "doc", query).collect())
    except Unsupported:
        assert query == "$.a[?@.none == $.none2]"
        return
    assert native == exact


def test_native_declines():
    with pytest.raises(Unsupported):
        native_nodes_of("$..a")


def native_nodes_of(query):
    from pyspark.sql import SparkSession

    return native_nodes(SparkSession.getActiveSession().createDataFrame([(1, "{}")], "id long, doc string"), "doc", query)


def test_native_plan_has_no_python(docs):
    plan = native_nodes(docs, "doc", "$.a[?@.p > 5].p")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_examples_in_one_job(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(EXAMPLES)], "id long, doc string")
    for query in sorted({q for _, q, _ in EXAMPLES})[:6]:
        got = {}
        for r in select_nodes(df, "doc", query).orderBy("id", "ord").collect():
            got.setdefault(r["id"], []).append(r["path"])
        for k, (_, q, expected) in enumerate(EXAMPLES):
            if q == query:
                assert got.get(k, []) == expected


def test_sources(spark, tmp_path):
    lines, files = tmp_path / "lines", tmp_path / "files"
    readers.write_json_lines(spark.createDataFrame([('{"a":1}',), ('{"a":2}',)], "doc string"), str(lines))
    assert sorted(r["doc"] for r in readers.read_json_lines(spark, str(lines)).collect()) == ['{"a":1}', '{"a":2}']
    files.mkdir()
    (files / "a.json").write_text('{\n "a": [1]\n}')
    (files / "b.json").write_bytes(b'{"a":"\xff"}')
    rows = readers.read_json_bytes(spark, str(files)).orderBy("file").collect()
    assert [r["valid_utf8"] for r in rows] == [True, False] and rows[1]["doc"] is None
    assert select_nodes(readers.read_json_files(spark, str(files / "a.json")), "doc", "$.a[0]").collect()[0]["nval"] == 1.0


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "x.txt").write_text('{"a":[1,2,3]}\n\n{"a":[4]}\nbroken\n')
    stream = select_nodes(readers.stream_json_lines(spark, str(src)), "doc", "$.a[?@ > 1]")
    q = patch_sink(stream, "found")
    assert sorted(r["nval"] for r in spark.sql("SELECT nval FROM found WHERE error IS NULL").collect()) == [2.0, 3.0, 4.0]
    assert spark.sql("SELECT * FROM found WHERE error IS NOT NULL").count() == 1
    q.stop()
    merged = merge_documents(readers.stream_json_lines(spark, str(src)), "doc", '{"b":1}')
    q = patch_sink(merged, "merged_docs")
    assert spark.table("merged_docs").where("merged LIKE '%\"b\":1}'").count() == 2
    q.stop()


def patch_sink(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    return q


def test_stream_to_files(spark, tmp_path):
    from docquill.streaming.documents import stream_merged, stream_nodes, stream_patched, write_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "x.txt").write_text('{"a":[1,2]}\n{"b":1}\n')
    made = {"nodes": stream_nodes(spark, str(src), "$.a[*]"), "patched": stream_patched(spark, str(src), '[{"op":"remove","path":"/a"}]'), "merged": stream_merged(spark, str(src), '{"a":null}')}
    for name, df in made.items():
        write_stream(df, str(tmp_path / name), str(tmp_path / f"{name}-state"), once=True).awaitTermination()
    assert sorted(r["nval"] for r in spark.read.parquet(str(tmp_path / "nodes")).collect()) == [1.0, 2.0]
    assert sorted(str(r["patched"]) for r in spark.read.parquet(str(tmp_path / "patched")).collect()) == ["None", "{}"]
    assert sorted(r["merged"] for r in spark.read.parquet(str(tmp_path / "merged")).collect()) == ['{"b":1}', "{}"]


def test_hybrid_agrees_with_exact(docs):
    """Every document, those that VARIANT refuses among them; a query beyond the native tier goes through the exact one."""
    for query in ("$.a[*].p", "$.p", "$.a[?@.p > 5]", "$..p", "$.a[?count(@.*) == 2]", "$.*[?@.*]", "$.a[?search(@.s, '(x*)*y|x')].s", "$.a[?@.p == 15.50]"):
        columns = ("id", "path", "kind", "sval", "nval")
        exact = sorted((tuple(r[c] for c in columns) + (r["error"] and r["error"]["code"],) for r in select_nodes(docs, "doc", query).collect()), key=str)
        hybrid = sorted((tuple(r[c] for c in columns) + (r["error"] and r["error"]["code"],) for r in hybrid_nodes(docs, "doc", query).collect()), key=str)
        assert hybrid == exact, query


def test_numbers_that_doubles_confuse_go_through_the_exact_tier(spark):
    texts = ['{"a":[9007199254740993]}', '{"a":[9007199254740992]}', '{"a":[0.1]}', '{"a":[0.1000000000000000055]}', '{"a":[1e400]}', '{"a":[1e-400,0]}', '{"a":[-0.0]}', '{"a":["0.1"]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, doc string")
    for query in ("$.a[?@ == 9007199254740992]", "$.a[?@ > 9007199254740992]", "$.a[?@ == 0.1]", "$.a[?@ <= 0]", "$.a[?@ < 1e401]"):
        assert sorted((r["id"], r["path"]) for r in hybrid_nodes(df, "doc", query).collect()) == sorted((r["id"], r["path"]) for r in select_nodes(df, "doc", query).collect()), query


def test_native_hides_clashing_names_and_declines_what_may_explode(spark):
    df = spark.createDataFrame([(1, '{"a":"x"}', "mine", "mine")], "id long, doc string, path string, value string")
    assert native_nodes(df, "doc", "$.a").select("id", "path").collect()[0]["path"] == "$['a']"
    for query in ("$[?match(@, '(a*)*b')]", "$[?match(@, 'a{20000}')]", "$[?@ == 12345678901234567890]"):
        with pytest.raises(Unsupported):
            native_nodes(df, "doc", query)


def test_control_characters_in_native_paths(spark):
    df = spark.createDataFrame([(1, '{"\\u0001\\u001f\\u000b\\n":1}')], "id long, doc string")
    assert [r["path"] for r in native_nodes(df, "doc", "$.*").collect()] == [r["path"] for r in select_nodes(df, "doc", "$.*").collect()]


def test_node_table_refuses_its_own_names_and_gives_texts_back(spark):
    texts = ['{"a":[1.0,{"b":null,"b":"\\u00e9"}],"c":{}}', "[]", '"x"', "-0.0e1", "[[[true,false]]]"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, "[1,"])], "id long, doc string")
    with pytest.raises(ValueError, match="path"):
        nodes.shred(df.withColumn("path", F.lit(1)), "doc", ["id", "path"])
    got = {r["id"]: r["text"] for r in nodes.assembled(nodes.shred(df, "doc", ["id"]), ["id"], "text").collect()}
    assert got == {k: t.replace("\\u00e9", "\u00e9") for k, t in enumerate(texts)}


def test_decimals(spark):
    texts = ["1.50", "-0.001", "1e2", "12345.6789", "99999999", "1e-3", "0e99", "0.0010", None, "x", "100000", "-99999.999"]
    got = decimals(spark.createDataFrame([(t,) for t in texts], "num string"), "num", 8, 3).collect()
    expected = ["1.500", "-0.001", "100.000", None, None, "0.001", "0.000", "0.001", None, None, None, "-99999.999"]
    assert [None if r["dec"] is None else str(r["dec"]) for r in got] == expected
    assert [r["error"] and r["error"]["code"] for r in got] == [None] * 3 + ["ValueNotRepresentable"] * 2 + [None] * 4 + ["NotANumber", "ValueNotRepresentable", None]


def test_places_in_bytes(spark):
    texts = [b'{"a":1}', b'{"\xc3\xa9":}', b'["\xff"]', b"[1] 2", None]
    rows = validate(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, doc binary"), "doc").orderBy("id").collect()
    assert [(r["valid"], r["error_code"], r["error_offset"], r["error_byte"]) for r in rows] == [(True, None, None, None), (False, "InvalidJson", 5, 6), (False, "InvalidUtf8", None, 2), (False, "TrailingContent", 4, 4), (None, None, None, None)]
    assert rows[1]["error_expected"]


def test_scans_stop_early(spark):
    df = spark.range(0, 100_000, 1, 50).select(F.concat(F.lit('{"a":['), F.col("id").cast("string"), F.lit(",2]}")).alias("doc"))
    assert scan_until(df, "doc", "$.a[*]", 5).count() == 5 and scan_until(df.limit(1), "doc", "$.a[*]", 5).count() == 2


def test_pointer_ancestors_and_equal_nodes(spark):
    df = spark.createDataFrame([(1, "/a~1b//0"), (2, "")], "id long, p string")
    assert sorted((r["id"], r["depth"], r["ancestor"], r["parent"], r["token"]) for r in pointer_ancestors(df, "p").collect()) == [(1, 0, "", None, None), (1, 1, "/a~1b", "", "a/b"), (1, 2, "/a~1b/", "/a~1b", ""), (1, 3, "/a~1b//0", "/a~1b/", "0"), (2, 0, "", None, None)]
    a = nodes.shred(spark.createDataFrame([(1, "[1.0,null,\"x\"]")], "a long, doc string"), "doc", ["a"])
    b = nodes.shred(spark.createDataFrame([(7, "[10e-1]"), (8, "[\"x\",null]"), (9, "[true]")], "b long, doc string"), "doc", ["b"])
    assert sorted(tuple(r) for r in nodes.equal_nodes(a, b, ["a"], ["b"]).collect()) == [(1, 7), (1, 8), (1, 8)]


def test_agreement_reads_each_document_once_and_counts_what_is_left_over(spark, monkeypatch):
    from docquill.operators import agreement as tiers

    texts = ['{"a":[1,2.5,"x"]}', '{"a":[1e0,12345678901234567890]}', '{"a":1,"a":[2]}', '{"a":[', None, '{"b":null}', '{"a":[1,2.5,"x"]}']
    df = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "key int, doc string")  # ids repeat
    queries = ["$.a[*]", "$..a", "$.a[?@ > 1]"]
    got = tiers.agreement(df, ["key"], "doc", queries)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2
    assert [tuple(r) for r in got.collect()] == [("$.a[*]", True, 0), ("$..a", False, 0), ("$.a[?@ > 1]", True, 0)]
    own = tiers.native_part
    monkeypatch.setattr(tiers, "native_part", lambda df, doc, q: own(df, doc, q).where("kind <> 'string'") if q == "$.a[*]" else own(df, doc, q).unionAll(own(df, doc, q)))
    assert [r["n"] for r in tiers.agreement(df, ["key"], "doc", ["$.a[*]", "$.a[?@ > 1]"]).collect()] == [2, 2]
