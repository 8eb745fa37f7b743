import json

import pytest
from pyspark.sql import functions as F

from tabsift.functions.contracts import check_messages
from tabsift.operators.paths import (
    corpus_totals, document_totals, path_profile, struct_paths, text_depth,
)
from tabsift.operators.trees import (
    as_tree, canonical_hash, canonical_json, rows_to_tree, tree_to_rows, union_keys,
)
from tabsift.sources.documents import xml_to_json


def docs(spark, *values):
    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, doc string")


def profile(df, **options):
    return {r.path: r for r in path_profile(df, "doc", **options).collect()}


def test_paths_of_one_document(spark):
    out = profile(docs(spark, {"name": "Mara", "addr": {"city": "Bergen"}}))
    assert out["$.name"].types == ["string"]
    assert (out["$.addr.city"].depth_min, out["$.addr"].types) == (3, ["object"])
    totals = document_totals(docs(spark, {"name": "Mara", "addr": {"city": "Bergen"}}), "doc", ["id"])
    assert tuple(totals.first())[1:] == (3, 2, 4)


def walk(value, path, depth, out):
    inner = list(value.items()) if isinstance(value, dict) else (
        [(f"[{i}]", v) for i, v in enumerate(value)] if isinstance(value, list) else [])
    tag = "object" if inner else {
        str: "string", bool: "boolean", int: "integer", float: "number"}.get(type(value), "null")
    types, low, high, n = out.get(path, (set(), 99, 0, 0))
    out[path] = (types | {tag}, min(low, depth), max(high, depth), n + 1)
    for k, v in inner:
        walk(v, f"{path}.{k}", depth + 1, out)


def test_paths_against_a_walk(spark):
    values = [
        {"a": [1, 2.5, {"b": None}, 5.0, 10 ** 25], "c": {}, "d": [], "e": "}{[", "f": {"g": {"h": [[1]]}}},
        {"a": "x", "c": {"k": True}, "e": 'quo"te\\'}, [1, "y"], 5, {"a": {"b": 1}},
    ]
    want = {}
    for v in values:
        walk(v, "$", 1, want)
    got = profile(docs(spark, *values, "not json"))
    assert {p: (set(r.types), r.depth_min, r.depth_max, r.frequency) for p, r in got.items()} == want
    totals = corpus_totals(docs(spark, *values), "doc").first()
    assert (totals.depth, totals.paths) == (max(w[2] for w in want.values()), len(want))
    assert totals.node_count == sum(w[3] for w in want.values())


def test_collapsed_arrays_and_depth_limit(spark):
    df = docs(spark, {"a": [{"b": 1}, {"b": 2}]})
    assert profile(df, arrays="collapse")["$.a.[*].b"].frequency == 2
    assert set(profile(df, max_depth=2)) == {"$", "$.a"}


def test_repeated_elements_share_a_path(spark):
    text = '<people n="5"><p id="007"><name> A </name></p><p id="2">x<name/>y</p></people>'
    df = spark.createDataFrame([(1, text)], "id long, xml string").select(
        "id", xml_to_json(F.col("xml")).alias("doc")
    )
    out = profile(df, arrays="repeat", root="people")
    assert {p: (r.types, r.depth_max, r.frequency) for p, r in out.items()} == {
        "people": (["object"], 1, 1), "people.@n": (["string"], 2, 1), "people.p": (["object"], 2, 2),
        "people.p.@id": (["string"], 3, 2), "people.p.name": (["null", "string"], 3, 2),
        "people.p.#text": (["string"], 3, 1)}


def test_unsafe_or_broken_xml_is_null(spark):
    texts = ["<a><b></a>", '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', "<a>t</a>", "<a/>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(xml_to_json(F.col("t")))
    assert [r[0] for r in df.collect()] == [None, None, '"t"', "null"]


def test_text_depth_bounds_the_tree(spark):
    df = docs(spark, {"a": [{"b": "[[[["}]}, "7", "")
    assert [r[0] for r in df.orderBy("id").select(text_depth(F.col("doc"))).collect()] == [4, 1, 1]


def test_long_strings_do_not_exhaust_the_stack(spark):
    df = docs(spark, {"t": 'a\\"{' * 200_000})
    assert profile(df)["$.t"].frequency == 1


def test_flatten_and_back(spark):
    df = docs(spark, {"id": 7, "tags": [{"n": "a"}, {"n": "b"}]}, {"id": 8})
    out = tree_to_rows(as_tree(df, "doc"), "tree", {"doc_id": ("$.id", "bigint"),
                                                    "n": ("@.n", "string")}, "$.tags")
    assert [tuple(r) for r in out.orderBy("item_index").collect()] == [(0, 7, "a"), (1, 7, "b")]
    trees = rows_to_tree(spark.createDataFrame([(1, "x")], "a long, b string"))
    assert json.loads(trees.select(F.to_json("tree")).first()[0]) == {"a": 1, "b": "x"}


def test_canonical_form(spark):
    df = docs(spark, '{"b": 1, "a": [1, {"d": 2, "c": 3}]}', '{"a":[1,{"c":3,"d":2}],"b":1}')
    rows = df.select(canonical_json(F.col("doc")), canonical_hash(F.col("doc"))).collect()
    assert rows[0][0] == '{"a":[1,{"c":3,"d":2}],"b":1}'
    assert rows[0][1] == rows[1][1] and len(rows[0][1]) == 64


def test_repeated_keys_keep_the_last(spark):
    assert docs(spark, '{"a":1,"a":2}').select(canonical_json(F.col("doc"))).first()[0] == '{"a":2}'


def test_union_keys(spark):
    df = docs(spark, {"a": 1, "b": 2}, {"b": 3}, '{"c":1,"c":2}', "x")
    assert {r.key: r.rows for r in union_keys(df, "doc").collect()} == {"a": 1, "b": 2, "c": 1}


def test_struct_paths(spark):
    schema = spark.createDataFrame([], "a long, b struct<c:string>, d array<double>").schema
    assert dict(struct_paths(schema))["$.b.c"] == "string"
    assert dict(struct_paths(schema))["$.d.[*]"] == "double"


@pytest.mark.parametrize("text", ["", "   ", "nope", "{"])
def test_text_that_is_no_json_has_no_paths(spark, text):
    assert profile(docs(spark, text)) == {}


def test_deep_documents_take_several_rounds(spark):
    deep, want = {"leaf": 1}, {}
    for i in range(40):
        deep = {"k": deep} if i % 2 else [deep, i]
    walk(deep, "$", 1, want)
    shallow = {"a": 1}
    walk(shallow, "$", 1, want)
    got = profile(docs(spark, deep, shallow, "[" * 500))
    assert {p: (set(r.types), r.depth_min, r.depth_max, r.frequency) for p, r in got.items()} == want


def test_documents_too_large_for_a_tree_are_not_lost(spark):
    small = '{"a":"' + "x" * 1000 + '"}'
    df = spark.createDataFrame([(1, small)], "id long, doc string")
    assert path_profile(df, "doc").count() == 2
    df = df.withColumn("doc", F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 160 << 20), F.lit('"}')))
    with pytest.raises(Exception, match="more than a VARIANT holds"):
        path_profile(df, "doc").collect()


def test_large_texts_are_read_or_fail(spark):
    def text(end):
        return F.concat(F.lit('{"k":7,"a":"'), F.repeat(F.lit("x"), 17 << 20), F.lit(end)).alias("doc")

    good, bad = (spark.range(1).select(text(end)) for end in ('"}', '"'))
    assert tree_to_rows(as_tree(good, "doc"), "tree", {"k": ("$.k", "bigint")}).first()["k"] == 7
    assert good.select(canonical_hash(F.col("doc"))).first()[0] is not None
    for lost in (tree_to_rows(as_tree(bad, "doc"), "tree", {"k": ("$.k", "bigint")}),
                 tree_to_rows(as_tree(bad, "doc"), "tree", {"x": ("@.x", "bigint")}, explode_at="$.tags"),
                 bad.select(canonical_hash(F.col("doc")))):
        with pytest.raises(Exception, match="bytes is no JSON or more than a VARIANT holds"):
            lost.collect()
    row, = check_messages(bad, "doc", "jobs").select("errors").collect()
    assert row["errors"] == ["too large to check"]
    row, = check_messages(good, "doc", "jobs").select("errors").collect()
    assert "unexpected k" in row["errors"]
