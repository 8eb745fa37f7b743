import json

import pytest
from conftest import ids
from pyspark.sql import functions as F

from tabsift.errors import TabsiftError
from tabsift.plans import flow
from tabsift.session import scratch_path, shared_dir
from tabsift.sources import readers, writers


@pytest.fixture
def people_csv(tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("name,age\nAlice,41\nBob,17\nCarol,40\n")
    return str(path)


ADULTS = {"kind": "row", "predicate": {"col": "age", "op": "gt", "value": "30"}}


def test_preview_and_analysis_of_a_file(spark, people_csv):
    assert ids(flow.preview_path(spark, people_csv, ADULTS), "name") == ["Alice", "Carol"]
    out = {r.column: r for r in flow.analyze_path(spark, people_csv, "summary_stats", None, ADULTS).collect()}
    assert out["name"]["count"] == 2


@pytest.mark.parametrize("call,code", [
    (lambda s, p: flow.preview_path(s, p, {"kind": "nope"}), "UNKNOWN_FILTER"),
    (lambda s, p: flow.analyze_path(s, p, "nope"), "UNKNOWN_ANALYSIS"),
    (lambda s, p: flow.analyze_path(s, p, "group_by", {"by": []}), "VALIDATION_FAILED"),
    (lambda s, p: flow.convert(s, p, "/x", "pdf"), "UNKNOWN_OUTPUT_FORMAT"),
    (lambda s, p: flow.preview_path(s, p + ".none"), "NOT_FOUND"),
    (lambda s, p: flow.load(s, p, "pdf"), "UNKNOWN_FORMAT"),
    (lambda s, p: flow.run_job(s, {"kind": "x", "params": {}}, "/x"), "UNKNOWN_JOB_KIND"),
    (lambda s, p: flow.run_operations(flow.load(s, p), [{"kind": "join"}]), "VALIDATION_FAILED"),
])
def test_error_codes(spark, people_csv, call, code):
    with pytest.raises(TabsiftError) as e:
        call(spark, people_csv)
    assert e.value.code == code


def test_trees_are_no_tables(spark, tmp_path):
    tree = spark.createDataFrame([("{}",)], "t string").select(F.try_parse_json("t").alias("tree"))
    with pytest.raises(TabsiftError) as e:
        flow.tabular(tree)
    assert e.value.code == "NOT_TABULAR"


@pytest.fixture
def tree_file(tmp_path):
    path = tmp_path / "d.json"
    path.write_text('{"name": "Mara", "langs": ["x", "y"], "addr": {"city": "Bergen"}}')
    return str(path)


def test_documents_of_a_file(spark, tree_file):
    with pytest.raises(TabsiftError) as e:
        flow.preview_path(spark, tree_file)
    assert e.value.code == "NOT_TABULAR"
    with pytest.raises(TabsiftError):
        flow.analyze_path(spark, tree_file, "summary_stats")
    paths = {r.path: r.types for r in flow.analyze_path(spark, tree_file, "schema_infer").collect()}
    assert paths["$.addr.city"] == ["string"] and paths["$.langs.[1]"] == ["string"]


@pytest.mark.parametrize("to,options", [("json", {"fmt": "json"}), ("yaml", {"fmt": "yaml"}),
                                        ("xml", {"fmt": "xml", "row_tag": "document"})])
def test_convert_documents(spark, tree_file, tmp_path, to, options):
    target = flow.convert(spark, tree_file, str(tmp_path / "o"), to, ADULTS)
    back = flow.load(spark, target, **options)
    if to == "xml":
        assert back.select("addr.city", "name").first() == ("Bergen", "Mara")
    else:
        city = F.variant_get("tree", "$.addr.city", "string")
        assert back.select(city).first()[0] == "Bergen"


def test_documents_do_not_become_csv(spark, tree_file, tmp_path):
    with pytest.raises(TabsiftError) as e:
        flow.convert(spark, tree_file, str(tmp_path / "o"), "csv")
    assert e.value.code == "NOT_TABULAR"


def test_xml_documents(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text('<?xml version="1.0"?>\n<!-- c --><people><person id="1"><name>A</name></person></people>')
    paths = {r.path for r in flow.analyze_path(spark, str(path), "schema_infer").collect()}
    assert "$.person.@id" in paths


def test_switched_off(people):
    flow.disable("filter-row", "analysis-profile")
    try:
        with pytest.raises(TabsiftError):
            flow.filtered(people, ADULTS)
        with pytest.raises(TabsiftError):
            flow.analyze(people, "profile")
    finally:
        flow.enable("filter-row", "analysis-profile")
    assert flow.filtered(people, ADULTS).count() == 2


@pytest.mark.parametrize("to", ["csv", "tsv", "json", "jsonl", "xml", "yaml"])
def test_convert(spark, people_csv, tmp_path, to):
    target = flow.convert(spark, people_csv, str(tmp_path / "o"), to, ADULTS)
    options = {"row_tag": "row"} if to == "xml" else {}
    back = readers.read_any(spark, target, "jsonl" if to == "json" else to, **options)
    assert ids(back, "name") == ["Alice", "Carol"]


def test_chain_and_recipe(people):
    steps = [
        {"kind": "filter", "mode": "row", "predicate": "age > 18 AND country = 'NO'"},
        {"kind": "filter", "mode": "column", "keep": ["id"]},
        {"kind": "convert", "to": "json"},
    ]
    assert ids(flow.run_operations(people, steps)) == [1]
    assert ids(flow.replay(people, json.dumps({"operations": steps}))) == [1]


def test_current_recipes(spark):
    saves = spark.createDataFrame([(1, "u", "a", 1), (2, "u", "a", 3), (3, "u", "b", 2), (4, "v", "a", 9)],
                                  "id long, user_id string, name string, updated_at long")
    assert [r.id for r in flow.current_recipes(saves).collect()] == [4, 2, 3]


@pytest.mark.parametrize("kind,extra,rows", [
    ("batch-filter", {}, 2), ("convert", {}, 2), ("ai-anomaly-full", {}, None),
    ("analyze", {"analysis": "group_by", "options": {"by": ["name"], "agg": {"age": ["max"]}}}, 2),
])
def test_jobs(spark, people_csv, tmp_path, kind, extra, rows):
    job = {"job_id": "j", "user_id": "u", "kind": kind, "params": {
        "input": {"ref": people_csv, "format": "csv"},
        "operations": [{"kind": "filter", "mode": "row", "predicate": "age > 30"}], **extra}}
    path = flow.run_job(spark, job, str(tmp_path))
    assert path.endswith("/j") and "/results/u/" in path
    if rows is not None:
        assert spark.read.json(path).count() == rows


def test_schema_infer_of_rows(spark, people):
    paths = {r.path for r in flow.analyze(people, "schema_infer").collect()}
    assert "$.country" in paths


def test_scratch_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_writers_cover_every_readable_format():
    assert set(writers.WRITERS) == set(readers.READERS) | {"json"}


def test_the_package_can_be_shipped():
    import zipfile

    from tabsift.session import packed_package

    names = zipfile.ZipFile(packed_package()).namelist()
    assert {"tabsift/__init__.py", "tabsift/session.py", "tabsift/operators/filters.py"} <= set(names)
    assert all(n.startswith("tabsift/") for n in names)
