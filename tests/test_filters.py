import pandas as pd
import pytest
from conftest import ids
from pyspark.sql import functions as F

from tabsift.errors import TabsiftError
from tabsift.operators.expression import register_function, registered_functions, two_valued
from tabsift.operators.filters import (
    ROW_OPS, apply_filter, explain_filter, preview, validate_filter,
)


def row(col, op, value=None):
    return {"kind": "row", "predicate": {"col": col, "op": op, "value": value}}


def test_columns_come_in_listed_order_and_unknown_ones_are_skipped(people):
    assert apply_filter(people, {"kind": "column", "keep": ["name", "x", "id"]}).columns == \
        ["name", "id"]
    assert apply_filter(people, {"kind": "column", "columns": ["age"]}).columns == ["age"]
    assert apply_filter(people, {"kind": "column", "exclude": ["id", "age"]}).columns == \
        ["name", "country"]


def test_empty_column_list_is_refused(people):
    with pytest.raises(TabsiftError) as e:
        apply_filter(people, {"kind": "column", "keep": []})
    assert e.value.code == "VALIDATION_FAILED"


# What each operator keeps of a=null, a='x', a='y' (n = 1, 2, 3), with and without a null operand.
MATRIX = [
    ("eq", "x", [2]), ("eq", None, [1]), ("ne", "x", [1, 3]), ("ne", None, [2, 3]),
    ("gt", "x", [3]), ("gte", "x", [2, 3]), ("lt", "y", [2]), ("lte", "y", [2, 3]),
    ("contains", "x", [2]), ("starts_with", "y", [3]), ("ends_with", "y", [3]),
    ("regex", "[xy]", [2, 3]), ("in", ["x"], [2]), ("in", ["x", None], [1, 2]),
    ("in", [], []), ("not_in", ["x"], [1, 3]), ("not_in", ["x", None], [3]),
    ("not_in", [], [1, 2, 3]), ("is_null", None, [1]), ("is_not_null", None, [2, 3]),
]


@pytest.mark.parametrize("op,value,kept", MATRIX)
def test_null_matrix(spark, op, value, kept):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id long, a string")
    assert ids(apply_filter(df, row("a", op, value))) == kept


def test_matrix_covers_every_operator():
    assert {m[0] for m in MATRIX} == set(ROW_OPS)


@pytest.mark.parametrize("value,kept", [(18, [1, 2]), ("18", [1, 2]), (41.5, [2]), ("10", [1, 2])])
def test_literals_take_the_column_type(people, value, kept):
    assert ids(apply_filter(people, row("age", "gt", value))) == kept


def test_literal_beyond_the_column_range(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    assert ids(apply_filter(df, row("id", "lt", 2 ** 40))) == [1, 2]
    assert ids(apply_filter(df, row("id", "lt", 10 ** 30))) == [1, 2]


def test_text_operators_read_booleans_capitalised(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "id long, b boolean")
    assert ids(apply_filter(df, row("b", "starts_with", "Tr"))) == [1]


@pytest.mark.parametrize("spec,text", [
    (row("nope", "eq", 1), "no column 'nope'"), (row("age", "like", 1), "no row operator"),
    (row("age", "in", 1), "a list of values"), (row("age", "gt", "old"), "not a bigint"),
    ({"kind": "regex", "pattern": "(unclosed"}, "does not compile"),
    ({"kind": "regex", "pattern": "a", "flags": ["x"]}, "no regex flag"),
    ({"kind": "expression", "expr": "nope > 1"}, "unknown name"),
    ({"kind": "expression", "expr": "nofn(age) > 1"}, "unknown function"),
    ({"kind": "expression", "expr": "age > > 1"}, "syntax error"),
])
def test_validation_messages(people, spec, text):
    assert any(text in p for p in validate_filter(people, spec))


def test_literals_that_do_not_fit_are_told(spark, people):
    assert validate_filter(people, row("age", "gt", True)) == ["True is not a bigint"]
    df = spark.sql("SELECT 1L AS id, DATE '2023-01-01' AS d")
    assert validate_filter(df, row("d", "eq", "2023-01-01xyz")) == ["'2023-01-01xyz' is not a date"]
    assert ids(apply_filter(df, row("d", "eq", "2023-01-01"))) == [1]


@pytest.mark.parametrize("text,spark_text", [
    ("NOT a LIKE 'x%' AND b", "TRUE IS DISTINCT FROM (a LIKE 'x%') AND b"),
    ("NOT a BETWEEN 1 AND 2 OR NOT b", "TRUE IS DISTINCT FROM (a BETWEEN 1 AND 2) OR TRUE IS DISTINCT FROM (b)"),
    ("a NOT IN (1) AND b IS NOT NULL", "a NOT IN (1) AND b IS NOT NULL"),
    ("2 ** 3 ** -x > f(a // 2)", "power(2, power(3, -x)) > f(floor((a) / (2)))"),
    ("-a * b // c + 1", "floor((- a * b) / (c)) + 1"),
    ("'NOT a = b' == c", "'NOT a = b' <=> c"),
    ("exists(l, x -> NOT x = 1)", "exists(l, x -> TRUE IS DISTINCT FROM (x <=> 1))"),
])
def test_two_valued_text(text, spark_text):
    assert two_valued(text) == spark_text


def test_unknown_kind(people):
    with pytest.raises(TabsiftError) as e:
        apply_filter(people, {"kind": "nope"})
    assert e.value.code == "UNKNOWN_FILTER"


def test_regex_looks_at_every_text_column(spark):
    df = spark.createDataFrame(
        [(1, "Mara", "math"), (2, "Ines", "COBOL fans"), (3, None, "cobol")],
        "id long, name string, note string",
    )
    assert ids(apply_filter(df, {"kind": "regex", "pattern": r"\bCOBOL\b"})) == [2]
    assert ids(apply_filter(df, {"kind": "regex", "pattern": "COBOL", "flags": ["i"]})) == [2, 3]


@pytest.mark.parametrize("pattern,flags,kept", [
    (r"^(?P<a_b>n)(?P<ab>é)(?P=ab)$", [], [1]),
    (r"(?P<first_one>\w)(?P=first_one)", [], [1, 2]), (r"^\w+\Z", [], [1, 2]), (r"É", ["i"], [1]),
    (r"^b", ["m"], [3]), (r"^a.b$", ["s"], [3]), (r"^a.b$", [], []), (r"^\d+$", [], [4]),
])
def test_pattern_dialect(spark, pattern, flags, kept):
    df = spark.createDataFrame([(1, "néé"), (2, "aabc"), (3, "a\nb"), (4, "٣")], "id long, t string")
    spec = {"kind": "regex", "pattern": pattern, "flags": flags}
    assert [i for i in ids(apply_filter(df, spec)) if i != 4 or kept == [4]] == kept


@pytest.mark.parametrize("text,kept", [
    ("age > 18 AND country = 'NO'", [1]),
    ("NOT (country = 'CA') OR age > 80", [1, 2, 3, 4]),
    ("NOT (country = 'CA')", [1, 3, 4]),
    ("not age > 18", [3, 4]),
    ("NOT country == 'NO'", [2, 3, 4]),
    ("country != 'NO'", [2, 3, 4]),
    ("country <> 'NO' and age >= 10", [2, 3]),
    ("name = None", [4]),
    ("CASE WHEN age > 50 THEN true ELSE false END", [2]),
    ("!(country = 'CA' OR age > 80)", [1, 3, 4]),
    ("country IN ('NO', 'PE')", [1, 3]),
    ("country NOT IN ('NO', 'PE')", [2]),
    ("age % 2", [1]),
    ("name", [1, 2, 3]),
    ("age * 2 = 82", [1]),
])
def test_expressions(people, text, kept):
    assert ids(apply_filter(people, {"kind": "expression", "expr": text})) == kept


def test_literals_are_left_alone():
    assert two_valued("a = 'x = None != NOT (y)'").endswith("'x = None != NOT (y)'")
    assert "`a = b`" in two_valued("`a = b` > 1")


def test_sql_nulls(people):
    spec = {"kind": "expression", "expr": "NOT (country = 'CA')", "sql_nulls": True}
    assert ids(apply_filter(people, spec)) == [1, 3]


def test_registered_functions(spark, people):
    @F.pandas_udf("double")
    def double_it(v: pd.Series) -> pd.Series:
        return v * 2.0

    register_function(spark, "double_it", double_it, signature="double_it(x) -> number")
    register_function(spark, "plus_one", lambda x: None if x is None else x + 1, "long", "plus_one(x)")
    assert ids(apply_filter(people, {"kind": "expression", "expr": "double_it(age) > 100"})) == [2]
    assert ids(apply_filter(people, {"kind": "expression", "expr": "plus_one(age) = 42"})) == [1]
    assert registered_functions()["double_it"] == "double_it(x) -> number"


def test_preview_gives_at_least_one_row(people):
    assert preview(people, None, 0).count() == 1
    assert preview(people, row("age", "gt", 18), 20).count() == 2


def test_explain_lines():
    assert explain_filter({"kind": "column", "keep": ["a", "b"]}) == "shows a, b"
    assert explain_filter(row("age", "gt", 18)) == "rows whose age passes gt 18"


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id * 2 AS a", "cast(id AS string) AS b").write.parquet(path)
    df = spark.read.parquet(path)
    kept = apply_filter(apply_filter(df, row("a", "gt", "50")), {"kind": "column", "keep": ["id"]})
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,50)" in plan
    assert "ReadSchema: struct<id:bigint,a:bigint>" in plan
