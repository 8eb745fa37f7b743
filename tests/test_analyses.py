import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tabsift.errors import TabsiftError
from tabsift.operators import charts, quality
from tabsift.operators.grouping import group_by
from tabsift.operators.infer import apply_inferred, infer_tags
from tabsift.operators.profile import observations, table_profile
from tabsift.operators.quantiles import counted_quantiles, exact_quantiles
from tabsift.operators.summary import cardinality, summary


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


# ---- group by ------------------------------------------------------------------------------

@pytest.mark.parametrize("small_input", [0, 1 << 40])
def test_group_by(spark, small_input):
    df = spark.createDataFrame(
        [("PE", 4), ("CA", 9), ("PE", 3), ("CA", 1), (None, 6), ("NO", None)],
        "country string, amount long",
    )
    out = by_key(group_by(
        df, ["country"], {"amount": ["sum", "count", "avg", "median"]}, small_input
    ), "country")
    assert set(out) == {("PE",), ("CA",), (None,)}
    assert (out[("PE",)].amount_sum, out[("PE",)].amount_count) == (7, 2)
    assert (out[("CA",)].amount_avg, out[("CA",)].amount_median) == (5, 5)
    assert out[(None,)].amount_median == 6


@pytest.mark.parametrize("small_input", [0, 1 << 40])
def test_group_by_text_values(spark, small_input):
    df = spark.createDataFrame(
        [("a", "1.5"), ("a", "x"), ("b", "y"), ("c", None)], "k string, v string"
    )
    fns = ["sum", "count", "avg", "min", "max", "median"]
    out = by_key(group_by(df, ["k"], {"v": fns}, small_input), "k")
    assert tuple(out[("a",)])[1:] == (1.5, 2, 1.5, 1.5, 1.5, 1.5)
    assert tuple(out[("b",)])[1:] == (0.0, 1, 0.0, None, None, None)
    assert ("c",) not in out


@pytest.mark.parametrize("small_input", [0, 1 << 40])
def test_medians_of_infinite_values(spark, small_input):
    inf = float("inf")
    df = spark.createDataFrame([("a", 1.0), ("a", inf), ("a", inf), ("b", inf), ("c", 1.0), ("c", inf)],
                               "k string, v double")
    out = by_key(group_by(df, ["k"], {"v": ["median"]}, small_input), "k")
    assert [out[(k,)].v_median for k in "abc"] == [inf, inf, inf]


def test_group_by_reads_booleans_and_skips_dates(spark):
    df = spark.createDataFrame([("a", True, dt.date(2026, 1, 1)), ("a", False, None)],
                               "k string, f boolean, d date")
    row = group_by(df, ["k"], {"f": ["sum"], "d": ["count", "max"]}).first()
    assert (row.f_sum, row.d_count, row.d_max) == (1.0, 1, None)


def test_group_by_without_aggregates_has_no_groups(people):
    assert group_by(people, ["country"], {}).count() == 0


@pytest.mark.parametrize("by,agg", [([], {"age": ["sum"]}), (["x"], {}), (["id"], {"x": ["sum"]}),
                                    (["id"], {"age": ["mode"]})])
def test_group_by_validation(people, by, agg):
    with pytest.raises(TabsiftError):
        group_by(people, by, agg)


# ---- quantiles -----------------------------------------------------------------------------

def interpolated(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low, high = math.floor(at), math.ceil(at)
    return values[low] + (values[high] - values[low]) * (at - low)


@pytest.mark.parametrize("accuracy", [20, 100])
def test_bracketed_quantiles_are_exact_on_a_hot_group(spark, accuracy):
    rng = random.Random(7)
    rows = [("hot", rng.lognormvariate(0, 3)) for _ in range(6000)]
    rows += [("flat", float(rng.randrange(3))) for _ in range(2000)]
    rows += [(f"g{i}", rng.random()) for i in range(200) for _ in range(3)]
    rows += [("none", None), (None, 4.0), (None, 8.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    out = by_key(exact_quantiles(
        df, ["k"], {"v": F.col("v")}, probs, accuracy=accuracy, small_input=0
    ), "k", "prob")
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(out) == {(k, p) for k in groups for p in probs}
    for (k, p), r in out.items():
        assert r.value == pytest.approx(interpolated(groups[k], p), rel=1e-12)


def test_both_quantile_forms_agree_without_keys(spark):
    df = spark.range(5000).select((F.rand(3) * 1000).alias("a"), F.floor(F.rand(4) * 5).alias("b"))
    df = df.union(df.limit(0)).cache()
    columns = {"a": F.col("a"), "b": F.col("b")}
    big = by_key(exact_quantiles(df, [], columns, [0.25, 0.5], 50, small_input=0), "measure", "prob")
    small = by_key(counted_quantiles(df, [], columns, [0.25, 0.5]), "measure", "prob")
    assert {k: r.value for k, r in big.items()} == {k: r.value for k, r in small.items()}


# ---- summary -------------------------------------------------------------------------------

@pytest.mark.parametrize("small_input", [0, 1 << 40])
def test_summary(spark, small_input):
    df = spark.createDataFrame(
        [(1, "Mara", 41, ""), (2, "Ines", 88, "x"), (3, "Mara", None, None)],
        "id long, name string, age long, note string",
    )
    out = by_key(summary(df, small_input=small_input), "column")
    age, name, note = out[("age",)], out[("name",)], out[("note",)]
    assert (age["count"], age.nulls, age.min, age.max, age.median) == (2, 1, 41, 88, 64.5)
    assert age.stddev == pytest.approx(statistics.pstdev([41, 88])) and age.top is None
    assert (name.distinct, [tuple(t) for t in name.top]) == (2, [("Mara", 2), ("Ines", 1)])
    assert (note["count"], note.nulls, note.distinct) == (1, 2, 1)
    assert out[("id",)].position == 1


def test_long_texts_keep_their_whole_value(spark):
    start = "x" * 500
    rows = [(start + "a",)] * 3 + [(start + "b",)] * 2 + [("short",)] * 2 + [("x" * 128,)]
    out = by_key(summary(spark.createDataFrame(rows, "t string"), top_n=3), "column")[("t",)]
    assert out.distinct == 4
    assert [tuple(t) for t in out.top] == [(start + "a", 3), ("short", 2), (start + "b", 2)]


def test_summary_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, None)], "a long, b string")
    out = by_key(summary(df), "column")
    assert (out[("a",)].median, out[("a",)].distinct, out[("b",)].top) == (None, 0, [])


def test_cardinality_forms(spark):
    df = spark.createDataFrame(
        [(1, "x" * 100, -0.0), (1, "x" * 100, 0.0), (None, "y", 2.0)], "a int, b string, c double"
    )
    exact = {r.column: r.distinct for r in cardinality(df).collect()}
    assert exact == {"a": 1, "b": 2, "c": 2}
    assert {r.column for r in cardinality(df, approx=True).collect()} == set(exact)


# ---- type inference --------------------------------------------------------------------------

def test_inferred_tags(spark):
    rows = [("1", "1.5", "yes", "x", "", "99999999999999999999", "0", "1_000"),
            (" +2 ", "nan", "No", "2", None, "1", "1", "2")]
    names = ["i", "n", "b", "s", "e", "big", "zero_one", "under"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    tags = {r.column: r.type for r in infer_tags(df).collect()}
    assert tags == {"i": "integer", "n": "number", "b": "boolean", "s": "string", "e": "string",
                    "big": "integer", "zero_one": "integer", "under": "string"}
    typed = apply_inferred(df)
    assert dict(typed.dtypes) == {
        "i": "bigint", "n": "double", "b": "boolean", "s": "string", "e": "string",
        "big": "decimal(38,0)", "zero_one": "bigint", "under": "string"}
    first = typed.first()
    assert (first.i, first.b, first.e) == (1, True, None)


# ---- charts --------------------------------------------------------------------------------

@pytest.mark.parametrize("ddl,mark,x,y", [
    ("a long, b double", "point", "a", "b"), ("t timestamp, b double", "line", "t", "b"),
    ("b double, t timestamp", "line", "t", "b"), ("s string, b double", "bar", "s", "b"),
    ("b long, f boolean", "bar", "f", "b"),
])
def test_chart_rules(spark, ddl, mark, x, y):
    chart, = charts.chart_suggestions(spark.createDataFrame([], ddl)).collect()
    assert (chart.mark, chart.x, chart.y) == (mark, x, y)


def test_chart_order_and_no_chart(spark):
    df = spark.createDataFrame([], "n long, m long, s string, t timestamp")
    marks = [r.mark for r in charts.chart_suggestions(df).orderBy("rank").collect()]
    assert marks == ["line", "line", "bar", "bar", "point"]
    assert charts.chart_suggestions(spark.createDataFrame([], "s string, u string")).count() == 0


def test_point_chart_holds_every_row(spark):
    df = spark.range(1000).selectExpr("id AS a", "id * id AS b")
    out = charts.chart_series(df, bins=10)
    assert out.agg(F.sum("n")).first()[0] == 1000
    assert out.agg(F.max(F.col("x_value").cast("int"))).first()[0] == 9


@pytest.mark.parametrize("ddl,kind", [
    ("t timestamp, v double", "line"), ("s string, v double", "bar"), ("a double, b double", "scatter"),
    ("a double", "histogram"), ("s string, u string", "heatmap"), ("s string", "pie"),
])
def test_recommended_kinds(spark, ddl, kind):
    row = {"t": None, "v": 1.0, "s": "x", "u": "y", "a": 1.0, "b": 2.0}
    names = [c.split()[0] for c in ddl.split(", ")]
    df = spark.createDataFrame([tuple(row[n] for n in names)], ddl)
    assert charts.recommend_chart(df).first().kind == kind


# ---- quality and profile ---------------------------------------------------------------------

@pytest.fixture
def flawed(spark):
    rows = [(i, None if i < 30 else f"u{i}@x.org", 1e9 if i == 50 else 42.0 + i % 7,
             "n/a" if i == 60 else str(i), f"2024-01-{i % 28 + 1:02d}" if i != 70 else "Jan 3")
            for i in range(100)]
    rows.append((99, "u99@x.org", 43.0, "99", "2024-01-16"))
    return spark.createDataFrame(
        rows, "id long, email string, amount double, code string, day string"
    )


@pytest.mark.parametrize("small_input", [0, 1 << 40])
def test_quality_report(flawed, small_input):
    found = by_key(quality.quality_report(flawed, ["email", "code"], small_input=small_input),
                   "kind", "column")
    assert found[("missing_values", "email")].severity == "medium"
    assert found[("outlier", "amount")].severity == "high"
    assert found[("outlier", "amount")].affected == 1
    assert found[("type_drift", "code")].affected == 1
    assert found[("format_inconsistency", "day")].affected == 1
    assert found[("possible_duplicate", "email, code")].affected == 1


def test_report_is_capped_and_worst_first(flawed):
    out = quality.quality_report(flawed, limit=2).collect()
    assert len(out) == 2 and out[0].severity == "high"


def test_reports_use_the_fixed_vocabulary(flawed):
    found = quality.quality_report(flawed).collect()
    assert {r.kind for r in found} <= set(quality.FINDING_KINDS)
    assert {r.severity for r in found} <= set(quality.SEVERITIES)
    assert charts.recommend_chart(flawed).first().kind in charts.CHART_KINDS


def test_whole_numbers_fit_a_number_column(spark):
    df = spark.createDataFrame([(str(i + 0.5),) for i in range(50)] + [("7",)], "v string")
    assert quality.type_drift(df).count() == 0


def test_profile(flawed):
    row = table_profile(flawed).first()
    assert (row.total_rows, len(row.sample_rows), len(row.columns)) == (101, 50, 5)
    assert len(row.key_observations) <= 10
    assert any("email misses 29.7%" in o for o in row.key_observations)
    texts = [r.observation for r in observations(flawed, limit=1).collect()]
    assert texts == ["email misses 29.7% of its values"]
    assert table_profile(flawed, total_bytes=5).first().total_size_bytes == 5


def test_top_texts_that_start_alike_rank_by_value(spark):
    texts = [f"{'same start ' * 20}{i:03d}" for i in range(40)]
    shuffled = texts[::-1] + texts[7:9]
    out = summary(spark.createDataFrame([(t,) for t in shuffled], "t string"), top_n=5).first()
    assert [(t["value"], t["count"]) for t in out["top"]] == \
        [(texts[7], 2), (texts[8], 2), (texts[0], 1), (texts[1], 1), (texts[2], 1)]
