"""Queries: group-by, summaries, type inference, paths, trees, charts, profile and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsift.catalog.base import SQL, as_long, query, rounded, table
from tabsift.functions.tags import variant_tag
from tabsift.operators import charts, quality
from tabsift.operators.grouping import group_by
from tabsift.operators.infer import apply_inferred, infer_tags
from tabsift.operators.paths import corpus_totals, document_totals, path_profile
from tabsift.operators.profile import observations, table_profile
from tabsift.operators.quantiles import exact_quantiles
from tabsift.operators.summary import cardinality, summary, summary_numeric
from tabsift.operators.trees import (
    as_tree, canonical_hash, rows_to_tree, tree_to_rows, union_keys,
)
from tabsift.plans.flow import analyze

_ALL = ["sum", "count", "avg", "min", "max", "median"]


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum,
  round(avg(l_quantity), 4) AS l_quantity_avg, count(l_quantity) AS l_quantity_count,
  median(l_quantity) AS l_quantity_median
FROM lineitem WHERE l_quantity > 10 GROUP BY ALL""")
def flagship(spark, sf_dir):
    spec = {"kind": "row", "predicate": {"col": "l_quantity", "op": "gt", "value": 10}}
    out = analyze(
        table(spark, sf_dir, "lineitem"), "group_by",
        {"by": ["l_returnflag", "l_linestatus"],
         "agg": {"l_quantity": ["sum", "avg", "count", "median"]}}, spec,
    )
    return out.select(
        "l_returnflag", "l_linestatus", rounded("l_quantity_sum", 2).alias("l_quantity_sum"),
        rounded("l_quantity_avg").alias("l_quantity_avg"), "l_quantity_count",
        "l_quantity_median",
    )


def _all_aggregates(spark, sf_dir, **options):
    out = group_by(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"],
        {"l_extendedprice": _ALL}, **options,
    )
    return out.select("l_returnflag", "l_linestatus", *[
        rounded(f"l_extendedprice_{fn}", 3 if fn == "median" else 2)
        .alias(f"l_extendedprice_{fn}") for fn in _ALL
    ])


_ALL_SQL = """SELECT l_returnflag, l_linestatus,
  round(sum(l_extendedprice), 2) AS l_extendedprice_sum,
  count(l_extendedprice) AS l_extendedprice_count,
  round(avg(l_extendedprice), 2) AS l_extendedprice_avg,
  round(min(l_extendedprice), 2) AS l_extendedprice_min,
  round(max(l_extendedprice), 2) AS l_extendedprice_max,
  round(median(l_extendedprice), 3) AS l_extendedprice_median
FROM lineitem GROUP BY ALL"""


@query(_ALL_SQL)
def group_by_all_aggs(spark, sf_dir):
    return _all_aggregates(spark, sf_dir)


@query(_ALL_SQL)
def group_by_bracketed_median(spark, sf_dir):
    """The form used beyond the small-input size."""
    return _all_aggregates(spark, sf_dir, small_input=0)


@query("""WITH t AS (SELECT nullif(event_type, 'error') AS tag, props,
  CASE WHEN value >= 5 THEN value END AS amount FROM events)
SELECT tag, count(amount) AS amount_count, round(coalesce(sum(amount), 0), 2) AS amount_sum,
  count(props) AS props_count, 0.0::DOUBLE AS props_sum, CAST(NULL AS DOUBLE) AS props_min
FROM t GROUP BY tag""")
def group_by_nulls_and_text(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.nullif(F.col("event_type"), F.lit("error")).alias("tag"), "props",
        F.when(F.col("value") >= 5, F.col("value")).alias("amount"),
    )
    out = group_by(rows, ["tag"], {"amount": ["count", "sum"], "props": ["count", "sum", "min"]})
    return out.withColumn("amount_sum", rounded("amount_sum", 2))


@query("""WITH t AS (SELECT user_id, event_type, CASE WHEN value >= 40 THEN value END AS amount
  FROM events)
SELECT user_id, event_type, count(amount) AS amount_count FROM t
WHERE amount IS NOT NULL GROUP BY ALL""")
def group_by_hidden_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_type", F.when(F.col("value") >= 40, F.col("value")).alias("amount")
    )
    return group_by(rows, ["user_id", "event_type"], {"amount": ["count"]})


@query("""SELECT l_returnflag, 'l_extendedprice' AS measure, p AS prob,
  round(CASE p WHEN 0.1 THEN quantile_cont(l_extendedprice, 0.1)
               WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5)
               ELSE quantile_cont(l_extendedprice, 0.99) END, 5) AS value
FROM lineitem CROSS JOIN (SELECT unnest([0.1, 0.5, 0.99]::DOUBLE[]) AS p)
GROUP BY l_returnflag, p""")
def quantiles_bracketed(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    out = exact_quantiles(
        lines, ["l_returnflag"], {"l_extendedprice": F.col("l_extendedprice")},
        [0.1, 0.5, 0.99], small_input=0,
    )
    return out.withColumn("value", rounded("value", 5))


def _number_sql(table_name, columns, extra=""):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{tag}' AS type, count({c}) AS count,
  count(*) - count({c}) AS nulls, {extra.format(c=c)} round(min({c}), 4)::DOUBLE AS min,
  round(max({c}), 4)::DOUBLE AS max, round(avg({c}), 4) AS mean,
  round(median({c}), 4)::DOUBLE AS median,
  round(stddev_pop({c}), 4) AS stddev FROM {table_name}""" for c, tag in columns.items()
    )


_LINE_NUMBERS = {
    "l_orderkey": "integer", "l_linenumber": "integer", "l_quantity": "number",
    "l_extendedprice": "number", "l_discount": "number",
}


def _rounded_moments(df):
    for c in ("min", "max", "mean", "median", "stddev"):
        df = df.withColumn(c, rounded(c))
    return df


@query(_number_sql("lineitem", _LINE_NUMBERS))
def summary_moments(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*_LINE_NUMBERS)
    return _rounded_moments(summary_numeric(rows)).select(
        "column", "type", "count", "nulls", "min", "max", "mean", "median", "stddev"
    )


_CUSTOMER_SUMMARY = _number_sql(
    "customer", {"c_custkey": "integer", "c_nationkey": "integer", "c_acctbal": "number"},
    "count(DISTINCT {c}) AS \"distinct\",",
)


@query(f"""{_CUSTOMER_SUMMARY} UNION ALL
SELECT c AS "column", 'string' AS type, count(v), count(*) - count(v), count(DISTINCT v),
  NULL, NULL, NULL, NULL, NULL
FROM (SELECT 'c_name' AS c, c_name AS v FROM customer UNION ALL
      SELECT 'c_mktsegment', nullif(c_mktsegment, 'MACHINERY') FROM customer) GROUP BY c""")
def summary_all_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn(
        "c_mktsegment", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY"))
    )
    return _rounded_moments(summary(rows)).select(
        "column", "type", "count", "nulls", "distinct", "min", "max", "mean", "median", "stddev"
    )


@query("""WITH cells AS (
  SELECT 'o_orderstatus' AS c, o_orderstatus AS v FROM orders UNION ALL
  SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL
  SELECT 'o_orderdate', CAST(o_orderdate AS VARCHAR) FROM orders),
ranked AS (SELECT c, v, count(*) AS n,
  row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) AS rank FROM cells GROUP BY c, v)
SELECT c AS "column", rank, v AS value, n AS count FROM ranked WHERE rank <= 3""")
def summary_top(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_orderdate")
    out = summary(rows, top_n=3).select("column", F.posexplode("top").alias("at", "t"))
    return out.select(
        "column", (F.col("at") + 1).cast("bigint").alias("rank"), "t.value", "t.count"
    )


@query("""WITH cells AS (SELECT text AS v, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL
  SELECT repeat('the same start ', 10) || text, count(*) FROM documents WHERE text IS NOT NULL GROUP BY text),
ranked AS (SELECT CASE WHEN v LIKE 'the same start the same start %' THEN 'copies' ELSE 'text' END AS c, v, n FROM cells)
SELECT c AS "column", row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS rank, v AS value, n AS count
FROM ranked QUALIFY rank <= 5""")
def summary_top_documents(spark, sf_dir):
    """Long texts that start alike rank by the whole text."""
    start = F.lit("the same start " * 10)
    rows = table(spark, sf_dir, "documents").select("text", F.concat(start, "text").alias("copies"))
    out = summary(rows, top_n=5).select("column", F.posexplode("top").alias("at", "t"))
    return out.select(
        "column", (F.col("at") + 1).cast("bigint").alias("rank"), "t.value", "t.count"
    )


@query("""SELECT 'p_partkey' AS "column", count(DISTINCT p_partkey) AS "distinct" FROM part
UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part
UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part
UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part
UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice) FROM part""")
def cardinality_per_column(spark, sf_dir):
    return cardinality(table(spark, sf_dir, "part"))


def _as_text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("""WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS a, o_orderstatus AS b,
  CAST(o_totalprice AS VARCHAR) AS c,
  CASE WHEN o_orderstatus = 'O' THEN 'yes' ELSE 'No' END AS d,
  CASE WHEN o_orderstatus = 'O' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS e FROM orders)
SELECT n AS "column", CASE WHEN bool_and(regexp_full_match(v, '-?[0-9]*'))
    THEN 'integer' WHEN bool_and(v = '' OR TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'number'
    WHEN bool_and(v = '' OR lower(v) IN ('true','false','0','1','yes','no')) THEN 'boolean'
    ELSE 'string' END AS type
FROM (UNPIVOT t ON a, b, c, d, e INTO NAME n VALUE v) GROUP BY n""")
def infer_types(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    is_open = F.col("o_orderstatus") == "O"
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderstatus").alias("b"),
        F.col("o_totalprice").cast("string").alias("c"),
        F.when(is_open, "yes").otherwise("No").alias("d"),
        F.when(is_open, "").otherwise(F.col("o_custkey").cast("string")).alias("e"),
    )
    return infer_tags(rows).select("column", "type")


@query("""SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size,
  p_retailprice FROM part""")
def typed_from_text(spark, sf_dir):
    return apply_inferred(_as_text(table(spark, sf_dir, "part")))


@query("""SELECT '$' AS path, 'object' AS types, 1::BIGINT AS depth_min, 1::BIGINT AS depth_max,
  count(*) AS frequency FROM events
UNION ALL SELECT '$.k', string_agg(DISTINCT CASE json_type(props, '$.k')
    WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' ELSE 'other' END, ','),
  2, 2, count(*) FROM events WHERE json_exists(props, '$.k')""")
def schema_paths(spark, sf_dir):
    out = path_profile(table(spark, sf_dir, "events"), "props")
    return out.select(
        "path", F.array_join("types", ",").alias("types"),
        *as_long("depth_min", "depth_max"), "frequency",
    )


def _order_documents(spark, sf_dir):
    """Every order as a nested JSON document."""
    def tag(name, value):
        return F.struct(F.lit(name).alias("name"), F.col(value).alias("value"))

    doc = F.to_json(F.struct(
        F.col("o_orderkey").alias("order"),
        F.struct(F.col("o_custkey").alias("id")).alias("customer"),
        F.array(tag("status", "o_orderstatus"), tag("priority", "o_orderpriority")).alias("tags"),
    ))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), doc.alias("doc"))


@query("""WITH o AS (SELECT count(*) AS n FROM orders)
SELECT path, types, d AS depth_min, d AS depth_max, f * n AS frequency FROM o CROSS JOIN (VALUES
  ('$', 'object', 1::BIGINT, 1), ('$.order', 'integer', 2, 1), ('$.customer', 'object', 2, 1),
  ('$.customer.id', 'integer', 3, 1), ('$.tags', 'object', 2, 1), ('$.tags.[*]', 'object', 3, 2),
  ('$.tags.[*].name', 'string', 4, 2), ('$.tags.[*].value', 'string', 4, 2)) v(path, types, d, f)""")
def schema_paths_nested(spark, sf_dir):
    out = path_profile(_order_documents(spark, sf_dir), "doc", arrays="collapse")
    return out.select(
        "path", F.array_join("types", ",").alias("types"),
        *as_long("depth_min", "depth_max"), "frequency",
    )


@query("""SELECT o_orderkey AS id, 4::BIGINT AS depth, 6::BIGINT AS leaf_count,
  11::BIGINT AS node_count FROM orders""")
def document_depths(spark, sf_dir):
    out = document_totals(_order_documents(spark, sf_dir), "doc", ["id"])
    return out.select("id", *as_long("depth"), "leaf_count", "node_count")


@query("""SELECT 2::BIGINT AS depth, count(*) AS leaf_count, 2 * count(*) AS node_count,
  2::BIGINT AS paths FROM events""")
def tree_totals(spark, sf_dir):
    out = corpus_totals(table(spark, sf_dir, "events"), "props")
    return out.select(*as_long("depth"), "leaf_count", "node_count", "paths")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def flatten_json(spark, sf_dir):
    trees = as_tree(table(spark, sf_dir, "events"), "props")
    return tree_to_rows(trees, "tree", {"k": ("$.k", "bigint")}, keep=["event_id"])


@query("""SELECT o_orderkey AS id, 0::BIGINT AS item_index, o_custkey AS customer,
  'status' AS name, o_orderstatus AS value FROM orders
UNION ALL SELECT o_orderkey, 1, o_custkey, 'priority', o_orderpriority FROM orders""")
def flatten_arrays(spark, sf_dir):
    trees = as_tree(_order_documents(spark, sf_dir), "doc")
    out = tree_to_rows(
        trees, "tree",
        {"customer": ("$.customer.id", "bigint"), "name": ("@.name", "string"),
         "value": ("@.value", "string")},
        explode_at="$.tags", keep=["id"],
    )
    return out.withColumn("item_index", F.col("item_index").cast("bigint"))


@query("""SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey FROM customer""")
def table_to_tree(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return tree_to_rows(rows_to_tree(rows), "tree", {
        "c_custkey": ("$.c_custkey", "bigint"), "c_name": ("$.c_name", "string"),
        "c_nationkey": ("$.c_nationkey", "bigint"),
    })


@query("""SELECT event_id, 'integer' AS k, 'string' AS kind,
  CASE WHEN value = floor(value) THEN 'integer' ELSE 'number' END AS amount,
  'boolean' AS flag, 'null' AS gone FROM events""")
def json_value_tags(spark, sf_dir):
    amount = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
    text = F.concat(
        F.lit('{"kind":"'), "event_type", F.lit('","amount":'), amount,
        F.lit(',"flag":true,"gone":null,"k":'), F.get_json_object("props", "$.k"), F.lit("}"),
    )
    trees = as_tree(table(spark, sf_dir, "events").withColumn("doc", text), "doc")
    return trees.select("event_id", *[
        variant_tag(F.try_variant_get("tree", f"$.{n}", "variant")).alias(n)
        for n in ("k", "kind", "amount", "flag", "gone")
    ])


@query("""SELECT 'k' AS key, count(*) AS rows FROM events UNION ALL
SELECT 'big', count(*) FROM events WHERE value > 20""")
def union_of_keys(spark, sf_dir):
    ragged = table(spark, sf_dir, "events").select(
        F.when(F.col("value") > 20, F.replace(F.col("props"), F.lit("}"), F.lit(', "big": true}')))
        .otherwise(F.col("props")).alias("props")
    )
    return union_keys(ragged, "props")


@query("""SELECT event_id, sha256('{"k":' || json_extract_string(props, '$.k') || ',"t":"'
  || event_type || '"}') AS digest FROM events""")
def canonical_digest(spark, sf_dir):
    text = F.concat(
        F.lit('{ "t" : "'), F.col("event_type"), F.lit('", "k":'),
        F.get_json_object("props", "$.k"), F.lit(" }"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id", canonical_hash(text).alias("digest")
    )


# ---- charts and profile ------------------------------------------------------------------------

def _chart_columns(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderdate", "o_orderstatus", "o_totalprice", "o_custkey"
    )


@query("""WITH e AS (SELECT min(o_totalprice) AS pl, max(o_totalprice) AS ph,
  min(o_custkey) AS cl, max(o_custkey) AS ch FROM orders),
p AS (SELECT least(floor((o_totalprice - pl) / ((ph - pl) / 20)), 19)::BIGINT AS xb,
  least(floor((o_custkey - cl)::DOUBLE / ((ch - cl)::DOUBLE / 20)), 19)::BIGINT AS yb FROM orders, e)
SELECT 1::BIGINT AS rank, 'line' AS mark, strftime(date_trunc('month', o_orderdate),
    '%Y-%m-%d %H:%M:%S') AS x_value, CAST(NULL AS BIGINT) AS y_bin,
  round(avg(o_totalprice), 2) AS y_value, count(*) AS n FROM orders GROUP BY x_value
UNION ALL SELECT 2, 'line', strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS xv,
  NULL, round(avg(o_custkey), 2), count(*) FROM orders GROUP BY xv
UNION ALL SELECT 3, 'bar', o_orderstatus, NULL, round(avg(o_totalprice), 2), count(*)
  FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 4, 'bar', o_orderstatus, NULL, round(avg(o_custkey), 2), count(*)
  FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 5, 'point', xb::VARCHAR, yb, NULL, count(*) FROM p GROUP BY xb, yb""")
def chart_points(spark, sf_dir):
    out = charts.chart_series(_chart_columns(spark, sf_dir))
    return out.select(
        *as_long("rank"), "mark", "x_value", *as_long("y_bin"),
        rounded("y_value", 2).alias("y_value"), "n",
    )


@query("""WITH c AS (SELECT column_name AS n, row_number() OVER () AS i,
  CASE WHEN column_type LIKE 'TIMESTAMP%' THEN 'temporal' WHEN column_type = 'VARCHAR' THEN 'nominal'
       ELSE 'quantitative' END AS t
  FROM (DESCRIBE SELECT ts, user_id, event_type, value FROM events)),
p AS (SELECT a.n AS x, b.n AS y, a.t, least(a.i, b.i) AS lo, greatest(a.i, b.i) AS hi,
  CASE a.t WHEN 'temporal' THEN 'line' WHEN 'nominal' THEN 'bar' ELSE 'point' END AS mark,
  CASE a.t WHEN 'temporal' THEN 0.95 WHEN 'nominal' THEN 0.85 ELSE 0.7 END AS score
  FROM c a JOIN c b ON b.t = 'quantitative' AND (a.t <> 'quantitative' OR a.i < b.i))
SELECT row_number() OVER (ORDER BY score DESC, lo, hi) AS rank, mark, score::DOUBLE AS score, x, y,
  t || ' x against quantitative y' AS rationale,
  '{"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "mark": "' || mark || '", "encoding": {"x": {"field": "'
    || x || '", "type": "' || t || '"}, "y": {"field": "' || y || '", "type": "quantitative"}}}' AS spec FROM p""")
def chart_suggest(spark, sf_dir):
    """Suggestions for columns of which one was read as text and got its type from its values."""
    rows = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", F.col("value").cast("string").alias("value"))
    return charts.chart_suggestions(apply_inferred(rows))


@query("""WITH d AS (SELECT count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p
  FROM orders)
SELECT 'line' AS kind, 'o_orderdate' AS x, 'o_totalprice' AS y,
  CASE WHEN s <= p THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS color FROM d""")
def chart_recommend(spark, sf_dir):
    return charts.recommend_chart(table(spark, sf_dir, "orders")).select(
        "kind", "x", "y", "color"
    )


@query("""SELECT count(*) AS total_rows, 'integer' AS first_type,
  count(*)::VARCHAR || ' rows in 5 columns (2 integer, 2 string, 1 number).' AS summary,
  least(count(*), 50) AS sampled FROM customer""")
def profile_table(spark, sf_dir):
    out = table_profile(table(spark, sf_dir, "customer"))
    return out.select(
        "total_rows", F.col("columns")[0]["type"].alias("first_type"), "summary",
        F.size("sample_rows").cast("bigint").alias("sampled"),
    )


@query("""SELECT 'c_custkey' AS "column", 'c_custkey is different in every row' AS observation
  FROM customer HAVING count(DISTINCT c_custkey) = count(*)
UNION ALL SELECT 'c_name', 'c_name is different in every row' FROM customer
  HAVING count(DISTINCT c_name) = count(*)
UNION ALL SELECT 'c_acctbal', 'c_acctbal is different in every row' FROM customer
  HAVING count(DISTINCT c_acctbal) = count(*)
UNION ALL SELECT 'c_mktsegment', 'c_mktsegment misses '
  || printf('%.1f', sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END) * 100.0 / count(*))
  || '% of its values' FROM customer""")
def profile_observations(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn(
        "c_mktsegment", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY"))
    )
    return observations(rows).select("column", "observation")


# ---- quality -----------------------------------------------------------------------------------

def _flawed_orders(spark, sf_dir):
    """Orders with missing values, one foreign date shape and text among numbers."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(~urgent, F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_totalprice") > 495000, F.col("o_totalprice") * 40)
        .otherwise(F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_totalprice") < 5000, F.date_format("o_orderdate", "dd MMM yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(F.col("o_totalprice") < 8000, F.lit("n/a"))
        .otherwise(F.col("o_custkey").cast("string")).alias("customer"),
    )


_FLAWED = """WITH flawed AS (SELECT o_orderkey,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderstatus END AS status,
  CASE WHEN o_totalprice > 495000 THEN o_totalprice * 40 ELSE o_totalprice END AS price,
  CASE WHEN o_totalprice < 5000 THEN strftime(o_orderdate, '%d %b %Y')
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  CASE WHEN o_totalprice < 8000 THEN 'n/a' ELSE o_custkey::VARCHAR END AS customer FROM orders)
"""
_FINDING = ("kind", "column", "severity", "affected")


@query(_FLAWED + """SELECT 'missing_values' AS kind, 'status' AS "column",
  CASE WHEN s < 0.1 THEN 'low' WHEN s <= 0.3 THEN 'medium' ELSE 'high' END AS severity, affected,
  round(s, 4) AS share
FROM (SELECT count(*) - count(status) AS affected, (count(*) - count(status)) / count(*) AS s
      FROM flawed)""")
def quality_missing(spark, sf_dir):
    return quality.missing_values(_flawed_orders(spark, sf_dir)).select(
        *_FINDING, rounded("share").alias("share")
    )


_OUTLIER_SQL = _FLAWED + """, q AS (SELECT quantile_cont(price, 0.25) AS q1,
  quantile_cont(price, 0.75) AS q3, max(price) AS hi, min(price) AS lo FROM flawed),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high, q3 - q1 AS iqr, hi, lo
  FROM q),
o AS (SELECT count(*) AS affected FROM flawed, f WHERE price < low OR price > high)
SELECT 'outlier' AS kind, 'price' AS "column",
  CASE WHEN greatest(low - lo, hi - high) / iqr > 10 THEN 'high'
       WHEN greatest(low - lo, hi - high) / iqr > 3 THEN 'medium' ELSE 'low' END AS severity,
  affected FROM o, f WHERE affected > 0"""


@query(_OUTLIER_SQL)
def quality_outlier(spark, sf_dir):
    return quality.outliers(_flawed_orders(spark, sf_dir)).select(*_FINDING)


@query(_OUTLIER_SQL)
def quality_outlier_bracketed(spark, sf_dir):
    return quality.outliers(_flawed_orders(spark, sf_dir), small_input=0).select(*_FINDING)


_MINORITY_SQL = """SELECT kind, "column", CASE WHEN share < 0.01 THEN 'low'
  WHEN share <= 0.05 THEN 'medium' ELSE 'high' END AS severity, affected
FROM ({}) WHERE affected > 0 AND share <= 0.1"""


@query(_FLAWED + _MINORITY_SQL.format(
    """SELECT 'format_inconsistency' AS kind, c AS "column", (total - best)::BIGINT AS affected,
  (total - best) / total AS share FROM (
  SELECT c, max(n) AS best, sum(n) AS total FROM (SELECT c,
      regexp_replace(regexp_replace(regexp_replace(v, '[A-Za-z]+', 'A', 'g'), '[0-9]+', '9', 'g'),
        '\\s+', ' ', 'g') AS mask, count(*) AS n
    FROM (UNPIVOT flawed ON status, day, customer INTO NAME c VALUE v) GROUP BY ALL) GROUP BY c)"""))
def quality_format(spark, sf_dir):
    return quality.format_inconsistency(_flawed_orders(spark, sf_dir)).select(*_FINDING)


@query(_FLAWED + _MINORITY_SQL.format(
    """SELECT 'type_drift' AS kind, c AS "column", (total - best)::BIGINT AS affected,
  (total - best) / total AS share FROM (SELECT c, max(n) AS best, sum(n) AS total FROM (
    SELECT c, CASE WHEN regexp_full_match(v, '-?[0-9]+') THEN 'integer'
        WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'number' ELSE 'string' END AS tag,
      count(*) AS n
    FROM (UNPIVOT flawed ON status, day, customer INTO NAME c VALUE v) GROUP BY ALL) GROUP BY c)"""))
def quality_drift(spark, sf_dir):
    return quality.type_drift(_flawed_orders(spark, sf_dir)).select(*_FINDING)


@query("""SELECT 'possible_duplicate' AS kind, 'text' AS "column",
  CASE WHEN a / t < 0.1 THEN 'low' WHEN a / t <= 0.3 THEN 'medium' ELSE 'high' END AS severity,
  a AS affected
FROM (SELECT count(*) - count(DISTINCT text) AS a, count(*) AS t FROM documents) WHERE a > 0""")
def quality_duplicates(spark, sf_dir):
    return quality.possible_duplicates(table(spark, sf_dir, "documents"), ["text"]).select(*_FINDING)


@query(" UNION ALL ".join(
    f'SELECT kind, "column", severity, affected FROM ({SQL[name]})'
    for name in ("quality_missing", "quality_outlier", "quality_format", "quality_drift")
))
def quality_findings(spark, sf_dir):
    """The whole report; no order repeats another."""
    return quality.quality_report(_flawed_orders(spark, sf_dir)).select(*_FINDING)


@query("""SELECT count(*) AS rows, 0 AS findings FROM orders WHERE o_orderkey < 0""")
def quality_of_nothing(spark, sf_dir):
    """An empty table has no findings."""
    none = _flawed_orders(spark, sf_dir).filter("o_orderkey < 0")
    return quality.quality_report(none).agg(
        F.lit(0).cast("bigint").alias("rows"), F.count("*").alias("findings"))
