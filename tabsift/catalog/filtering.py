"""Queries: column, row, regex and expression filters, previews and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tabsift.catalog.base import query, table
from tabsift.operators.expression import register_function
from tabsift.operators.filters import apply_filter, preview, validate_filter


@query("""SELECT l_shipdate, l_orderkey, l_quantity FROM lineitem""")
def column_keep(spark, sf_dir):
    keep = ["l_shipdate", "l_orderkey", "no_such_column", "l_quantity"]
    return apply_filter(table(spark, sf_dir, "lineitem"), {"kind": "column", "keep": keep})


@query("""SELECT l_orderkey, l_linenumber FROM lineitem""")
def column_include(spark, sf_dir):
    spec = {"kind": "column", "include": ["l_orderkey", "l_linenumber"]}
    return apply_filter(table(spark, sf_dir, "lineitem"), spec)


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""")
def column_exclude(spark, sf_dir):
    spec = {"kind": "column", "exclude": ["o_orderdate", "o_orderpriority"]}
    return apply_filter(table(spark, sf_dir, "orders"), spec)


def _sparse_events(spark, sf_dir):
    """Events with nulls: ``tag`` has none for errors, ``amount`` none for small values."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id",
        F.nullif(F.col("event_type"), F.lit("error")).alias("tag"),
        F.when(F.col("value") >= 5, F.col("value")).alias("amount"),
    )


_SPARSE = """WITH sparse AS (
  SELECT event_id, user_id, nullif(event_type, 'error') AS tag,
         CASE WHEN value >= 5 THEN value END AS amount FROM events)
SELECT event_id, user_id, tag, amount FROM sparse WHERE """

_ROW_CASES = {
    "row_eq": (("tag", "eq", "click"), "tag IS NOT DISTINCT FROM 'click'"),
    "row_eq_null": (("tag", "eq", None), "tag IS NOT DISTINCT FROM NULL"),
    "row_ne": (("tag", "ne", "click"), "tag IS DISTINCT FROM 'click'"),
    "row_gt": (("amount", "gt", "20"), "amount > 20"),
    "row_gte": (("amount", "gte", 20.5), "amount >= 20.5"),
    "row_lt": (("amount", "lt", 10), "amount < 10"),
    "row_lte": (("user_id", "lte", "40"), "user_id <= 40"),
    "row_contains": (("tag", "contains", "ic"), "contains(tag, 'ic')"),
    "row_starts_with": (("user_id", "starts_with", "1"),
                        "starts_with(CAST(user_id AS VARCHAR), '1')"),
    "row_ends_with": (("tag", "ends_with", "ew"), "ends_with(tag, 'ew')"),
    "row_regex": (("tag", "regex", "^(si|pu)"), "regexp_matches(tag, '^(si|pu)')"),
    "row_in": (("tag", "in", ["click", "view"]), "tag IN ('click', 'view')"),
    "row_in_null": (("tag", "in", ["click", None]), "tag = 'click' OR tag IS NULL"),
    "row_not_in": (("tag", "not_in", ["click", "view"]),
                   "tag IS NULL OR tag NOT IN ('click', 'view')"),
    "row_is_null": (("amount", "is_null", None), "amount IS NULL"),
    "row_is_not_null": (("amount", "is_not_null", None), "amount IS NOT NULL"),
}


def _row_query(col, op, value):
    def run(spark, sf_dir):
        spec = {"kind": "row", "predicate": {"col": col, "op": op, "value": value}}
        return apply_filter(_sparse_events(spark, sf_dir), spec)

    return run


for _name, (_predicate, _where) in _ROW_CASES.items():
    query(_SPARSE + _where, name=_name)(_row_query(*_predicate))


@query("""SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE regexp_matches(p_name, '(?i)RING$') OR regexp_matches(p_brand, '(?i)RING$')
   OR regexp_matches(p_type, '(?i)RING$')""")
def regex_any(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return apply_filter(parts, {"kind": "regex", "pattern": "RING$", "flags": ["i"]})


@query(r"""SELECT doc_id FROM documents
WHERE regexp_matches(text, '\d{3}-\d{4}') OR regexp_matches(lang, '\d{3}-\d{4}')
   OR regexp_matches(source, '\d{3}-\d{4}')""")
def regex_documents(spark, sf_dir):
    docs = apply_filter(
        table(spark, sf_dir, "documents"), {"kind": "regex", "pattern": r"\d{3}-\d{4}"}
    )
    return docs.select("doc_id")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity > 10 AND (l_returnflag = 'R' OR l_discount >= 0.05)""")
def expression_filter(spark, sf_dir):
    text = "l_quantity > 10 AND (l_returnflag = 'R' or l_discount >= 0.05)"
    kept = apply_filter(table(spark, sf_dir, "lineitem"), {"kind": "expression", "expr": text})
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query(_SPARSE + """(NOT coalesce(tag = 'click', FALSE))
  AND (NOT coalesce(amount > 20, FALSE)) AND tag IS DISTINCT FROM 'a = b'""")
def expression_nulls(spark, sf_dir):
    text = "NOT (tag = 'click') and not amount > 20 and tag != 'a = b'"
    return apply_filter(_sparse_events(spark, sf_dir), {"kind": "expression", "expr": text})


@query(_SPARSE + """NOT (tag = 'click')""")
def expression_sql_nulls(spark, sf_dir):
    spec = {"kind": "expression", "expr": "NOT (tag = 'click')", "sql_nulls": True}
    return apply_filter(_sparse_events(spark, sf_dir), spec)


@query(_SPARSE + """(NOT coalesce(tag LIKE 'c%', FALSE)) AND (NOT coalesce(tag IN ('view', 'error'), FALSE))
  AND (NOT coalesce(amount + 1 > 20, FALSE))
  AND (NOT coalesce(amount BETWEEN 2 AND 5, FALSE) OR coalesce(tag = 'signup', FALSE))""")
def expression_negations(spark, sf_dir):
    text = ("NOT tag LIKE 'c%' AND NOT tag IN ('view', 'error') AND NOT amount + 1 > 20 "
            "AND (NOT amount BETWEEN 2 AND 5 OR tag = 'signup')")
    return apply_filter(_sparse_events(spark, sf_dir), {"kind": "expression", "expr": text})


@query("""SELECT l_orderkey, l_linenumber FROM lineitem
WHERE floor((l_quantity - 30) / 7) = -2 OR power(l_linenumber, power(2, 2)) > 1000
  OR floor(floor(l_quantity * 2 / 3) / 5) = 6""")
def expression_arithmetic(spark, sf_dir):
    text = "(l_quantity - 30) // 7 = -2 OR l_linenumber ** 2 ** 2 > 1000 OR l_quantity * 2 // 3 // 5 = 6"
    kept = apply_filter(table(spark, sf_dir, "lineitem"), {"kind": "expression", "expr": text})
    return kept.select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem
WHERE CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE l_linenumber END > 6""")
def expression_ternary(spark, sf_dir):
    text = "if(l_returnflag = 'R', l_quantity, l_linenumber) > 6"
    kept = apply_filter(table(spark, sf_dir, "lineitem"), {"kind": "expression", "expr": text})
    return kept.select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_shipdate IS NOT NULL AND l_discount < 0.02 AND TRUE""")
def expression_constants(spark, sf_dir):
    text = "l_shipdate != None AND l_discount < 2e-2 AND True"
    kept = apply_filter(table(spark, sf_dir, "lineitem"), {"kind": "expression", "expr": text})
    return kept.select("l_orderkey", "l_linenumber")


@query("""SELECT name, problem FROM (SELECT DISTINCT 'l_quantities' AS name,
  'unknown name: `l_quantities`' AS problem FROM lineitem
  UNION ALL SELECT DISTINCT 'l_quantity', NULL FROM lineitem)""")
def expression_names(spark, sf_dir):
    """What validation says about a name that the table lacks and one that it has."""
    rows = table(spark, sf_dir, "lineitem")
    said = {n: validate_filter(rows, {"kind": "expression", "expr": f"{n} > 1"})
            for n in ("l_quantities", "l_quantity")}
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p[0] if p else None).cast("string").alias("problem"))
                      for n, p in said.items()])
    return rows.select(F.inline(pairs)).distinct()


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 3 <> 0""")
def expression_truthy(spark, sf_dir):
    kept = apply_filter(
        table(spark, sf_dir, "lineitem"), {"kind": "expression", "expr": "l_linenumber % 3"}
    )
    return kept.select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 2 > 80""")
def expression_udf(spark, sf_dir):
    @F.pandas_udf("double")
    def twice(v: pd.Series) -> pd.Series:
        return v * 2

    register_function(spark, "twice", twice, signature="twice(number) -> number")
    kept = apply_filter(
        table(spark, sf_dir, "lineitem"), {"kind": "expression", "expr": "twice(l_quantity) > 80"}
    )
    return kept.select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000
ORDER BY o_orderkey LIMIT 20""")
def preview_first_rows(spark, sf_dir):
    ordered = table(spark, sf_dir, "orders").orderBy("o_orderkey")
    spec = {"kind": "row", "predicate": {"col": "o_totalprice", "op": "gt", "value": 100000}}
    return preview(ordered, spec, 20).select("o_orderkey", "o_totalprice")
