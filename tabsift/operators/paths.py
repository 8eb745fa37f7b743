"""Path profile of nested documents: types, depth and frequency of every path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsift.functions.exprs import whole_json_or_fail
from tabsift.functions.tags import variant_tag
from tabsift.session import reliable_checkpoint

# Tree levels one plan unfolds; deeper documents go on in further rounds.
LEVELS_PER_ROUND = 12

def text_depth(text: Column) -> Column:
    """Upper bound of a JSON text's tree depth, from its brackets alone (a scalar has depth 1)."""
    # Escaped characters go first: what is left between two quotes is then one string.
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*"', "")
    brackets = F.regexp_replace(bare, r"[^\[\]{}]", "")
    walk = F.aggregate(
        F.split(brackets, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("deepest")),
        lambda acc, ch: F.struct(
            (acc["now"] + F.when(ch.isin("{", "["), 1).when(ch.isin("}", "]"), -1).otherwise(0))
            .alias("now"),
            F.greatest(
                acc["deepest"], acc["now"] + F.when(ch.isin("{", "["), 1).otherwise(0)
            ).alias("deepest"),
        ),
        lambda acc: acc["deepest"],
    )
    return walk + 1


def _children(node: Column, path: Column, level: int, arrays: str) -> Column:
    """Child nodes of an object or array, empty for an empty one, null for a scalar."""

    def child(step: Column, value: Column) -> Column:
        return F.struct(
            F.concat(path, F.lit("."), step).alias("path"), F.lit(level + 1).alias("depth"),
            F.lit(None).cast("string").alias("type"), value.alias("v"),
        )

    def index(i: Column) -> Column:
        if arrays == "collapse":
            return F.lit("[*]")
        return F.concat(F.lit("["), i.cast("string"), F.lit("]"))

    def items_of(value: Column) -> Column:
        return F.try_variant_get(value, "$", "array<variant>")

    entries = F.map_entries(F.try_variant_get(node, "$", "map<string,variant>"))
    if arrays == "repeat":
        grown = F.flatten(F.transform(entries, lambda e: F.transform(
            F.coalesce(items_of(e["value"]), F.array(e["value"])), lambda v: child(e["key"], v)
        )))
    else:
        grown = F.transform(entries, lambda e: child(e["key"], e["value"]))
    return F.coalesce(grown, F.transform(items_of(node), lambda v, i: child(index(i), v)))


def document_nodes(
    df: DataFrame,
    text: str,
    keep: list[str] | None = None,
    root: str = "$",
    max_depth: int | None = None,
    arrays: str = "index",
) -> DataFrame:
    """Every node of every JSON document: ``keep..., path, depth, type``.

    Texts that are no JSON have none; a text too large for a VARIANT fails the job.

    The tree is unfolded one level per step in a single chain over one scan: each step names the
    type of the deepest nodes, lets go of their values and adds their children. Without
    ``max_depth`` one aggregate job finds how many steps the deepest document needs.

    ``arrays`` says how their items are named: by ``index``, all alike (``collapse``), or as
    repeats of the array's own path (``repeat``), which is how XML repeats an element.
    """
    kept = [F.col(k) for k in keep or []]
    if max_depth is None:
        max_depth = df.agg(F.max(text_depth(F.col(text)))).first()[0] or 1
    nodes = df.select(*kept, whole_json_or_fail(F.col(text)).alias("v")).filter(F.col("v").isNotNull())
    nodes = nodes.select(
        *kept, F.lit(root).alias("path"), F.lit(1).alias("depth"),
        F.lit(None).cast("string").alias("type"), "v",
    )
    named, level = None, 1
    while True:
        last = min(level + LEVELS_PER_ROUND - 1, max_depth)
        nodes = _unfold(nodes, kept, level, last, last == max_depth, arrays)
        done = nodes.select(*kept, "path", "depth", "type")
        if last == max_depth:
            return done if named is None else named.unionByName(done)
        # The few documents that go deeper continue from reliable storage.
        nodes = reliable_checkpoint(nodes)
        done = nodes.filter(F.col("type").isNotNull()).select(*kept, "path", "depth", "type")
        named = done if named is None else named.unionByName(done)
        nodes = nodes.filter(F.col("type").isNull())
        if nodes.isEmpty():
            return named
        level = last + 1


def _unfold(
    nodes: DataFrame, kept: list[Column], first: int, last: int, final: bool, arrays: str
) -> DataFrame:
    """Name the types of the levels ``first`` to ``last``; children of the last are left unnamed,
    or not added at all when it is the final one."""
    path, depth, v = F.col("path"), F.col("depth"), F.col("v")
    for level in range(first, last + 1):
        here = depth == level
        kids = F.when(here, _children(v, path, level, arrays)).alias("kids")
        found = (
            F.when(~here, F.col("type")).when(F.size("kids") > 0, "object")
            .when(F.col("kids").isNotNull(), "null").otherwise(variant_tag(v)).alias("type")
        )
        nothing = F.lit(None).cast("variant").alias("v")
        nodes = nodes.select(*kept, "path", "depth", "type", "v", kids)
        if final and level == last:
            return nodes.select(*kept, "path", "depth", found, nothing)
        own = F.array(F.struct(path.alias("path"), depth.alias("depth"), found, nothing))
        both = F.when(F.size("kids") > 0, F.concat(own, F.col("kids"))).otherwise(own)
        nodes = nodes.select(*kept, F.inline(both))
    return nodes


def path_profile(df: DataFrame, text: str, **options) -> DataFrame:
    """``path, types, depth_min, depth_max, frequency`` over all documents.

    At most six types exist per path, and everything combines before the shuffle.
    """
    return (
        document_nodes(df, text, **options)
        .groupBy("path")
        .agg(
            F.sort_array(F.collect_set("type")).alias("types"),
            F.min("depth").alias("depth_min"),
            F.max("depth").alias("depth_max"),
            F.count(F.lit(1)).alias("frequency"),
        )
    )


def document_totals(df: DataFrame, text: str, keep: list[str], **options) -> DataFrame:
    """``keep..., depth, leaf_count, node_count`` per document, with no shuffle of its nodes.

    Depth and counts come from the document itself, so a huge document stays in its own row.
    """
    nodes = document_nodes(df, text, keep=keep, **options)
    return nodes.groupBy(*keep).agg(
        F.max("depth").alias("depth"),
        F.count_if(F.col("type") != "object").alias("leaf_count"),
        F.count(F.lit(1)).alias("node_count"),
    )


def corpus_totals(df: DataFrame, text: str, **options) -> DataFrame:
    """One row: ``depth, leaf_count, node_count, paths`` of the whole corpus."""
    profile = document_nodes(df, text, **options).groupBy("path").agg(
        F.max("depth").alias("depth"),
        F.count_if(F.col("type") != "object").alias("leaves"),
        F.count(F.lit(1)).alias("nodes"),
    )
    return profile.agg(
        F.max("depth").alias("depth"),
        F.sum("leaves").alias("leaf_count"),
        F.sum("nodes").alias("node_count"),
        F.count(F.lit(1)).alias("paths"),
    )


def struct_paths(schema: T.StructType, root: str = "$") -> list[tuple[str, str]]:
    """Paths and types of a fixed nested schema, read from the schema alone."""
    out: list[tuple[str, str]] = []

    def visit(dtype: T.DataType, path: str) -> None:
        if isinstance(dtype, T.StructType):
            out.append((path, "object"))
            for f in dtype.fields:
                visit(f.dataType, f"{path}.{f.name}")
        elif isinstance(dtype, T.ArrayType):
            out.append((path, "object"))
            visit(dtype.elementType, f"{path}.[*]")
        else:
            out.append((path, dtype.simpleString()))

    visit(schema, root)
    return out
