import re

import pytest
from pyspark.sql import functions as F

from tabsift.llm.decontam import contaminated, decontaminate, item_shingles, shingle_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    w = WORD.findall((text or "").lower())
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def runs(text, sizes):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i:i + n]) for n in sizes for i in range(len(w) - n + 1)}


def plain(docs, items, percent=75):
    out = set()
    for d, t in docs:
        for i, u in items:
            b = plain_set(u)
            a = runs(t, {len(s) for s in b})
            if b and 100 * len(a & b) >= percent * len(b):
                out.add((d, i, len(a & b), len(b)))
    return out


def text(*parts):
    return " ".join(parts)


LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "One two  three\tfour five six"), (3, "only three words"), (4, ""), (5, None),
         (6, " ".join(f"w{i}" for i in range(20, 60))), (7, "Ünï cödé straße a b c d"), (8, "a a a a a a a a a"),
         (9, "alpha beta gamma"), (10, "Zeta"), (11, "one two"), (12, "has only three words")]


def docs_of():
    words = LONG.split()
    filler = " ".join(f"f{i}" for i in range(3000))
    rows = [(0, text(filler, LONG, filler)), (1, "x ONE two three four FIVE six y"), (2, "only three words"),
            (3, "has only three words in it"), (4, None), (5, ""), (6, "  \n "), (None, LONG),
            (8, "a a a a a"), (9, "b ünï cödé STRASSE a b c d"), (10, filler), (12, text(filler, "ALPHA  beta\tgamma", filler)), (13, "alpha beta"),
            (14, "x alpha beta zeta gamma"), (15, "zeta"), (16, "beta gamma alpha beta gamma"), (11, LONG), (11, filler)]
    for k in range(0, 40, 2):
        rows.append((100 + k, text("p", *words[k:], "q")))
        rows.append((101 + k, text(*[w if i != k else "zzz" for i, w in enumerate(words)])))
    return rows


@pytest.mark.parametrize("percent", [50, 75, 100])
def test_against_brute_force(spark, percent):
    rows = docs_of()
    docs = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, shingle string, n_item int")
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, hash int")
    got = contaminated(docs, items, percent).collect()
    assert {(r.doc_id, r.item_id, r.n_matched, r.n_item) for r in got} == plain(rows, ITEMS, percent)
    assert all(r.containment == r.n_matched / r.n_item for r in got)


def test_sketches_cannot_miss(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for r in item_shingles(items).groupBy("item_id", "n_item", "need").agg(
            F.sum(F.col("in_sketch").cast("int")).alias("k"), F.count("*").alias("n")).collect():
        assert r.n == r.n_item
        assert r.k >= r.n_item - r.need + 1


def test_hashes_are_one_per_shingle(spark):
    df = spark.createDataFrame([(t,) for t in ("a b c d e f", "a b", "", None)], "t string")
    assert [len(r.h) for r in df.select(shingle_hashes(F.col("t")).alias("h")).collect()] == [2, 0, 0, 0]
    assert [len(r.h) for r in df.select(shingle_hashes(F.col("t"), [1, 2]).alias("h")).collect()] == [13, 3, 0, 0]


def test_documents_go_and_clean_ones_stay(spark):
    rows = docs_of()
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, _bad string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = plain([(i, t) for i, (_, t) in enumerate(rows)], ITEMS)
    want = [r for i, r in enumerate(rows) if i not in {b[0] for b in bad}]
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, LONG), (1, LONG), (2, LONG + " x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, LONG), (1, LONG)], "item_id long, text string")
    assert sorted((r.doc_id, r.n_matched) for r in contaminated(docs, items).collect()) == [(1, 36), (2, 36)]
    assert decontaminate(docs, items).count() == 0
    assert contaminated(docs.limit(0), items).count() == 0
    assert decontaminate(docs, items.limit(0)).count() == 3


def test_no_python_on_the_way(spark):
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    plan = contaminated(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
