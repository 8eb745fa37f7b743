import collections
import re

import numpy as np
import pytest
from test_decontam import plain_set as lowered_set
from test_jaccard import plain as plain_components
from test_packing import check
from test_secrets import plain as plain_spans

import __spark_entry__ as entry
import corpus_pipeline
from tabsift.llm.packing import best_fit
from tabsift.llm.secrets import scan

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "jaccard_join", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before and after every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("steps") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(steps):
    for df in steps[:-1]:
        assert df.columns == COLUMNS


def test_language_keeps_all_with_letters(steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert set(after) == {d for d, r in before.items() if re.search(r"[^\W\d_]", r.text or "")}
    assert all(after[d] == before[d] for d in after)


def test_one_of_each_group_stays(steps):
    before, after = rows(steps[1]), rows(steps[2])
    comps = plain_components([(d, r.text) for d, r in before.items()])
    assert set(after) == {d for d, n, c in comps if d == c}
    assert all(after[d] == before[d] for d in after)


def test_no_benchmark_item_is_left(spark, steps):
    items = [lowered_set(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(steps[2]), rows(steps[3])
    bad = {d for d, r in before.items()
           if any(100 * len(s & lowered_set(r.text)) >= 75 * len(s) for s in items)}
    assert set(after) == set(before) - bad


def test_no_secret_is_left(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    for d, r in after.items():
        assert not plain_spans(r.text) and scan(r.text)[1] == []
        if not scan(before[d].text)[1]:
            assert r == before[d]
        else:
            assert r.n_chars == len(r.text)


def test_packing_of_what_is_left(steps):
    docs = [(d, r.text) for d, r in rows(steps[4]).items()]
    packed = steps[5].collect()
    n = check(packed, docs, 1024)
    assert n == len(best_fit(np.array([r.length for r in packed]), 1024)[2])


def test_run_gives_the_same(spark, steps):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert collections.Counter(map(key, corpus_pipeline.run(spark, SF).collect())) == collections.Counter(
        map(key, steps[5].collect()))


def test_stages_on_odd_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, 5), (None, "der und die " * 30, "de", "s", 1, 6), (2, "the and of " * 30, "en", "s", 1, 7),
         (2, "the and of " * 30, "en", "s", 1, 7), (3, "", "en", "s", 0, 8)],
        "doc_id long, text string, lang string, source string, n_chars long, _t int")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            out.collect()
            if name != "best_fit_packing":
                assert out.columns == df.columns
