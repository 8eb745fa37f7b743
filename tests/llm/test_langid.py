import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsift.llm.langid import BUCKETS, Model, codewords, fitted, frequencies, identify, train
from tabsift.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, score double, _t string"


def plain_share(text):
    """N-gram shares of one text, letter by letter."""
    low = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
                for c in b" " + text.encode() + b" ")
    row = np.zeros(BUCKETS)
    for i in range(len(low) - 2):
        code = low[i] << 16 | low[i + 1] << 8 | low[i + 2]
        row[(code * 2654435761 % 2**32) >> 18] += 1
    return row / max(1, row.sum())


def test_frequencies():
    texts = ["", "a", "Ab, cd!", "é" * 50, "the " * 400, "x" * 9_000_000, "ü ñ 123"]
    got = frequencies([t.encode() for t in texts])
    for t, row in zip(texts, got):
        # A text longer than a piece has the shares of a shorter one, but for its two edges.
        want = plain_share(t) if len(t) < 10**6 else frequencies([b"x" * 1_000_000])[0]
        assert np.allclose(row, want, atol=1e-5 if len(t) > 10**6 else 1e-12)


@pytest.mark.parametrize("n", range(2, 60, 3))
def test_codewords_lie_apart(n):
    code = codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
    apart = (code[:, None] != code[None]).sum(2) + np.eye(n) * 99
    assert apart.min() >= (1 if n < 4 else 4)
    assert (np.abs(code.sum(0)) < n).all()


def test_decoding_repairs_a_wrong_bit():
    code = codewords(4)
    model = Model(list("abcd"), code, np.eye(7), np.full((4, 7), 1 / 7))
    for k in range(4):
        for wrong in range(7):
            margins = code[k].copy()
            margins[wrong] *= -0.9
            best, score = model.decode(margins[None])
            assert best[0] == k and 0 < score[0] < 1
    best, score = model.decode(np.zeros((1, 7)))
    assert score[0] == 0


def test_decoding_against_plain_loops():
    rng = np.random.default_rng(3)
    sums = {k: rng.integers(1, 1000, BUCKETS) for k in ("x", "y", "z")}
    model = fitted(sums)
    share = rng.random((5, BUCKETS))
    share /= share.sum(1, keepdims=True)
    best, _ = model.decode(share)
    for row, got in zip(share, best):
        away = []
        for k in range(3):
            total = 0.0
            for b in range(model.code.shape[1]):
                margin = sum(float(s) * float(w) for s, w in zip(row, model.weights[:, b]))
                total += model.trust[k, b] * math.exp(-margin * model.code[k, b])
            away.append(total)
        assert got == int(np.argmin(away))


def test_held_out_accuracy_and_folds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op1_ecoc_language"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) > 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    # Labels of held-out documents are never read.
    blind = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "zz")
                            .otherwise(F.col("lang")))
    again = {r.doc_id: (r.lang_pred, r.score) for r in identify(blind).collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in rows}


def test_odd_rows(spark):
    base = [(i, w * 20, l) for i, (w, l) in enumerate(
        [("the thing and ", "en"), ("der und die ", "de"), ("el los una ", "es")] * 6)]
    rows = base + [(100, None, "en"), (101, "", "en"), (102, "123 !?", "en"), (None, "the and ", None),
                   (103, "漢字漢字漢字", None), (104, "the thing " * 100000, "en"), (1, "der und die " * 20, "de")]
    df = spark.createDataFrame([(*r, 1.5, "q") for r in rows], COLUMNS)
    got = identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (100, 101, 102):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0) and by[i].ambiguous
    assert by[None].lang_pred == "en" and by[None].held_out
    assert by[103].ambiguous
    assert by[104].lang_pred == "en"
    for i, _, l in base:
        assert by[i].lang_pred == l


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "the", None, 0.0, "")], COLUMNS)
    assert train(df) is None
    assert [r.lang_pred for r in identify(df).collect()] == ["und"]
    assert identify(df.limit(0)).count() == 0


def test_one_language(spark):
    df = spark.createDataFrame([(i, "abc def", "en", 0.0, "") for i in range(10)], COLUMNS)
    assert {(r.lang_pred, r.score) for r in identify(df).collect()} == {("en", 1.0)}
