import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsift.llm import fst
from tabsift.llm.fst import SPACE, Transducer, Vocabulary, count_tokens, segments, token_counts, transducer
from tabsift.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "   ", "a  b", "a ", "\t a\n\nb", "é ﬁ ① Ａ", "<s> </s> <unk>", "▁a ▁▁b", "日本語😀x", "x\x00y", "é",
       "a" * 3000, "the" * 700, " " * 1000 + "x", "ab" * 60_000, "​　\xa0", "word " * 30_000, "▁" * 40, " ▁ ▁",
       "日本語" * 2000, "￾\U0010ffff"]


def library(texts):
    return [len(MODEL.encode(t)) for t in texts]


def test_counts_are_the_librarys(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert count_tokens(ODD + docs, PATH).tolist() == library(ODD + docs)


@given(st.lists(st.text(max_size=40), max_size=5))
@settings(max_examples=300, deadline=None)
def test_any_texts(texts):
    assert count_tokens(texts, PATH).tolist() == library(texts)


@given(st.lists(st.text(alphabet="aabehtnds ▁é\n", max_size=300), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_few_letters(texts):
    assert count_tokens(texts, PATH).tolist() == library(texts)


@pytest.mark.parametrize("chunk", [1, 2, 5, 16])
def test_short_chunks_compose_to_the_same(chunk):
    import numpy as np

    rng, machine = random.Random(chunk), transducer(PATH)
    for _ in range(20):
        text = "".join(rng.choice("thene an  ▁x\té") * rng.choice([1, 1, 9]) for _ in range(60))
        codes = np.frombuffer((SPACE + text).encode("utf-32-le"), np.uint32)
        assert machine.changes(codes, np.array([0]), chunk).sum() == library([text])[0]


def test_segments_are_cut_where_tokens_cannot_reach():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice(["the ", " ", "▁", "ab", "é", "\n"]) for _ in range(200))
        parts = list(segments(text, 7))
        assert "".join(parts) == SPACE + text
        assert all(p[0] == " " for p in parts[1:])
        machine = transducer(PATH)
        assert count_tokens([text], PATH).tolist() == library([text])
        assert machine is not None


def test_a_full_table_starts_anew(monkeypatch):
    machine = Transducer(Vocabulary(PATH))
    monkeypatch.setattr(fst, "MOST_STATES", 50)
    monkeypatch.setattr(fst, "transducer", lambda path: machine)
    monkeypatch.setattr(fst, "SEGMENT", 100)
    texts = ["the quick brown fox " * 5, "über den Häusern " * 20, "naïve café " * 30] * 3
    assert count_tokens(texts, PATH).tolist() == library(texts)
    assert len(machine.states) < 400


def test_other_models_go_through_the_library(monkeypatch):
    monkeypatch.setattr(fst, "transducer", lambda path: None)
    assert count_tokens(ODD, PATH).tolist() == library(ODD)


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, None), (3, None), (99, "x " * 4096), (98, "x " * 4095)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, n_tokens string, _n int")
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df).collect()]
    want = [(d, len((t or "").encode()), n, n > 4096) for (d, t), n in zip(rows, library([t or "" for _, t in rows]))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_token_transducer"](spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == dict(zip(docs, library(list(docs.values()))))
