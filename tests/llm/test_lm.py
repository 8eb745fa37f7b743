import collections
import math
import zlib

import numpy as np
import pytest

from tabsift.llm import lm
from tabsift.llm.lm import (
    CLASSES, END, ROWS, SINGLE, TABLES, Vocabulary, class_log_probabilities, descend, features, score_documents,
    tokens)
from tabsift.llm.queries import QUERIES

COLUMNS = "doc_id long, text string, word string, count int, words array<int>"


def words_of(text):
    return (text or "").encode().lower().split()


def learned(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1


def plain_base(rows):
    """``(n_tokens, n_known, N, base_score)`` per row, by counting words."""
    counts = collections.Counter()
    for d, t in rows:
        if learned(d):
            counts.update(words_of(t) + [None])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        own = words_of(t) + [None]
        score = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        out.append((d, len(own), sum(counts[w] > 0 for w in own), total, score))
    return out


def rows_of():
    rows = [(i, "the cat sat on the mat " * (i % 7) + f"word{i} Zeta") for i in range(60)]
    return rows + [(100, None), (101, ""), (None, "the cat"), (7, "THE the tHe"), (7, "THE the tHe"),
                   (102, "é É x\x0by\x0cz\r\n"), (103, "long " * 200_000), (104, "y" * 600_000 + " the")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", 3, [1]) for r in rows], COLUMNS)


@pytest.mark.parametrize("head", [0, 3, 20, 1 << 19])
def test_base_score_against_counting(spark, head):
    rows = rows_of()
    got = sorted(score_documents(frame(spark, rows), head=head).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    want = sorted(plain_base(rows), key=lambda r: (str(r[0]), r[1]))
    assert len(got) == len(want)
    for r, (d, n, known, total, base) in zip(got, want):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (d, n, known, total)
        assert r.held_out == (not learned(d))
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score < 0


def test_tokens_and_features():
    counts, hashes, shared = next(tokens([b"a b c", b"", b"A b"]))
    assert counts == [4, 1, 3]
    assert hashes[[3, 4, 7]].tolist() == [END] * 3 and (shared[[3, 4, 7]] == 0).all()
    assert hashes[0] == hashes[5] and hashes[1] == hashes[6]
    rows = features(counts, hashes)
    # The contexts of both first words are alike, so are those of the words after "a".
    assert (rows[:, 0] == rows[:, 5]).all() and (rows[:, 0] == rows[:, 4]).all()
    assert (rows[:, 1] == rows[:, 6]).all()
    assert not (rows[:, 2] == rows[:, 1]).all()
    long = b"abc de " * 100_000
    (n, h, s), = list(tokens([long]))
    assert n == [200_001] and len(set(h[:-1].tolist())) == 2


def plain_log_probability(weights, bias, row, kind):
    logits = [float(bias[c]) + sum(float(weights[k][row[k]][c]) for k in range(TABLES)) for c in range(CLASSES)]
    return logits[kind] - math.log(sum(math.exp(x) for x in logits))


def test_softmax_and_gradient():
    rng = np.random.default_rng(1)
    weights = rng.standard_normal((TABLES, ROWS, CLASSES)).astype(np.float32)
    bias = rng.standard_normal(CLASSES).astype(np.float32)
    rows = rng.permutation(ROWS)[:30].reshape(TABLES, 10)
    kinds = rng.integers(0, CLASSES, 10)
    got = class_log_probabilities(weights, bias, rows, kinds)
    for i in range(10):
        assert got[i] == pytest.approx(plain_log_probability(weights, bias, rows[:, i], int(kinds[i])), rel=1e-4)
    before = got.sum()
    for _ in range(20):
        descend(weights, np.zeros((TABLES, ROWS), np.float32), bias, rows, kinds)
    assert class_log_probabilities(weights, bias, rows, kinds).sum() > before


def test_the_model_is_a_distribution():
    """In any context the probabilities of all known words, the end and the unknown ones sum to 1."""
    rng = np.random.default_rng(2)
    text = " ".join(rng.choice([f"w{i}" for i in range(200)], 3000)).encode()
    _, hashes, shared = next(tokens([text]))
    words, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    kinds = shared[first]
    mass, members = np.bincount(kinds, counts, CLASSES), np.bincount(kinds, minlength=CLASSES).astype(float)
    top = np.argsort(-counts)[:SINGLE]
    top = top[words[top] != END]
    top = top[np.argsort(words[top])]
    for k, i in enumerate(top):
        mass[kinds[i]] -= counts[i]
        members[kinds[i]] -= 1
        mass[1 + k], members[1 + k] = counts[i], 1
    vocab = Vocabulary(int(counts.sum()), len(words), words, counts, words[top], mass, members)
    weights = rng.standard_normal((TABLES, ROWS, CLASSES)).astype(np.float32)
    own = vocab.classes(words, kinds)
    assert len(set(own[top].tolist())) == len(top)
    context = np.repeat(rng.integers(0, ROWS, (TABLES, 1)), CLASSES, 1)
    by_class = np.exp(class_log_probabilities(weights, vocab.bias(), context, np.arange(CLASSES)).astype(float))
    inside = 10.0 ** (np.where(own > SINGLE, np.log10(counts + 0.5), 0) - vocab.log_members()[own])
    unknown = 0.5 / 10.0 ** vocab.log_members()[SINGLE + 1:]
    total = (by_class[own] * inside).sum() + (by_class[SINGLE + 1:] * unknown).sum()
    used = set(own.tolist()) | set(range(SINGLE + 1, CLASSES))
    assert total == pytest.approx(by_class[sorted(used)].sum(), rel=1e-6)


def test_held_out_texts_are_likelier_than_by_word_shares(spark):
    rows = QUERIES["op3_hashed_maxent"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and held
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = {d: rest for d, *rest in plain_base([tuple(r) for r in docs])}
    for r in rows:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_order_of_words_matters(spark):
    rng = np.random.default_rng(4)
    lines = [" ".join(f"{'ab'[k % 2]}{rng.integers(0, 4)}" for k in range(40)) for _ in range(400)]
    rows = list(enumerate(lines)) + [(1000 + i, " ".join(sorted(t.split()))) for i, t in enumerate(lines[:50])]
    got = {r.doc_id: r for r in score_documents(frame(spark, [r for r in rows if r[0] < 1000 or not learned(r[0])])).collect()}
    for i in range(50):
        if 1000 + i in got:
            assert got[1000 + i].base_score == pytest.approx(got[i].base_score)
            assert got[1000 + i].score < got[i].score


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(50) if not learned(i))
    r, = score_documents(frame(spark, [(held, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, pytest.approx(0.0))
    assert math.isfinite(r.score)
    assert score_documents(frame(spark, [])).count() == 0


def test_every_token_of_a_batch_moves_its_row():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 40, (TABLES, 500))
    rows[0, :300] = 7
    kinds = rng.integers(0, CLASSES, 500)
    bias = rng.standard_normal(CLASSES).astype(np.float32)
    start = rng.standard_normal((TABLES, ROWS, CLASSES)).astype(np.float32)
    logits = sum(start[k][rows[k]] for k in range(TABLES)).astype(float) + bias
    gradient = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    gradient[np.arange(500), kinds] -= 1
    moved, seen = [], np.zeros((TABLES, ROWS), np.float32)
    for order in (np.arange(500), rng.permutation(500)):
        weights, seen = start.copy(), np.zeros((TABLES, ROWS), np.float32)
        descend(weights, seen, bias, rows[:, order], kinds[order])
        moved.append(weights)
    # The order of a batch's tokens is of no account, and each row moves by the sum of its gradients.
    np.testing.assert_allclose(moved[0], moved[1], atol=1e-4)
    for k in range(TABLES):
        total = np.zeros((ROWS, CLASSES))
        np.add.at(total, rows[k], gradient)
        size = (total * total).sum(1) / CLASSES
        np.testing.assert_allclose(seen[k], size, rtol=1e-3, atol=1e-5)
        want = start[k] - lm.STEP * total / np.sqrt(size + 1e-6)[:, None]
        np.testing.assert_allclose(moved[0][k], want, atol=2e-3)
