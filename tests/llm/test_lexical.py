import math
import random
import re

import pytest

from tabsift.llm import lexical
from tabsift.llm.lexical import search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(text):
    out = {}
    for t in TERM.findall((text or "").translate(LOWER)):
        out[t] = out.get(t, 0) + 1
    return out


def plain(docs, items, top=20):
    bags = [(d, bag(t)) for d, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    out = []
    for item_id, text in sorted(set(items), key=str):
        found = []
        for doc_id, b in bags:
            if not b:
                continue
            m = 75 + (25 * sum(b.values()) * n_docs) // total
            score = 0
            for t, q in bag(text).items():
                if t in b:
                    df = sum(t in other for _, other in bags)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += q * w * ((10**9 * b[t]) // (1000 * b[t] + 12 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (down, _, _, doc_id) in enumerate(sorted(found)[:top], 1):
            out.append((item_id, rank, doc_id, -down))
    return sorted(out, key=str)


def frames(spark, docs, items):
    # Columns that share names with the operator's own.
    return (
        spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs],
                              "doc_id long, text string, bag string, n int, item_id int"),
        spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int"))


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed=5):
    r = random.Random(seed)
    words = ["the", "The", "año", "x1", "foo_bar", "naïve", "日本", "tail", "rare", "of", "and"]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 30)))) for i in range(150)]
    docs += [(1000 + i, "the rare tail, of: x1") for i in range(60)]
    docs += [(None, "the rare tail, of: x1"), (5, "rare rare"), (5, "rare"), (7, None), (8, ""), (9, "\t")]
    items = [(1, "The RARE tail"), (2, "año naïve 日本 日本"), (3, None), (4, ""), (5, "absent"),
             (6, "the the the of"), (6, "the the the of"), (None, "rare x1")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [4 << 20, 50])
def test_search_against_brute_force(spark, block_bytes):
    docs, items = corpus()
    got = search(*frames(spark, docs, items), block_bytes=block_bytes)
    assert rows(got) == plain(docs, items)


def test_candidates_cut_while_scoring(spark, monkeypatch):
    monkeypatch.setattr(lexical, "KEPT", 30)
    monkeypatch.setattr(lexical, "CELLS", 60)
    docs, items = corpus(6)
    df, queries = frames(spark, docs, items)
    assert rows(search(df.coalesce(1), queries, top=3)) == plain(docs, items, 3)


def test_terms_of_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    text = "Añb cd-ef\n" * 50 + "x" * 100 + " Z\x00q"
    assert [t.decode() for part in terms(text) for t in part] == TERM.findall(text.translate(LOWER))


def test_empty_tables(spark):
    docs, items = frames(spark, *corpus())
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("coalesce(length(text), 0) < 2"), items)):
        got = search(a, b)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
