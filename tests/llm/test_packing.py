import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabsift.llm.bytebpe import encoder
from tabsift.llm.packing import best_fit, cut, lower_bound, pack_documents
from tabsift.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a" * 20000, " " * 30000, "é" * 9000, "<|endoftext|>x<|endoftext|>", " 　\x85\n\n \t b", "1²½Ⅷ ᾳǅ 😀\x00\x1c",
       "don't I'll we've", "\r\n" * 50 + "x", "ab " * 5000]


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_librarys(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    texts = ODD + [d.text for d in docs]
    encode = encoder(PATH)
    assert [encode(t).tolist() for t in texts] == library(texts)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(text):
    assert encoder(PATH)(text).tolist() == library([text])[0]


def test_other_vocabularies_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids
    assert encoder(path)("Hello there").tolist() == ids


def optimum(sizes, capacity):
    """The least number of bins, by trying all ways."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                rest = list(rooms)
                rest.remove(room)
                place(i + 1, rest + [room - sizes[i]])
        place(i + 1, rooms + [capacity - sizes[i]])

    place(0, [])
    return best


@given(st.lists(st.integers(1, 20), min_size=1, max_size=8), st.integers(20, 24))
@settings(max_examples=150, deadline=None)
def test_bound_and_best_fit_against_all_packings(sizes, capacity):
    sizes = np.array(sorted(sizes, reverse=True))
    bins, offsets, fills = best_fit(sizes, capacity)
    least = optimum(sizes.tolist(), capacity)
    assert lower_bound(sizes, capacity) <= least <= len(fills)
    held = collections.defaultdict(list)
    for b, o, s in zip(bins, offsets, sizes):
        held[b].append((o, s))
    for b, items in held.items():
        at = 0
        for o, s in sorted(items):
            assert o == at
            at += s
        assert at == fills[b] <= capacity


def test_bound_sees_more_than_the_sum():
    assert lower_bound(np.full(10, 600), 1024) == 10
    assert lower_bound(np.full(9, 400), 1024) == 5
    assert lower_bound(np.full(9, 300), 1024) == 3


@pytest.mark.parametrize("n", [1, 5, 1024, 1025, 2048, 5000])
def test_cut(n):
    ids = np.arange(n)
    parts = cut(ids, 1024)
    assert np.concatenate(parts).tolist() == ids.tolist()
    assert all(len(p) == 1024 for p in parts[1:]) and 1 <= len(parts[0]) <= 1024


def check(rows, docs, capacity):
    """Every piece right, every sequence gapless and within its capacity."""
    texts = collections.defaultdict(list)
    for (d, _), ids in zip(docs, library([t or "" for _, t in docs])):
        texts[d].append(np.array(ids + [2], "<u4"))
    want = collections.Counter()
    for d, many in texts.items():
        for ids in many:
            at = 0
            for k, part in enumerate(cut(ids, capacity)):
                want[d, k, at, len(part), zlib.crc32(part.tobytes())] += 1
                at += len(part)
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for items in held.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("part_rows", [20, 100, 50_000])
def test_packing(spark, part_rows):
    docs = [(i, "word " * (i * 7 % 90)) for i in range(150)]
    docs += [(None, "x"), (None, "x"), (5, "again"), (200, None), (201, "")] + [(300 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*d, 1, "p") for d in docs], "doc_id long, text string, bin int, part string")
    rows = pack_documents(df, capacity=64, part_rows=part_rows).collect()
    n = check(rows, docs, 64)
    sizes = np.array([r.length for r in rows])
    assert n <= lower_bound(sizes, 64) * 1.03 + 8
    assert n >= lower_bound(sizes, 64)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op2_certified_packing"](spark, sf).collect()
    n = check(rows, docs, 1024)
    assert n <= len(best_fit(np.array([r.length for r in rows]), 1024)[2]) + 4


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
