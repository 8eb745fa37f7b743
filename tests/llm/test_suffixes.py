import hashlib
import random
import zlib

import numpy as np
import pytest

from tabsift.llm import suffixes
from tabsift.llm.suffixes import LENGTH, Family, remove_repeats, stretches


def plain(rows):
    """Every string of 100 bytes in a dictionary, in the order of documents."""
    rows = sorted(((d is not None, d or 0, zlib.crc32((t or "").encode()), d, (t or "").encode()) for d, t in rows),
                  key=lambda r: r[:3])
    seen, out = set(), []
    for *_, doc_id, data in rows:
        gone = bytearray(len(data))
        for i in range(len(data) - LENGTH + 1):
            part = data[i:i + LENGTH]
            if part in seen:
                gone[i:i + LENGTH] = b"\x01" * LENGTH
            seen.add(part)
        rest = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not before for before, g in zip(b"\x00" + gone, gone))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest))
    return sorted(out, key=str)


def frame(spark, rows, parts=5):
    return spark.createDataFrame(
        [(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, pack int, data string, n int").repartition(parts)


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"]))
                   for r in df.collect()), key=str)


def corpus(seed=1):
    r = random.Random(seed)
    letters = "abcdefghijklmnop é日"

    def text(n):
        return "".join(r.choices(letters, k=n))

    shared = [text(n) for n in (99, 100, 101, 180, 400)]
    rows = []
    for i in range(120):
        parts = [text(r.randint(0, 150))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, 60)
            parts += [s if r.random() < 0.6 else s[a:a + 130], text(r.randint(0, 40))]
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # a group of copies
    rows += [(300 + i, shared[4] + text(30)) for i in range(40)]  # one passage, different endings
    rows += [(None, rows[5][1]), (7, rows[7][1]), (7, rows[7][1]), (7, rows[9][1] + "z"), (-5, rows[11][1])]
    rows += [(400, None), (401, ""), (402, "x" * 99), (403, "y" * 1000), (404, "ab" * 300), (405, "y" * 150)]
    rows += [(406, "\x00" * 120 + "q"), (407, "p" + "\x00" * 130), (408, shared[3] + text(5) + shared[3])]
    return rows


@pytest.mark.parametrize("batches, crowd", [(1, 1 << 14), (4, 1 << 14), (7, 1 << 14), (3, 10)])
def test_repeats_against_brute_force(spark, batches, crowd):
    rows = corpus(batches)
    assert got(remove_repeats(frame(spark, rows), batches=batches, crowd=crowd)) == plain(rows)


def test_small_packs_flushes_and_buckets(spark, monkeypatch):
    for name, value in (("PACK", 300), ("FLUSH", 2000), ("BUCKET", 40), ("SUFFIXES", 200), ("SHARE", 50), ("NOTED", 2)):
        monkeypatch.setattr(suffixes, name, value)
    rows = corpus(9)
    assert got(remove_repeats(frame(spark, rows, 3), batches=5, crowd=20)) == plain(rows)


def test_stretches_cover_each_window_once(monkeypatch):
    monkeypatch.setattr(suffixes, "PACK", 500)
    r = np.random.default_rng(2)
    texts = [bytes(r.integers(97, 100, n, dtype=np.uint8)) for n in (0, 99, 100, 101, 350, 2000, 640)] + [b"a" * 700]
    seen, anchors = set(), {}
    for found in stretches(texts):
        for doc, start, windows, anchor, _ in found.tolist():
            assert windows <= LENGTH
            for at in range(start, start + windows):
                assert (doc, at) not in seen
                seen.add((doc, at))
                # Equal windows have equal anchors.
                assert anchors.setdefault(texts[doc][at:at + LENGTH], anchor) == anchor
    assert seen == {(i, at) for i, t in enumerate(texts) for at in range(len(t) - LENGTH + 1)}


def test_levels_merge_when_their_sizes_are_equal(spark):
    class Counted(Family):
        pass

    empty = spark.createDataFrame([], "bucket int, n long, data binary")
    family, sizes = Counted(), []
    for _ in range(6):
        family.add(empty)
        sizes.append([s for s, _ in family.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1]]


def test_empty_table(spark):
    df = frame(spark, corpus()).limit(0)
    assert remove_repeats(df).count() == 0
    assert remove_repeats(df, texts=False).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
