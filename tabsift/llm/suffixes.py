"""Removal of long byte strings that occurred before, by a family of suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.llm.common import mixed, texts_of, written
from tabsift.operators.joins import keyed_join

#: Bytes of a string that may not repeat, and of the anchor that each of them holds.
LENGTH, ANCHOR = 100, 32
#: Bytes of documents kept together, and hashed at once.
PACK = 1 << 20
#: Bytes of documents whose equal stretches are told apart in a task before they are sent.
FLUSH = 32 << 20
#: Stretches, and suffixes, of a bucket; what a task holds follows from them.
BUCKET, SUFFIXES = 1 << 19, 1 << 17
#: Batches that enter the index family one after the other.
BATCHES = 4
#: Anchors with more different stretches than ``CROWD`` are compared by window; those with more than
#: ``1 / SHARE`` of all stretches do not meet in a task before either.
CROWD, SHARE = 1 << 14, 1 << 19
#: Fewer stretches of one anchor in a flush are not reported for that.
NOTED = 4

_rng = np.random.default_rng(20240521)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_BITS = np.uint64(21)  # of a place in a pack with its overlap
_PLACE = (np.uint64(1) << _BITS) - np.uint64(1)
_powers: list[np.ndarray] = []


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the step and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        rows = []
        for base in (_STEP, pow(_STEP, -1, 2**64)):
            row = np.full(max(n, PACK + 2 * LENGTH), base, np.uint64)
            row[0] = 1
            rows.append(np.cumprod(row))
        _powers[:] = rows
    return _powers[0][:n], _powers[1][:n]


# ---- arrays as bytes ----------------------------------------------------------------------------

def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, compressed; ``_unpacked`` needs their types again."""
    head = np.array([a.nbytes for a in arrays], np.int64)
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.int64(len(body)).tobytes() + head.tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(data: bytes, *dtypes: str) -> list[np.ndarray]:
    size = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, len(dtypes), 8)
    body = pa.decompress(memoryview(data)[8 + 8 * len(dtypes):], size, codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    for n, dtype in zip(head.tolist(), dtypes):
        out.append(np.frombuffer(body, dtype, n // np.dtype(dtype).itemsize, at))
        at += n
    return out


def _changes(a: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it; the first does."""
    out = np.ones(len(a), bool)
    out[1:] = a[1:] != a[:-1]
    return out


# ---- documents and their stretches --------------------------------------------------------------

_FOUND = np.dtype([("doc", "<i4"), ("start", "<i4"), ("windows", "u1"), ("anchor", "<u8"), ("whole", "<u8")])


def stretches(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The windows of ``LENGTH`` bytes of all texts, as stretches with one anchor each.

    A window's anchor is the leftmost of its ``ANCHOR``-byte strings of least hash, so equal windows
    have it at the same place. Neighbouring windows with the same anchor are one stretch: its first
    start, the number of windows, and hashes of the anchor and of all bytes about it.
    """
    docs, starts, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PACK) if len(text) >= LENGTH else ():
            part = text[at:at + PACK + LENGTH - 1]
            if size and size + len(part) > PACK + LENGTH:
                yield _hashed(docs, starts, parts)
                docs, starts, parts, size = [], [], [], 0
            docs.append(i)
            starts.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield _hashed(docs, starts, parts)


def _hashed(docs: list[int], starts: list[int], parts: list[bytes]) -> np.ndarray:
    c = np.frombuffer(b"".join(parts), np.uint8)
    n = len(c)
    up, down = _steps(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[c] * up, out=sums[1:])
    grams = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * down[:n - ANCHOR + 1])
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    have, want = 1, LENGTH - ANCHOR + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & _PLACE).astype(np.int64)
    sizes = np.array([len(p) for p in parts])
    base = np.cumsum(sizes) - sizes
    inside = np.zeros(len(anchor) + 2, np.int8)
    # The last LENGTH - 1 bytes of a document start no window.
    np.add.at(inside, base, 1)
    np.add.at(inside, np.minimum(base + sizes - LENGTH + 1, len(anchor) + 1), -1)
    inside = np.cumsum(inside)[:len(anchor)].astype(bool)
    new = _changes(anchor)
    new[1:] |= ~inside[:-1]
    first = np.flatnonzero(new & inside)
    ends = np.ones(len(anchor), bool)
    ends[:-1] = new[1:] | ~inside[1:]
    last = np.flatnonzero(ends & inside)
    at = anchor[first]
    with np.errstate(over="ignore"):
        shape = ((at - first) * 128 + (last - first)).astype(np.uint64) * np.uint64(_STEP)
        whole = mixed((sums[last + LENGTH] - sums[first]) * down[first] + shape)
    out = np.zeros(len(first), _FOUND)
    own = np.searchsorted(base, first, "right") - 1
    out["doc"] = np.array(docs)[own]
    out["start"] = first - base[own] + np.array(starts)[own]
    out["windows"] = last - first + 1
    out["anchor"], out["whole"] = grams[at], whole
    return out


class _Docs:
    """Documents of a flush: their pack and place in it, and what orders them."""

    def __init__(self, pack, place, doc_id, known, crc):
        self.pack, self.place, self.doc_id, self.known, self.crc = pack, place, doc_id, known, crc

    def rank(self) -> np.ndarray:
        """Rows of one id in the order of their checksums, then as they were read; null ids first."""
        order = np.lexsort((self.place, self.pack, self.crc, self.doc_id, self.known))
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order))
        return out

    def take(self, at) -> "_Docs":
        return _Docs(self.pack[at], self.place[at], self.doc_id[at], self.known[at], self.crc[at])

    TYPES = ("<i8", "<i4", "<i8", "u1", "<u4")

    def arrays(self):
        """Differences of neighbours compress well."""
        return (np.diff(self.pack, prepend=0), np.diff(self.place, prepend=0).astype(np.int32),
                np.diff(self.doc_id, prepend=0), self.known.astype(np.uint8), self.crc.astype(np.uint32))

    @classmethod
    def of(cls, pack, place, doc_id, known, crc):
        return cls(np.cumsum(pack), np.cumsum(place, dtype=np.int64), np.cumsum(doc_id), known, crc)

    @classmethod
    def joined(cls, parts: list["_Docs"]) -> "_Docs":
        return cls(*[np.concatenate([getattr(p, c) for p in parts]) for c in ("pack", "place", "doc_id", "known", "crc")])


_PACKS = "pack long, n int, ids binary, text binary, total long, noted binary"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of neighbouring documents, and for each flush the anchors with several stretches."""
    schema = pa.schema([("pack", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("text", pa.binary()),
                        ("total", pa.int64()), ("noted", pa.binary())])
    base, number = TaskContext.get().partitionId() << 32, 0
    rows, size, flush, held = [], 0, [], 0

    def pack():
        nonlocal number
        data = b"".join(t for t, *_ in rows)
        row = {"pack": base + number, "n": len(rows), "text": np.int64(len(data)).tobytes() + pa.compress(
            data, codec="zstd", asbytes=True), "ids": _packed(
                np.array([len(t) for t, *_ in rows], np.int64), np.array([i or 0 for _, i, _ in rows], np.int64),
                np.array([i is not None for _, i, _ in rows], np.uint8), np.array([c for *_, c in rows], np.uint32))}
        number += 1
        return pa.RecordBatch.from_pylist([row], schema)

    def noted():
        found = np.concatenate(list(stretches(flush)) or [np.zeros(0, _FOUND)])
        some = found[np.lexsort((found["whole"], found["anchor"]))]
        some = some[_changes(some["anchor"]) | _changes(some["whole"])]
        anchors, n = np.unique(some["anchor"], return_counts=True)
        many = n >= NOTED
        return pa.RecordBatch.from_pylist(
            [{"total": len(some), "noted": _packed(anchors[many], n[many])}], schema)

    for batch in batches:
        ids, crcs = batch.column("doc_id").to_pylist(), batch.column("crc").to_pylist()
        for text, doc_id, crc in zip(texts_of(batch, "text"), ids, crcs):
            data = text.encode()
            if rows and size + len(data) > PACK:
                yield pack()
                rows, size = [], 0
            rows.append((data, doc_id, crc))
            size += len(data)
            flush.append(data)
            held += len(data)
            if held >= FLUSH:
                yield noted()
                flush, held = [], 0
    if rows:
        yield pack()
    if flush:
        yield noted()


def _opened(row: dict) -> tuple[list[bytes], _Docs]:
    """The texts of a pack and their keys."""
    sizes, ids, known, crc = _unpacked(row["ids"], "<i8", "<i8", "u1", "<u4")
    size = int(np.frombuffer(row["text"], np.int64, 1)[0])
    data = pa.decompress(memoryview(row["text"])[8:], size, codec="zstd", asbytes=True) if size else b""
    ends = np.cumsum(sizes).tolist()
    texts = [data[e - n:e] for e, n in zip(ends, sizes.tolist())]
    n = len(sizes)
    return texts, _Docs(np.full(n, row["pack"], np.int64), np.arange(n), ids, known, crc)


# ---- which stretches meet others ----------------------------------------------------------------

_SENT = "bucket int, kind int, pack long, n long, data binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("pack", pa.int64()), ("n", pa.int64()),
                         ("data", pa.binary())])
# Kinds of rows: windows to remove, stretches to compare, those of crowded anchors, stretches of a bucket.
_REMOVE, _COMPARE, _CROWDED, _STRETCHES = range(4)
_ENTRY = ("<i4", "<i4", "u1", "<u4", "<u8")


def _by_pack(docs: _Docs, doc: np.ndarray, kind: int, bucket: int, *columns: np.ndarray) -> list[dict]:
    """Rows of the given kind, one per pack: places of documents, then the columns."""
    order = np.lexsort((docs.place[doc], docs.pack[doc]))
    pack, place = docs.pack[doc][order], docs.place[doc][order].astype(np.int32)
    columns = [c[order] for c in columns]
    edges = np.append(np.flatnonzero(_changes(pack)), len(pack))
    return [{"bucket": bucket, "kind": kind, "pack": int(pack[a]), "n": int(columns[1][a:b].sum()),
             "data": _packed(place[a:b], *[c[a:b] for c in columns])} for a, b in zip(edges[:-1], edges[1:])]


_PLACED = ("<i4", "<i4", "u1")


def _sent(buckets: int, crowded: np.ndarray):
    """The different stretches of each flush by bucket of their anchors.

    All but the first of equal stretches are to be removed whatever else there is: only that one
    travels on. ``crowded`` anchors send windows instead.
    """
    def out_of(texts: list[bytes], docs: _Docs, turn: int) -> pa.RecordBatch:
        found = np.concatenate(list(stretches(texts)) or [np.zeros(0, _FOUND)])
        found = found[np.lexsort((found["start"], docs.rank()[found["doc"]], found["whole"], found["anchor"]))]
        first = _changes(found["anchor"]) | _changes(found["whole"])
        again, found = found[~first], found[first]
        rows = _by_pack(docs, again["doc"], _REMOVE, turn % buckets, again["start"], again["windows"])
        apart = np.isin(found["anchor"], crowded)
        far = found[apart]
        rows += _by_pack(docs, far["doc"], _CROWDED, turn % buckets, far["start"], far["windows"], _low(far["anchor"]))
        found = found[~apart]
        of = ((found["anchor"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        found = found[np.lexsort((found["start"], found["doc"], of))]
        of = np.sort(of)
        edges = np.searchsorted(of, np.arange(buckets + 1))
        for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if i == j:
                continue
            part = found[i:j]
            own, doc = np.unique(part["doc"], return_inverse=True)
            rows.append({"bucket": b, "kind": _STRETCHES, "n": j - i, "data": _packed(
                *docs.take(own).arrays(), np.diff(doc, prepend=0).astype(np.int32), part["start"], part["windows"],
                _low(part["anchor"]), part["whole"])})
        return pa.RecordBatch.from_pylist(rows, _SENT_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, docs, held, turn = [], [], 0, TaskContext.get().partitionId()
        for batch in batches:
            for row in batch.to_pylist():
                own, keys = _opened(row)
                texts += own
                docs.append(keys)
                held += sum(map(len, own))
                if held >= FLUSH:
                    yield out_of(texts, _Docs.joined(docs), turn)
                    texts, docs, held, turn = [], [], 0, turn + 1
        if texts:
            yield out_of(texts, _Docs.joined(docs), turn)

    return run


def _low(anchor: np.ndarray) -> np.ndarray:
    return (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _counted(n: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each of the given lengths."""
    n = n.astype(np.int64)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _settles(crowd: int):
    """A bucket's stretches: copies are to be removed, different ones of one anchor to be compared."""
    def run(group: pa.Table) -> pa.Table:
        rows = [r for r in group.to_pylist() if r["kind"] != _STRETCHES]
        docs, doc, start, windows, anchor, whole, base = [], [], [], [], [], [], 0
        for data in group.filter(pc.equal(group["kind"], _STRETCHES))["data"].to_pylist():
            *keys, d, s, w, a, g = _unpacked(data, *_Docs.TYPES, *_ENTRY)
            docs.append(_Docs.of(*keys))
            doc.append(np.cumsum(d, dtype=np.int64) + base)
            base += len(keys[0])
            for into, values in zip((start, windows, anchor, whole), (s, w, a, g)):
                into.append(values)
        if docs:
            bucket = group["bucket"][0].as_py()
            docs = _Docs.joined(docs)
            doc, start, windows, anchor, whole = map(np.concatenate, (doc, start, windows, anchor, whole))
            order = np.lexsort((start, docs.rank()[doc], whole, anchor))
            doc, start, windows, anchor, whole = (x[order] for x in (doc, start, windows, anchor, whole))
            new = _changes(anchor)
            first = new | _changes(whole)
            kinds = np.bincount(np.cumsum(new) - 1, weights=first)
            kinds = kinds[np.cumsum(new) - 1]
            rows += _by_pack(docs, doc[~first], _REMOVE, bucket, start[~first], windows[~first])
            for kind, some in ((_COMPARE, (kinds > 1) & (kinds <= crowd)), (_CROWDED, kinds > crowd)):
                some &= first
                rows += _by_pack(docs, doc[some], kind, bucket, start[some], windows[some], anchor[some])
        return pa.Table.from_pylist(rows, _SENT_ARROW)

    return run


# ---- the index family ---------------------------------------------------------------------------

_LEVEL = "bucket int, kind int, pack long, n long, data binary"
_INDEX, _NEW = 4, 5
_STRETCH = ("<i4", "<i4", "u1", "u1")


def _cut(buckets: int, edges: np.ndarray):
    """The bytes of the stretches to compare, by batch and bucket; digests of crowded windows."""
    schema = pa.schema([("kind", pa.int32()), ("batch", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()),
                        ("data", pa.binary())])

    def listed(found: list[dict], kind: int) -> list[np.ndarray]:
        parts = [_unpacked(f["data"], *_PLACED, "<u4") for f in found if f["kind"] == kind]
        return [np.concatenate(p) for p in zip(*parts)]

    def stretch_rows(texts, docs, place, start, windows, anchor) -> Iterator[dict]:
        turn = np.where(docs.known[place] > 0, np.searchsorted(edges, docs.doc_id[place], "right"), 0)
        of = (anchor % np.uint32(buckets)).astype(np.int64)
        order = np.lexsort((start, place, of, turn))
        place, start, windows, of, turn = (x[order] for x in (place, start, windows, of, turn))
        bounds = np.append(np.flatnonzero(_changes(turn * buckets + of)), len(of))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own, doc = np.unique(place[a:b], return_inverse=True)
            text = b"".join(texts[p][s:s + w + LENGTH - 1] for p, s, w in zip(
                place[a:b].tolist(), start[a:b].tolist(), windows[a:b].tolist()))
            yield {"kind": _NEW, "batch": int(turn[a]), "bucket": int(of[a]), "n": int(windows[a:b].sum()),
                   "data": _packed(*docs.take(own).arrays(), doc.astype(np.int32), start[a:b], windows[a:b],
                                   np.frombuffer(text, np.uint8))}

    def window_row(texts, docs, place, start, windows, anchor) -> dict:
        at = np.repeat(start, windows) + _counted(windows)
        place = np.repeat(place, windows)
        digests = [hashlib.blake2b(texts[p][i:i + LENGTH], digest_size=16).digest()
                   for p, i in zip(place.tolist(), at.tolist())]
        return {"kind": _CROWDED, "n": len(at), "data": _packed(
            *docs.take(place).arrays(), at.astype(np.int32), np.frombuffer(b"".join(digests), "<i8"))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts, docs = _opened(row)
                rows = []
                if near := listed(row["found"], _COMPARE):
                    rows += stretch_rows(texts, docs, *near)
                if far := listed(row["found"], _CROWDED):
                    rows.append(window_row(texts, docs, *far))
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _suffixes(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first ``LENGTH`` bytes of the suffixes that start at the given places, as comparable keys."""
    if not len(at):
        return np.zeros(0, f"V{LENGTH}")
    windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    return np.ascontiguousarray(windows[at]).view(f"V{LENGTH}").ravel()


def _held(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which of the new keys are among the old ones: both are sorted and merged in one scan."""
    both = np.concatenate([old, new])
    order = np.argsort(both, kind="stable")
    equal = both[order[1:]] == both[order[:-1]]
    out = np.zeros(len(both), bool)
    out[order[1:]] = equal
    return out[len(old):]


def _indexed(text: np.ndarray, at: np.ndarray) -> bytes:
    """A suffix array: the places of suffixes in their order, and the bytes they need."""
    ends = np.zeros(len(text) + 1, np.int64)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + LENGTH, -1)
    keep = np.cumsum(ends)[:-1] > 0
    return _packed((np.cumsum(keep) - 1)[at].astype(np.int32), text[keep])


def _scanned(group: pa.Table) -> pa.Table:
    """A bucket of a batch: its suffix array, scanned against those of all levels."""
    rows = group.to_pylist()
    levels = [_unpacked(r["data"], "<i4", "u1") for r in rows if r["kind"] == _INDEX]
    docs, doc, start, windows, texts, base = [], [], [], [], [], 0
    for r in rows:
        if r["kind"] == _NEW:
            *keys, d, s, w, t = _unpacked(r["data"], *_Docs.TYPES, *_STRETCH)
            docs.append(_Docs.of(*keys))
            doc.append(d.astype(np.int64) + base)
            base += len(keys[0])
            for into, values in zip((start, windows, texts), (s, w, t)):
                into.append(values)
    if not docs:
        return pa.Table.from_pylist([], _SENT_ARROW)
    docs = _Docs.joined(docs)
    doc, start, windows, text = map(np.concatenate, (doc, start, windows, texts))
    sizes = windows.astype(np.int64) + LENGTH - 1
    at = np.repeat(np.cumsum(sizes) - sizes, windows) + _counted(windows)
    begin = np.repeat(start, windows) + _counted(windows)
    doc = np.repeat(doc, windows)
    # Equal suffixes stay in the order of documents and places.
    order = np.lexsort((begin, docs.rank()[doc]))
    keys = _suffixes(text, at[order])
    sort = np.argsort(keys, kind="stable")
    order, keys = order[sort], keys[sort]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    novel = first.copy()
    for level in levels:
        held = np.zeros(len(keys), bool)
        held[first] = _held(_suffixes(level[1], level[0]), keys[first])
        novel &= ~held
    gone = order[~novel]
    # Neighbouring windows are one run again.
    gone = gone[np.lexsort((begin[gone], docs.place[doc[gone]], docs.pack[doc[gone]]))]
    new = _changes(docs.pack[doc[gone]]) | _changes(docs.place[doc[gone]])
    new[1:] |= begin[gone][1:] != begin[gone][:-1] + 1
    new |= _counted(np.diff(np.append(np.flatnonzero(new), len(gone)))) % 255 == 0
    runs = np.flatnonzero(new)
    bucket = rows[0]["bucket"]
    out = _by_pack(docs, doc[gone][runs], _REMOVE, bucket, begin[gone][runs].astype(np.int32),
                   np.diff(np.append(runs, len(gone))).astype(np.uint8))
    out.append({"bucket": bucket, "kind": _INDEX, "n": int(novel.sum()), "data": _indexed(text, at[order[novel]])})
    return pa.Table.from_pylist(out, _SENT_ARROW)


def _merged(group: pa.Table) -> pa.Table:
    """Two suffix arrays of a bucket as one."""
    parts = [_unpacked(d, "<i4", "u1") for d in group["data"].to_pylist()]
    base = np.cumsum([0] + [len(t) for _, t in parts])
    text = np.concatenate([t for _, t in parts])
    at = np.concatenate([a + b for (a, _), b in zip(parts, base)])
    # The arrays are sorted and share no suffix: a stable sort merges them.
    at = at[np.argsort(_suffixes(text, at), kind="stable")]
    return pa.Table.from_pylist(
        [{"bucket": group["bucket"][0].as_py(), "kind": _INDEX, "n": len(at), "data": _indexed(text, at)}], _SENT_ARROW)


class Family:
    """Suffix arrays of sizes 1, 2, 4, ... batches; each a table with a row per bucket.

    ``add`` scans a batch against every level, keeps what is new as a level of its own and merges
    levels of equal size, so a suffix is merged as often as the logarithm of the batches.
    """

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """The windows of the batch that came before, in it or in an earlier batch."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            merged = a.unionByName(b).groupBy("bucket").applyInArrow(_merged, _LEVEL)
            self.levels.append((2 * size, written(merged, "level", "zstd")))
        nothing = F.lit(None).cast("long").alias("pack")
        rows = batch.select("bucket", F.lit(_NEW).alias("kind"), nothing, "n", "data")
        for _, level in self.levels:
            rows = rows.unionByName(level)
        out = written(rows.groupBy("bucket").applyInArrow(_scanned, _LEVEL), "scanned", "zstd")
        self.levels.append((1, out.filter(F.col("kind") == _INDEX)))
        return out.filter(F.col("kind") == _REMOVE)


# ---- the whole ----------------------------------------------------------------------------------

def remove_repeats(
    docs: DataFrame, batches: int = BATCHES, crowd: int = CROWD, texts: bool = True
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``: what is left of every document.

    Every byte that a string of ``LENGTH`` bytes covers goes if the string also starts earlier: in a
    document of smaller id, or before in the same one. All strings are judged on the texts as given.

    Each window of ``LENGTH`` bytes belongs to one stretch about an anchor, which equal windows
    share. Of equal stretches all but the first are removed; where an anchor has different
    stretches, the first of each enters the index family: batches of documents by ascending id get
    suffix arrays by bucket of anchors, which are scanned against the arrays of earlier batches.
    Flushes send equal stretches once, so a passage that a third of all documents share is one row
    per flush. Where more than ``crowd`` stretches of one anchor differ, digests of its windows go on
    instead, and the first of each is found by a combining aggregate. Anchors with a share of all
    stretches are told beforehand and take that way at once; at most ``2 * SHARE`` can have it, which
    bounds their broadcast.

    Null texts count as empty. Null ids come before all others; rows of one id come in the order of
    their checksums, so a repeated row is removed as a copy of the first. Documents shorter than
    ``LENGTH`` bytes stay whole. An empty table gives an empty one; other columns are not read.
    ``kept`` is the rest as bytes, which may start or end inside a letter; ``texts=False`` leaves it out.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    stored = written(
        rows.withColumn("crc", F.crc32(F.col("text").cast("binary"))).mapInArrow(_stored, _PACKS), "packs", "none")
    packs = stored.filter("pack IS NOT NULL").select("pack", "n", "ids", "text")
    total = stored.agg(F.sum("total")).first()[0] or 0
    far = _crowded(stored, max(crowd, total // SHARE))
    sent = packs.mapInArrow(_sent(max(1, -(-total // BUCKET)), far), _SENT)
    settled = written(sent.groupBy("bucket").applyInArrow(_settles(crowd), _SENT), "settled", "none")
    gone = [settled.filter(F.col("kind") == _REMOVE)]
    size = {r["kind"]: r["n"] for r in settled.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    if size.get(_COMPARE) or size.get(_CROWDED):
        edges = []
        if batches > 1:
            cuts = [i / batches for i in range(1, batches)]
            ids = rows.select(F.col("doc_id").cast("double").alias("id"))
            edges = sorted({min(int(e), 2**63 - 1) for e in ids.approxQuantile("id", cuts, 1 / (8 * batches))})
        found = settled.filter(F.col("kind").isin(_COMPARE, _CROWDED)).groupBy(F.col("pack").alias("_p")).agg(
            F.collect_list(F.struct("kind", "data")).alias("found"))
        parts = written(
            packs.join(found, packs["pack"] == found["_p"]).mapInArrow(
                _cut(max(1, -(-size.get(_COMPARE, 0) // SUFFIXES)), np.array(edges, np.int64)),
                "kind int, batch int, bucket int, n long, data binary"),
            "parts", "none")
        family = Family()
        for i in range(len(edges) + 1):
            gone.append(family.add(parts.filter((F.col("kind") == _NEW) & (F.col("batch") == i))))
        if size.get(_CROWDED):
            gone.append(_first_of_crowded(parts.filter(F.col("kind") == _CROWDED)))
    every = reduce(DataFrame.unionByName, [g.select(F.col("pack").alias("_p"), "data") for g in gone])
    every = every.groupBy("_p").agg(F.collect_list("data").alias("gone"))
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return packs.join(every, packs["pack"] == every["_p"], "left").mapInArrow(
        _left(texts), kind + ", kept binary" * texts)


def _crowded(stored: DataFrame, most: int) -> np.ndarray:
    """Anchors about which so many stretches differ that one task should not hold them."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("noted").to_pylist():
                anchors, n = _unpacked(data, "<u8", "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    noted = stored.filter("noted IS NOT NULL").select("noted").mapInArrow(listed, "anchor long, n long")
    # Flushes keep few of an anchor to themselves, so half the limit finds all that exceed it.
    rows = noted.groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") > most / 2).select("anchor").collect()
    return np.array([r[0] for r in rows], np.int64).view(np.uint64)


def _first_of_crowded(rows: DataFrame) -> DataFrame:
    """Windows of crowded anchors but the first of each."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                *keys, at, hashes = _unpacked(data, *_Docs.TYPES, "<i4", "<i8")
                docs = _Docs.of(*keys)
                hashes = hashes.reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), pa.array(docs.doc_id, mask=docs.known == 0),
                     pa.array(docs.crc.astype(np.int64)), pa.array(docs.pack), pa.array(docs.place.astype(np.int64)),
                     pa.array(at.astype(np.int64))], names=["h1", "h2", "doc_id", "crc", "pack", "place", "start"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pack, place, start = (batch.column(c).to_numpy() for c in ("pack", "place", "start"))
            edges = np.append(np.flatnonzero(_changes(pack)), len(pack))
            yield pa.RecordBatch.from_pylist(
                [{"pack": int(pack[a]), "data": _packed(
                    place[a:b].astype(np.int32), start[a:b].astype(np.int32), np.ones(b - a, np.uint8))}
                 for a, b in zip(edges[:-1], edges[1:])],
                pa.schema([("pack", pa.int64()), ("data", pa.binary())]))

    kind = "h1 long, h2 long, doc_id long, crc long, pack long, place long, start long"
    windows = rows.select("data").mapInArrow(listed, kind)
    place = F.struct("doc_id", "crc", "pack", "place", "start")
    first = windows.groupBy(F.col("h1").alias("_1"), F.col("h2").alias("_2")).agg(F.min(place).alias("_first"))
    again = keyed_join(windows, first, {"h1": "_1", "h2": "_2"}).filter(place != F.col("_first"))
    return again.select("pack", "place", "start").mapInArrow(packed, "pack long, data binary")


def _left(with_texts: bool):
    """Every document without the bytes its removed windows cover."""
    def of(row: dict) -> pa.RecordBatch:
        texts, docs = _opened(row)
        parts = [_unpacked(d, *_PLACED) for d in row["gone"] or ()]
        place, start, windows = (
            np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in range(3))
        order = np.lexsort((start, place))
        start, end = start[order], (start + windows)[order] + LENGTH - 1
        bounds = np.searchsorted(place[order], np.arange(len(texts) + 1)).tolist()
        sizes, n_spans, digests, rests = [], [], [], []
        for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
            spans = _spans(start[a:b], end[a:b])
            rest = _rest(text, spans)
            sizes.append(len(rest))
            n_spans.append(len(spans))
            digests.append(hashlib.sha256(rest).hexdigest())
            rests.append(rest)
        n_bytes = np.array([len(t) for t in texts], np.int64)
        columns = {"doc_id": pa.array(docs.doc_id, mask=docs.known == 0), "n_bytes": pa.array(n_bytes),
                   "n_removed": pa.array(n_bytes - np.array(sizes, np.int64)),
                   "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests)}
        if with_texts:
            columns["kept"] = pa.array(rests, pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield of(batch.slice(i, 1).to_pylist()[0])

    return run


def _spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Sorted ranges that overlap or touch as one."""
    if not len(start):
        return []
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return list(zip(start[at].tolist(), reach[np.append(at[1:], len(start)) - 1].tolist()))


def _rest(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join(parts) + text[at:]
