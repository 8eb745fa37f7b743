"""Whether files are JSON or XML documents, from summaries of their splits that merge in order.

A split is read where it lies. What it holds is reduced to what its neighbours have to match: closers
without an opener, then openers without a closer, with a bounded note between two of them. Joining two
summaries and reducing again is associative, so a file is the fold of its splits, whatever its size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents nested deeper than this count as malformed.
DEPTH = 100_000
BROKEN = "!"

# ---- JSON ---------------------------------------------------------------------------------------

_STRING = re.compile(r'"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*"')
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
_ODD = re.compile(r"[^\x01\x02\[\]{},:]")
_SIGNS = {1: "s", 2: "v", **dict.fromkeys(map(ord, " \t\r\n"))}
# s: a string, v: a scalar or a list of values, o: an object, T: a list of objects.
_OBJECT = re.compile(r"\{(?:s:[svoT](?:,s:[svoT])*)?\}")
_LIST = re.compile(r"\[((?:[svoT](?:,[svoT])*)?)\]")
_ITEMS = re.compile(r"(?:,[svoT]){2,}(?=[,\]])")
_FIRST_ITEMS = re.compile(r"\[(?:[svoT],){2,}")
_MEMBERS = re.compile(r"(?:,s:[svoT]){2,}(?=[,}])")
_FIRST_MEMBERS = re.compile(r"\{(?:s:[svoT],){2,}")
# Neighbours that no document has, whatever comes before or after.
_NEVER = re.compile(
    r"[svoT\]}][svoT\[{]|[,:\[{][,:]|[,:][\]}]|\[\}|\{\]|[voT\]}]:|:[svoT]:|,[svoT],s:|:[svoT],[svoT][,\]]")
_SHAPES = {"o": "object", "T": "table", "v": "list"}


def json_summary(text: str) -> str:
    """The signs of a stretch of whole lines, reduced; ``BROKEN`` if no JSON can hold it."""
    if "\x01" in text or "\x02" in text:
        return BROKEN
    signs = _SCALAR.sub("\x02", _STRING.sub("\x01", text))
    bare = signs.translate({9: None, 10: None, 13: None, 32: None})
    if _ODD.search(bare):
        return BROKEN
    return _reduced(bare.translate(_SIGNS))


def _reduced(signs: str) -> str:
    while True:
        fewer = _LIST.sub(lambda m: "v" if set(m[1]) - {"o", ","} else "T", _OBJECT.sub("o", signs))
        if fewer == signs:
            break
        signs = fewer
    signs = _ITEMS.sub(lambda m: ",o" if set(m[0]) == {",", "o"} else ",v", signs)
    signs = _FIRST_ITEMS.sub(lambda m: "[o," if set(m[0]) == {"[", ",", "o"} else "[v,", signs)
    signs = _FIRST_MEMBERS.sub("{s:v,", _MEMBERS.sub(",s:v", signs))
    return BROKEN if _NEVER.search(signs) or len(signs) > 8 * DEPTH else signs


def json_joined(a: str, b: str) -> str:
    return BROKEN if BROKEN in (a, b) else _reduced(a + b)


class _Json:
    def __init__(self):
        self.signs = ""

    def add(self, text: str) -> None:
        self.signs = json_joined(self.signs, json_summary(text)) if self.signs != BROKEN else BROKEN

    def summary(self) -> str:
        return self.signs


def json_shape(summaries: list[str]) -> str:
    """``object``, ``table`` (a list of objects), ``list``, or ``none``."""
    signs = ""
    for s in summaries:
        signs = json_joined(signs, s)
    return _SHAPES.get(signs, "none")


# ---- XML ----------------------------------------------------------------------------------------

# Whatever begins and does not end is the last alternative, up to the end.
_MARKUP = re.compile(
    r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?[A-Za-z_:][\w:.\-]*(?:\s.*?)?\?>|<!DOCTYPE(?:[^>\[]|\[.*?\]\s*)*>"
    r"""|<(/?)([A-Za-z_:][\w:.\-]*)((?:\s+[A-Za-z_:][\w:.\-]*\s*=\s*(?:"[^"<]*"|'[^'<]*'))*)\s*(/?)>|<.*""", re.S)
#: What may be open where a split begins, and what ends it.
_OPEN = {"comment": "-->", "cdata": "]]>", "note": "?>", "decl": ">"}
_STARTS = {"<!--": "comment", "<![CDATA[": "cdata", "<?": "note", "<!DOCTYPE": "decl"}
_TAG_END = {
    "tag": re.compile(r"""(?:[^<>"']|"[^"<]*"|'[^'<]*')*?(/?)>"""),
    "double": re.compile(r"""[^"<]*"(?:[^<>"']|"[^"<]*"|'[^'<]*')*?(/?)>"""),
    "single": re.compile(r"""[^'<]*'(?:[^<>"']|"[^"<]*"|'[^'<]*')*?(/?)>"""),
}
_TAG_START = re.compile(r"<(/?)([A-Za-z_:][\w:.\-]*)")
# A tag whose end was passed over: that of an unfinished one lies outside quotes nowhere.
_TAG_BROKEN = re.compile(r"""<(?:[^<>"']|"[^"<]*"|'[^'<]*')*>""")
MODES = ("text", *_OPEN, *_TAG_END)


class Nest:
    """Elements of a stretch: closers without opener, then openers without closer.

    After each, and before the first, a note of what lies there: 0 nothing, 1 one element, 2 more than
    one element, or text; below the root only that matters.
    """

    def __init__(self, closers=(), after_closers=(0,), openers=(), after_openers=(), broken=False):
        self.closers, self.after_closers = list(closers), list(after_closers)
        self.openers, self.after_openers = list(openers), list(after_openers)
        self.broken = broken

    def note(self, content: int) -> None:
        notes = self.after_openers if self.openers else self.after_closers
        notes[-1] = min(2, notes[-1] + content)

    def open(self, name: str) -> None:
        self.openers.append(name)
        self.after_openers.append(0)
        self.broken |= len(self.openers) > DEPTH

    def close(self, name: str) -> None:
        if self.openers:
            self.broken |= self.openers.pop() != name
            self.after_openers.pop()
            self.note(1)
        else:
            self.closers.append(name)
            self.after_closers.append(0)
            self.broken |= len(self.closers) > DEPTH

    def extend(self, other: "Nest") -> None:
        self.broken |= other.broken
        self.note(other.after_closers[0])
        for name, content in zip(other.closers, other.after_closers[1:]):
            self.close(name)
            self.note(content)
        for name, content in zip(other.openers, other.after_openers):
            self.open(name)
            self.note(content)

    def listed(self) -> list:
        if self.broken:
            return [[], [0], [], [], True]
        return [self.closers, self.after_closers, self.openers, self.after_openers, False]


def _quoted(tag: str) -> str:
    """The mode at the end of an open tag."""
    bare = re.sub(r""""[^"]*"|'[^']*'""", "", tag)
    quote = re.search("[\"']", bare)
    return {'"': "double", "'": "single"}[quote[0]] if quote else "tag"


class _Reading:
    """What a stretch holds, if it begins in a given mode."""

    def __init__(self, mode: str):
        self.mode, self.rest, self.nest = mode, "", Nest()
        #: Whether the tag open at the beginning closes itself; none was closed: null.
        self.ended: bool | None = None

    def add(self, text: str) -> None:
        at = 0
        if self.mode in _OPEN:
            end = text.find(_OPEN[self.mode])
            if end < 0:
                return
            at = end + len(_OPEN[self.mode])
        elif self.mode in _TAG_END:
            found = _TAG_END[self.mode].match(self.rest + text)
            if found is None:
                self.rest += text
                return
            text, self.rest = self.rest + text, ""
            at, self.ended = found.end(), bool(found[1])
            self.nest.note(1 if self.ended else 0)
        else:
            text, self.rest = self.rest + text, ""
        self.mode = "text"
        for m in _MARKUP.finditer(text, at):
            self._between(text[at:m.start()])
            at = m.end()
            kind = next((k for sign, k in _STARTS.items() if m[0].startswith(sign)), None)
            if m[2]:
                if m[1]:
                    self.nest.close(m[2])
                elif m[4]:
                    self.nest.note(1)
                else:
                    self.nest.open(m[2])
            elif kind is not None:
                if kind == "cdata":
                    self.nest.note(2)
                if m[0].find(_OPEN[kind], len(_OPEN[kind])) < 0:
                    self.mode = kind
            else:
                # A tag that goes on in the next lines, or none at all.
                self.rest = m[0]
                self.nest.broken |= (
                    "<" in m[0][1:] or not _TAG_START.match(m[0]) or _TAG_BROKEN.match(m[0]) is not None)
        self._between(text[at:])

    def _between(self, text: str) -> None:
        if text.strip():
            self.nest.note(2)

    def end(self) -> list:
        """The mode the stretch ends in; a tag that begins in it and is open there, with name and kind."""
        if self.mode in _TAG_END:
            return [_quoted({"double": '"', "single": "'"}.get(self.mode, "") + self.rest), "", False]
        tag = _TAG_START.match(self.rest) if self.mode == "text" else None
        if tag is None:
            return [self.mode, "", False]
        return [_quoted(self.rest), tag[2], bool(tag[1])]

    def summary(self) -> list:
        return [self.end(), self.ended, self.nest.listed()]


class _Xml:
    """Readings from every mode a split may begin in; those that meet in one mode go on as one."""

    def __init__(self, first: bool):
        self.readings = {mode: [_Reading(mode)] for mode in (MODES[:1] if first else MODES)}

    def add(self, text: str) -> None:
        # Two readings that have come to plain text differ in what they have read, not in what follows.
        shared: _Reading | None = None
        for parts in self.readings.values():
            last = parts[-1]
            if last.mode == "text" and not last.rest:
                if shared is None:
                    shared = _Reading("text")
                    shared.add(text)
                if last.nest is not shared.nest:
                    parts.append(shared)
                    self._joined(parts)
            else:
                last.add(text)

    @staticmethod
    def _joined(parts: list[_Reading]) -> None:
        a, b = parts
        a.nest.extend(b.nest)
        a.mode, a.rest = b.mode, b.rest
        parts.pop()

    def summary(self) -> str:
        return json.dumps({mode: parts[-1].summary() for mode, parts in self.readings.items()})


def xml_shape(summaries: list[str]) -> str:
    """``element`` where all tags of a file nest around one root, else ``none``."""
    nest, mode, name, closing = Nest(), "text", "", False
    for text in summaries:
        (end, ended, listed) = json.loads(text)[mode]
        if mode in _TAG_END and ended is None and end[0] in _TAG_END:
            mode = end[0]
            continue
        own = Nest(*listed)
        if mode in _TAG_END:
            if closing:
                nest.close(name)
            elif not ended:
                nest.open(name)
        nest.extend(own)
        mode, name, closing = end
    whole = not nest.broken and mode == "text" and not nest.openers and not nest.closers
    return "element" if whole and nest.after_closers == [1] else "none"


# ---- files --------------------------------------------------------------------------------------

def shapes(spark: SparkSession, paths, kind: str) -> DataFrame:
    """``path, shape`` of files that may be documents of a kind, ``json`` or ``xml``.

    One scan in splits; a row per split is shuffled, and what meets in a task is a file's rows. Not
    checked are the names of processing notes, and attributes of a tag that a split edge cuts.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    stretches = lines.mapInArrow(_summaries(kind), "path string, start long, summary string")
    files = stretches.groupBy("path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("start", "summary"))), lambda s: s["summary"]).alias("all"))
    return files.mapInArrow(_judged(json_shape if kind == "json" else xml_shape), "path string, shape string")


def _summaries(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stretch = None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([stretch.summary()])],
                names=["path", "start", "summary"])

        for batch in batches:
            keys = list(zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()))
            values = batch.column("value").to_pylist()
            edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                if keys[a] != key:
                    if stretch is not None:
                        yield row()
                    key = keys[a]
                    stretch = _Json() if kind == "json" else _Xml(key[1] == 0)
                    if key[1] == 0:
                        values[a] = values[a].removeprefix("﻿")
                stretch.add("\n".join(values[a:b]) + "\n")
        if stretch is not None:
            yield row()

    return run


def _judged(shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), pa.array([shape(s) for s in batch.column("all").to_pylist()], pa.string())],
                names=["path", "shape"])

    return run
