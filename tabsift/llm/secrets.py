"""Secret scans of texts and of everything that is encoded inside them."""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.llm.common import texts_of

#: The kinds of secrets, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex")
#: What masking puts in place of a payload that was left unopened.
UNOPENED = "unopened"
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_HINTS = ("passw", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+"
    r"|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A shorter word that stands alone: one before a colon or an equals sign, which may be its padding.
SHORT = re.compile(r"""(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{2,15}+(?==|["']?\x20*[:=])""")
PRINTABLE = re.compile(r"[\x20-\x7e]+")
#: A word that goes on in the next line, as in mails and keys.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
URLSAFE = str.maketrans("-_", "+/")
#: How compressed data begins: gzip, bzip2, xz, zlib.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
#: Text among other bytes: UTF-16 of either order, or UTF-8.
STRETCH = re.compile(
    rb"((?:[\t\n\r\x20-\x7e]\x00){8,})|((?:\x00[\t\n\r\x20-\x7e]){8,})"
    rb"|(?:[\t-\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
#: Compressed data within compressed data; what is deeper counts as unopened.
DEPTH = 100
#: Chains such as ``%252525...``: each level takes one link away, in the end the first character is left.
PERCENTS = re.compile(r"%(?:25){8,}(?=[0-9A-Fa-f]{2})")
CHAINS = re.compile(r"\\(?:u005[cC]){8,}(?=u[0-9A-Fa-f]{4})|\\(?:x5[cC]){8,}(?=x[0-9A-Fa-f]{2})|&(?:#38;){8,}(?=#)")
#: What no secret and no encoding can hold or cross, so that what lies between is decoded apart.
HARD = re.compile(r"[^A-Za-z0-9+/_.=:\-\"'%\\{}&#;\x20\t\r\n]|\n\r?\n")
#: Bytes that one payload of a document, with what is compressed inside it, may decompress to; what
#: goes beyond is reported, not opened.
MAX_DECODED = 64 << 20

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """``(start, rank of kind, end)`` of the secrets that stand in the text as they are."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    # Runs are maximal either way, so asking for 16 at once finds the same ones.
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A stretch of text, and where its parts stand in the layer it was decoded from.

    A part is ``start, skip, from, to, where``: from ``start`` on there are the characters from
    ``skip`` on of what ``[from, to)`` of the parent stands for. ``where`` maps a character to its
    range in there; None is the whole range, and ``_SAME`` the text as it is.
    """

    def __init__(self, parent: Layer | None = None, text: str = "") -> None:
        self.parent, self.text = parent, text
        self.texts: list[str] = []
        self.parts: list[tuple] = []
        self.size = self.grown = 0
        #: Digests of the payloads that were decompressed on the way here.
        self.opened: frozenset = parent.opened if parent else frozenset()

    def add(self, text: str, skip: int, start: int, end: int, where) -> None:
        if text:
            self.texts.append(text)
            self.parts.append((self.size, skip, start, end, where))
            self.size += len(text)

    def closed(self) -> Layer:
        self.text = "".join(self.texts)
        self.texts = []
        return self

    def _range(self, i: int) -> tuple[int, int]:
        at, skip, start, end, where = self.parts[bisect_right(self.parts, i, key=lambda p: p[0]) - 1]
        if where is None:
            return start, end
        i += skip - at
        if where is _SAME:
            return start + i, start + i + 1
        low, high = where(i)
        return start + low, start + high

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The range of the document that characters ``[a, b)`` come from; ranges never go back."""
        layer, last = self, b - 1
        while layer.parent is not None:
            a, last = layer._range(a)[0], layer._range(last)[1] - 1
            layer = layer.parent
        return a, last + 1


def _SAME(i: int) -> tuple[int, int]:
    return i, i + 1


class Budget:
    """What the payloads of a document have been decompressed to, each by where it stands."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.spent: dict[tuple[int, int], int] = {}
        self.known: set = set()
        self.left: dict[tuple, tuple[int, int]] = {}

    def refuse(self, place: tuple[int, int], mark: bytes) -> None:
        self.left[place, mark] = place


def scan(text: str, max_decoded: int = MAX_DECODED) -> tuple[list[Span], list[Span], int, int]:
    """Base spans, all spans, the number of layers, and the number of payloads left unopened.

    Layers are worked off one by one. Each gives more: the same text with its percent sequences,
    its character escapes, or its base64 words (and what is compressed inside them) replaced by
    what they stand for. A layer seen before is not opened again, which ends cycles, and neither is
    a compressed payload inside itself. Every layer is scanned whole, so a secret may be encoded in
    part, and its span is the range of the document that it was decoded from.

    A layer is as much of the text as one change can touch: the stretch around it up to a character
    that neither a secret nor an encoding can hold. Plain decodings are followed to the end, whatever
    the length of the document; ``max_decoded`` bounds decompression, per payload. A base64 word of
    under 16 letters is read where a key may stand or where it ends in padding; as a value its own
    letters count already. Glued to other letters it is not told from them, and texts of under 8
    characters (UTF-16) or 12 (UTF-8) among other bytes are taken for bytes.
    """
    base, every, layers, left = _scanned(text, max_decoded)
    return base, every, layers, len(left)


def _scanned(text: str, max_decoded: int) -> tuple[list[Span], list[Span], int, list[tuple[int, int]]]:
    """Like ``scan``, with the ranges of the payloads left unopened."""
    base = base_spans(text)
    found, layers, budget, seen = set(base), 1, Budget(max_decoded), set()
    todo = [_children(Layer(None, text), budget)]
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        if not layer.size:
            continue
        mark = (_digest(layer.text), layer.source(0, layer.size))
        if mark in seen:
            continue
        seen.add(mark)
        layers += 1
        for a, kind, b in base_spans(layer.text):
            start, end = layer.source(a, b)
            found.add((start, kind, end))
        todo.append(_children(layer, budget))
    return base, sorted(found), layers, list(budget.left.values())


def _children(layer: Layer, budget: Budget) -> Iterator[Layer]:
    """The changed stretches of a layer, decoding by decoding; they are cut as they are read."""
    for decode in (_percent, _escapes):
        yield from _stretches(layer, decode(layer, budget), budget)
    for words, wrapped in ((BASE64, False), (WRAPPED, True)):
        spans = [m.span() for m in words.finditer(layer.text) if m.end() - m.start() >= 16]
        for shift in range(4 if spans else 0):
            yield from _stretches(layer, _base64(layer, budget, spans, wrapped, shift), budget)
    for padded in (True, False):
        yield from _stretches(layer, _short_words(layer.text, padded), budget)


def _stretches(layer: Layer, pieces, budget: Budget) -> Iterator[Layer]:
    text, at, child = layer.text, 0, None
    for a, b, plain, where, mark in pieces:
        if child is not None:
            cut = HARD.search(text, at, a)
            if cut:
                child.add(text[at:cut.start()], 0, at, cut.start(), _SAME)
                yield child.closed()
                child = None
            else:
                child.add(text[at:a], 0, at, a, _SAME)
        if child is None:
            child = Layer(layer)
            start = _last_cut(text, at, a)
            child.add(text[start:a], 0, start, a, _SAME)
        at = b
        if mark is not None:
            # Payloads with nothing to cut at between them end up in one text.
            if child.grown and child.grown + len(plain) > budget.most:
                budget.refuse(layer.source(a, b), mark)
                child.add(text[a:b], 0, a, b, _SAME)
                continue
            child.grown += len(plain)
            child.opened |= {mark}
        cut = _last_cut(plain, 0, len(plain)) if mark is not None else 0
        if cut:
            # What follows the last cut goes on as a stretch of its own.
            child.add(plain[:cut], 0, a, b, where)
            yield child.closed()
            child = Layer(layer)
            child.opened |= {mark}
            child.grown = len(plain) - cut
        child.add(plain[cut:], cut, a, b, where)
    if child is not None:
        cut = HARD.search(text, at)
        end = cut.start() if cut else len(text)
        child.add(text[at:end], 0, at, end, _SAME)
        yield child.closed()


def _last_cut(text: str, a: int, b: int) -> int:
    """Where what follows the last cut in ``[a, b)`` begins; ``a`` if there is none."""
    size = 128
    while True:
        low = max(a, b - size)
        end = None
        for m in HARD.finditer(text, low, b):
            end = m.end()
        if end is not None:
            return end
        if low == a:
            return a
        size *= 4


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


# A piece is ``start, end, replacement, where (as in a layer), digest of what was decompressed or None``.

def _even(width: int):
    return lambda i: (i * width, i * width + width)


def _percent(layer: Layer, budget: Budget):
    text = layer.text
    if "%" not in text:
        return
    for m in PERCENT.finditer(text):
        chain = PERCENTS.match(text, m.start())
        if chain:
            yield chain.start(), chain.end(), "%", None, None
            continue
        yield from _run_of_bytes(bytes.fromhex(m[0].replace("%", "")), 3, layer, m.span(), budget)


def _run_of_bytes(data: bytes, width: int, layer: Layer, span: tuple[int, int], budget: Budget):
    """Bytes that are written out one by one, each ``width`` characters."""
    found = _contents(data, layer, span, budget) if MAGIC.search(data) else []
    if not any(mark for *_, mark in found):
        # Without an encoding every byte is a character, so that no part of the run is lost.
        try:
            plain = data.decode()
        except UnicodeDecodeError:
            plain = data.decode("latin-1")
        yield *span, plain, _even(width) if len(plain) == len(data) else None, None
        return
    for a, b, plain, step, mark in found:
        where = _even(width * step) if step else None
        yield span[0] + a * width, span[0] + b * width, plain, where, mark


def _escapes(layer: Layer, budget: Budget):
    text = layer.text
    if "\\" not in text and "&#" not in text:
        return
    end = 0
    for m in ESCAPE.finditer(text):
        if m.start() < end:
            continue
        chain = CHAINS.match(text, m.start())
        if chain:
            end = chain.end()
            yield chain.start(), end, text[chain.start()], None, None
            continue
        raw = m[0]
        if raw.startswith("\\x"):
            yield from _run_of_bytes(bytes.fromhex(raw.replace("\\x", "")), 4, layer, m.span(), budget)
            continue
        if raw.startswith("\\u") and raw[2] != "{":
            plain, step = _utf16(raw), 6
        else:
            digits = raw.strip("\\uU{}&#;")
            code = int(digits[1:] if digits[0] in "xX" else digits,
                       10 if raw[0] == "&" and digits[0] not in "xX" else 16)
            ok = code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF
            plain, step = (chr(code) if ok else None), len(raw)
        if plain is not None:
            yield m.start(), m.end(), plain, _even(step) if len(plain) * step == len(raw) else None, None


def _utf16(raw: str) -> str | None:
    try:
        return bytes.fromhex(raw.replace("\\u", "")).decode("utf-16-be")
    except UnicodeDecodeError:
        return None


def _base64(layer: Layer, budget: Budget, spans: list[tuple[int, int]], wrapped: bool, shift: int):
    """Words read from their ``shift``-th character on: what is glued to a payload is left as it is."""
    for start, end in spans:
        raw = layer.text[start:end]
        if wrapped:
            lines = [m.span() for m in LINE.finditer(raw)]
            word = "".join(raw[a:b] for a, b in lines)
            firsts = list(accumulate((b - a for a, b in lines), initial=0))[:-1]
            place = _in_lines([a for a, _ in lines], firsts, start)
        else:
            word, place = raw.rstrip("="), _in_word(start)
        size = len(word) - ((len(word) - shift) % 4 == 1)
        if size - shift < 12:
            continue
        data = binascii.a2b_base64(word[shift:size].translate(URLSAFE) + "=" * (-(size - shift) % 4))
        at = start
        for a, b, plain, step, mark in _contents(data, layer, (start, end), budget):
            whole = (a, b, size) == (0, len(data), len(word))
            low = max(at, start if whole and not shift else place(shift + a // 3 * 4))
            high = end if b == len(data) and size == len(word) else place(min(shift + -(-b // 3) * 4, size) - 1) + 1
            if low >= high:
                continue
            where = _fourths(place, shift, a, step, size, low, end if len(word) == size else None) if step else None
            yield low, high, plain, where, mark
            at = high


def _short_words(text: str, padded: bool):
    """Base64 words of few letters that stand where a key may stand, or end in padding.

    An equals sign after a word is its padding or goes with what follows: both are tried.
    """
    for m in SHORT.finditer(text):
        missing = -len(m[0]) % 4
        end = m.end()
        if missing == 3 or padded and (missing == 0 or text[end:end + missing] != "=" * missing):
            continue
        data = binascii.a2b_base64(m[0].translate(URLSAFE) + "=" * missing)
        plain = data.decode("latin-1")
        if PRINTABLE.fullmatch(plain):
            yield m.start(), end + missing * padded, plain, None, None


def _in_word(start: int):
    return lambda i: start + i


def _in_lines(starts: list[int], firsts: list[int], start: int):
    """Where the ``i``-th character of a wrapped word stands."""
    def place(i: int) -> int:
        line = bisect_right(firsts, i) - 1
        return start + starts[line] + i - firsts[line]
    return place


def _fourths(place, shift: int, first: int, step: int, size: int, low: int, end: int | None):
    def where(i: int) -> tuple[int, int]:
        a = shift + (first + i * step) // 3 * 4
        b = shift + (first + i * step + step - 1) // 3 * 4 + 4
        # The padding belongs to the last fourth.
        stop = end if end is not None and b > size else place(min(b, size) - 1) + 1
        return place(a) - low, stop - low
    return where


def _contents(data: bytes, layer: Layer, span: tuple[int, int], budget: Budget,
              within: frozenset = frozenset()) -> list[tuple]:
    """``from, to, text, bytes a character or 0, digest or None`` of the texts that bytes hold.

    Compressed data may begin anywhere and follow other compressed data. What it gives is charged
    once to the place of the document where it stands.
    """
    out, at = [], 0
    for m in MAGIC.finditer(data):
        if m.start() < at:
            continue
        found = _decompressed(data, m.start(), layer, span, budget, within)
        if found is not None:
            out += _plain(data, at, m.start())
            out.append((m.start(), found[0], found[1], 0, found[2]))
            at = found[0]
    return out + _plain(data, at, len(data))


def _plain(data: bytes, a: int, b: int) -> list[tuple]:
    part = data[a:b]
    if part and 0 not in part:
        try:
            text = part.decode()
            return [(a, b, text, int(len(text) == len(part)), None)]
        except UnicodeDecodeError:
            pass
    out = []
    for m in STRETCH.finditer(part):
        kind = "utf-16-le" if m[1] else "utf-16-be" if m[2] else "utf-8"
        text = m[0].decode(kind, "replace")
        step = len(m[0]) // len(text) if len(m[0]) in (len(text), 2 * len(text)) and m[0].isascii() else 0
        out.append((a + m.start(), a + m.end(), text, step, None))
    return out


def _decompressed(data: bytes, start: int, layer: Layer, span: tuple[int, int], budget: Budget,
                  within: frozenset) -> tuple[int, str, bytes] | None:
    """The end of the compressed data at ``start``, its text and its digest, if it can be opened."""
    place = layer.source(*span)
    opener = _opener(data[start:start + 1])
    try:
        opened = opener.decompress(memoryview(data)[start:], budget.most + 1)
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return None
    # Data that is cut short holds what comes before the cut.
    if not opened and not opener.eof:
        return None
    end = len(data) - len(opener.unused_data) if opener.eof else len(data)
    now = hashlib.sha256(memoryview(data)[start:end]).digest()
    if now in within or now in layer.opened:
        return None
    if (place, now) not in budget.known:
        spent = budget.spent.get(place, 0) + len(opened)
        if spent > budget.most or len(within) >= DEPTH:
            budget.refuse(place, now)
            return None
        budget.known.add((place, now))
        budget.spent[place] = spent
    texts, last = [], 0
    for a, b, text, _, _ in _contents(opened, layer, span, budget, within | {now}):
        # Texts with other bytes between them do not go on in each other.
        texts += ["\0" if a > last else "", text]
        last = b
    return end, "".join(texts), now


def _opener(first: bytes):
    if first == b"B":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if first == b"\xfd" else zlib.decompressobj(47)


# ---- Spark ------------------------------------------------------------------------------------

FOUND = ("_spans array<struct<kind:string,start:long,end:long,base:boolean>>, "
         "_layers long, _unopened long")


def scan_secrets(
    docs: DataFrame, id: str = "doc_id", text: str = "text", max_decoded: int = MAX_DECODED
) -> DataFrame:
    """``id, spans, n_layers, n_unopened`` of every row; a span is ``kind, start, end, base``.

    Positions count code points, the end is exclusive, and spans are sorted by start, kind and end.
    ``base`` tells the secrets that stand in the text as they are. Whole texts are scanned, one at
    a time; there is no shuffle. A null text is empty and has no spans; repeated rows are rows of
    their own; other columns are not read.
    """
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                   ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            spans, layers, left = [], [], []
            for t in texts_of(batch, "_t"):
                base, every, n, unopened = scan(t, max_decoded)
                own = set(base)
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "base": (a, k, b) in own}
                              for a, k, b in every])
                layers.append(n)
                left.append(unopened)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, kind), pa.array(layers, pa.int64()),
                 pa.array(left, pa.int64())], ["_id", "_spans", "_layers", "_unopened"])

    return rows.mapInArrow(run, f"_id long, {FOUND}").select(
        F.col("_id").alias(id), F.col("_spans").alias("spans"),
        F.col("_layers").alias("n_layers"), F.col("_unopened").alias("n_unopened"))


def mask_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The same rows and columns, with each secret replaced by its kind in square brackets.

    Spans that overlap are replaced together, by the kind of the first. A payload too large to be
    opened becomes ``[unopened]``, so that nothing hidden in it goes on. Texts without secrets,
    nulls included, stay as they are. If there is a column ``length`` it is set to the new number
    of characters of a changed text.
    """
    cleaned = F.pandas_udf(_mask, "string")
    name = "_masked"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, cleaned(F.col(text)))
    out = []
    for c in docs.columns:
        value = F.col(c)
        if c == text:
            value = F.col(name).alias(c)
        elif c == length:
            now = F.char_length(name).cast(docs.schema[c].dataType)
            value = F.when(F.col(name) != F.col(text), now).otherwise(value).alias(c)
        out.append(value)
    return rows.select(*out)


def masked(text: str, max_decoded: int = MAX_DECODED) -> str:
    """The text without its secrets; a payload too large to be opened is masked whole."""
    _, spans, _, left = _scanned(text, max_decoded)
    names = [(a, KINDS[kind], b) for a, kind, b in spans] + [(a, UNOPENED, b) for a, b in left]
    out, at = [], 0
    for start, name, end in sorted(names, key=lambda n: n[0]):
        if start >= at:
            out += [text[at:start], f"[{name}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _mask(values):
    return values.map(masked, na_action="ignore")
