"""A byte-pair vocabulary compiled to a deterministic transducer that counts tokens.

The tokens of a text up to any point end in one certain token, and whether a token may follow
another depends on these two alone. So what the next character does is decided by the tokens that
end where an unfinished token could begin: that is the state, and every transition carries the
change of the number of tokens. States are found as texts ask for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.llm.common import slices, texts_of

#: The mark that stands for a space in a vocabulary.
SPACE = "▁"
PAGE_BITS = 6
PAGE = 1 << PAGE_BITS
#: States held at a time; with more the table starts anew, which costs time only.
MOST_STATES = 160_000
#: Letters that are worked on at a time, and letters of a chunk.
SEGMENT = 1 << 20
CHUNK = 128
_MISSING = -1
#: A transition holds the next state above these bits and the change of the count, shifted, in them.
_CHANGE_BITS = 7
_SHIFT = 64


class Vocabulary:
    """Pieces of a ``sentencepiece`` byte-pair model without normalisation and with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.scores = {
            self.model.id_to_piece(i): self.model.get_score(i) for i in ids
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)
                    or self.model.is_unused(i))}
        self.letters = sorted({c for p in self.scores for c in p})
        self.prefixes = {p[:k] for p in self.scores for k in range(1, len(p))}
        self._parts: dict[str, tuple[str, ...]] = {}

    def fits(self) -> bool:
        """Whether tokens can be counted character by character: no piece has a space after another
        letter, every letter is a piece, and texts are taken as they are, with a space before."""
        return (
            all(SPACE not in p.lstrip(SPACE) for p in self.scores)
            and all(c in self.scores for c in self.letters)
            and self.model.encode("ﬁ  Ａ\t", out_type=str)
            == self._plain(SPACE + "ﬁ" + SPACE * 2 + "Ａ\t")
            and self.model.encode("") == [] and self.model.is_byte(self.model.piece_to_id("<0x09>"))
        )

    def _plain(self, text: str) -> list[str]:
        out = []
        for p in self.parts(text):
            out += [p] if p in self.scores else [f"<0x{b:02X}>" for b in p.encode()]
        return out

    def parts(self, text: str) -> tuple[str, ...]:
        """The tokens of a short text: the best-scored neighbours merge first, the left ones of equals."""
        known = self._parts.get(text)
        if known is None:
            items = list(text)
            while len(items) > 1:
                best, at = None, 0
                for i in range(len(items) - 1):
                    score = self.scores.get(items[i] + items[i + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, i
                if best is None:
                    break
                items[at:at + 2] = [items[at] + items[at + 1]]
            known = self._parts[text] = tuple(items)
        return known


class Transducer:
    """The states and transitions found so far, as arrays over states and pages of letters."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(c) for c in vocabulary.letters]] = True
        # Letters are numbered as texts use them, so that most texts need few pages; the space is 0
        # and unknown letters have no number.
        self.letters = [SPACE]
        self.numbers = np.full(0x110000, -1, np.int32)
        self.numbers[[32, ord(SPACE)]] = 0
        self.restart()

    def restart(self) -> None:
        self.vocabulary._parts.clear()
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.pages: dict[int, np.ndarray] = {}
        self.fresh = self._state(((None, "", 0),))

    def _state(self, entries: tuple) -> int:
        """``entries`` are ``(token that ends here, text since, tokens since)`` of open beginnings."""
        found = self.index.get(entries)
        if found is None:
            found = self.index[entries] = len(self.states)
            self.states.append(entries)
        return found

    def follow(self, state: int, number: int) -> int:
        """The packed transition of one state and letter, worked out and kept."""
        v, letter = self.vocabulary, self.letters[number]
        last, count, entries = None, 0, []
        for before, since, tokens in self.states[state]:
            text = since + letter
            if last is None and text in v.scores and v.parts((before or "") + text) == (
                    (text,) if before is None else (before, text)):
                last, count = text, tokens + 1
            if text in v.prefixes:
                entries.append((before, text, tokens))
        # Counts in a state are relative to the number of tokens up to it.
        following = tuple((b, t, n - count) for b, t, n in entries) + ((last, "", 0),)
        packed = (self._state(following) << _CHANGE_BITS) | (count + _SHIFT)
        page = self.pages.get(number >> PAGE_BITS)
        if page is None or len(page) <= state:
            size = max(1024, min(2 * len(self.states), len(self.states) + (1 << 15)))
            larger = np.full((size, PAGE), _MISSING, np.int32)
            if page is not None:
                larger[:len(page)] = page
            page = self.pages[number >> PAGE_BITS] = larger
        page[state, number & (PAGE - 1)] = packed
        return packed

    def step(self, states: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The packed transitions of many states and letters at once."""
        out = np.full(len(states), _MISSING, np.int32)
        high = numbers >> PAGE_BITS
        pages = np.unique(high).tolist()
        for p in pages:
            own = slice(None) if len(pages) == 1 else np.flatnonzero(high == p)
            table = self.pages.get(p)
            if table is not None:
                at = states[own]
                inside = at < len(table)
                got = table[np.where(inside, at, 0), numbers[own] & (PAGE - 1)]
                out[own] = np.where(inside, got, _MISSING)
        missing = np.flatnonzero(out == _MISSING)
        if len(missing):
            pairs = states[missing].astype(np.int64) << 24 | numbers[missing]
            unique, back = np.unique(pairs, return_inverse=True)
            got = [self.follow(k >> 24, k & 0xFFFFFF) for k in unique.tolist()]
            out[missing] = np.array(got, np.int32)[back]
        return out


    def walk(self, state: int, numbers: list[int]) -> tuple[list[int], int]:
        """The changes of the count along one run of letters, and the state at its end."""
        changes = []
        for n in numbers:
            page = self.pages.get(n >> PAGE_BITS)
            packed = _MISSING
            if page is not None and state < len(page):
                packed = int(page[state, n & (PAGE - 1)])
            if packed == _MISSING:
                packed = self.follow(state, n)
            changes.append((packed & (2 * _SHIFT - 1)) - _SHIFT)
            state = packed >> _CHANGE_BITS
        return changes, state

    def changes(self, codes: np.ndarray, starts: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """What each letter of several texts adds to its text's number of tokens.

        ``codes`` are code points, ``starts`` tells where texts begin. All chunks of equal length
        run side by side, one letter of each at a time. Where a text begins, a space follows another
        letter or an unknown letter stands, the state does not depend on what came before: a chunk
        that holds such a place starts there. The letters before it follow from the state at the left
        neighbour's end, chunk after chunk where several in a row hold no such place; no state map is
        built for states that no chunk is entered in.
        """
        if len(self.states) > MOST_STATES:
            self.restart()
        n = len(codes)
        numbers = self.numbers[codes]
        new = np.unique(codes[(numbers < 0) & self.known[codes]])
        if len(new):
            self.numbers[new] = len(self.letters) + np.arange(len(new))
            self.letters += map(chr, new.tolist())
            numbers = self.numbers[codes]
        unknown = numbers < 0
        out = np.zeros(n, np.int32)
        out[unknown] = (1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))[unknown]
        free = np.zeros(n, bool)
        free[1:] = ((numbers[1:] == 0) & (numbers[:-1] != 0)) | unknown[:-1]
        free |= unknown
        free[starts] = True

        rows = -(-n // chunk)
        pad = rows * chunk - n
        grid = lambda a, fill: np.pad(a, (0, pad), constant_values=fill).reshape(rows, chunk).T.copy()
        letters, fresh, skip = grid(numbers, -1), grid(free, True), grid(unknown, True)
        first = np.where(fresh.any(0), fresh.argmax(0), chunk)
        changes = np.zeros((chunk, rows), np.int32)
        state = np.full(rows, self.fresh, np.int32)
        for i in range(chunk):
            self._advance(np.flatnonzero((first <= i) & ~skip[i]), i, letters, fresh, changes, state)

        done = first < chunk
        open_heads = np.flatnonzero(first > 0)
        while len(open_heads):
            # A text starts at the first letter of all, so the first row has no head.
            ready = open_heads[done[open_heads - 1]]
            if len(ready) <= 16:
                for r in ready.tolist():
                    steps, end = self.walk(int(state[r - 1]), letters[:first[r], r].tolist())
                    changes[:first[r], r] = steps
                    if not done[r]:
                        state[r] = end
            else:
                entering = state.copy()
                entering[ready] = state[ready - 1]
                for i in range(int(first[ready].max())):
                    self._advance(ready[first[ready] > i], i, letters, None, changes, entering)
                passing = ready[~done[ready]]
                state[passing] = entering[passing]
            done[ready] = True
            open_heads = np.setdiff1d(open_heads, ready, assume_unique=True)
        out += changes.T.reshape(-1)[:n]
        return out

    def _advance(self, rows, i, letters, fresh, changes, state) -> None:
        """Take the rows' letters at place ``i``."""
        if not len(rows):
            return
        at = state[rows]
        if fresh is not None:
            at = np.where(fresh[i, rows], self.fresh, at)
        packed = self.step(at, letters[i, rows])
        changes[i, rows] = (packed & (2 * _SHIFT - 1)) - _SHIFT
        state[rows] = packed >> _CHANGE_BITS


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer | None:
    """The transducer of the vocabulary at ``path``; None if it cannot be compiled."""
    vocabulary = Vocabulary(path)
    return Transducer(vocabulary) if vocabulary.fits() else None


def segments(text: str, limit: int = SEGMENT) -> Iterator[str]:
    """A text with its leading space mark, cut where a space follows another letter."""
    text, at = SPACE + text, 0
    while len(text) - at > limit:
        stop = at + limit
        while stop < len(text) and not (text[stop] == " " and text[stop - 1] not in (" ", SPACE)):
            stop += 1
        yield text[at:stop]
        at = stop
    if at < len(text):
        yield text[at:]


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """The number of tokens of every text; an empty text has none."""
    machine = transducer(path)
    totals = np.zeros(len(texts), np.int64)
    if machine is None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        totals[:] = [len(model.encode(t, num_threads=1)) for t in texts]
        return totals
    parts = [(i, p) for i, t in enumerate(texts) if t for p in segments(t)]
    for a, b in slices([len(p) for _, p in parts], SEGMENT):
        joined = "".join(p for _, p in parts[a:b])
        sizes = np.array([len(p) for _, p in parts[a:b]])
        starts = np.cumsum(sizes) - sizes
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        counts = np.add.reduceat(machine.changes(codes, starts), starts)
        np.add.at(totals, [i for i, _ in parts[a:b]], counts)
    return totals


def token_counts(
    docs: DataFrame, path: str | None = None, limit: int = 4096, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document.

    ``path`` is a ``sentencepiece`` file; the counts are those of its library without begin or end
    marks. Whole texts are read, in segments that are cut where tokens cannot reach across, and
    there is no shuffle. A null text is empty: no bytes, no tokens. Repeated rows are rows of their
    own, an empty table gives an empty one, other columns are not read.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.octet_length(value).cast("long").alias("_b"),
                       value.alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_tokens(texts_of(batch, "_t"), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts)], ["_id", "_b", "_n"])

    return rows.mapInArrow(run, "_id long, _b long, _n long").select(
        F.col("_id").alias(id), F.col("_b").alias("n_bytes"), F.col("_n").alias("n_tokens"),
        (F.col("_n") > limit).alias("over_limit"))
