"""Languages by error-correcting output codes over character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsift.llm.blocks import block_rows, gathered, summed
from tabsift.llm.common import fold, slices, texts_of

BUCKETS = 1 << 14
SMOOTHING = 1e-6
#: A document's n-gram frequencies are summed as integers of this scale, so sums do not depend on order.
SCALE = 1 << 30
PIECE = 1 << 20
UNDETERMINED = "und"

# Letters of ASCII in lower case, bytes of other letters as they are, everything else a space.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[128:] = np.arange(128, 256)
for _c in range(26):
    _CLASS[65 + _c] = _CLASS[97 + _c] = 97 + _c


def _buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes that start at each position but the last two."""
    c = _CLASS[data].astype(np.uint32)
    code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def frequencies(texts: list[bytes]) -> np.ndarray:
    """Each text's share of n-grams per bucket, one row per text. Long texts go in pieces."""
    rows = np.zeros((len(texts), BUCKETS), np.float64)
    for a, b in slices([len(t) for t in texts], PIECE):
        if b - a == 1 and len(texts[a]) > PIECE:
            data = b" " + texts[a] + b" "
            for i in range(0, len(data) - 2, PIECE):
                got = _buckets(np.frombuffer(data[i:i + PIECE + 2], np.uint8))
                rows[a] += np.bincount(got, minlength=BUCKETS)
            continue
        data = np.frombuffer(b"".join(b" " + t + b" " for t in texts[a:b]), np.uint8)
        sizes = np.array([len(t) + 2 for t in texts[a:b]])
        ends = np.cumsum(sizes)
        inside = np.ones(len(data), bool)
        inside[ends - 1] = inside[ends - 2] = False
        where = np.repeat(np.arange(b - a) * BUCKETS, sizes)
        key = (where[:-2] + _buckets(data))[inside[:-2]]
        rows[a:b] = np.bincount(key, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
    total = rows.sum(1, keepdims=True)
    return rows / np.where(total == 0, 1, total)


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 per class.

    Up to five classes get the exhaustive code. More get the best of 200 random codes of
    10 log2(classes) bits: the one whose closest two rows differ most.
    """
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 5:
        bits = np.arange(2 ** (classes - 1) - 1) + 2 ** (classes - 1)
        return np.array([[1.0 if b >> (classes - 1 - i) & 1 else -1.0 for b in bits]
                         for i in range(classes)])
    rng, length = np.random.default_rng(seed), math.ceil(10 * math.log2(classes))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (classes, length))
        code = code[:, np.abs(code.sum(0)) < classes]
        apart = code.shape[1] - code @ code.T
        np.fill_diagonal(apart, np.inf)
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Model:
    """Languages, their codewords, one linear classifier per bit, and the decoding weights."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest language and the confidence of every row of n-gram shares.

        Each bit's classifier gives a margin; a language's distance is the exponential loss of the
        margins against its codeword, weighted by how far the bit separates that language. The
        confidence compares the nearest two: 0 when they tie, near 1 when the second is far.
        """
        margins = share @ self.weights
        loss = np.exp(-np.clip(margins[:, None, :] * self.code[None], -30, 30))
        away = (loss * self.trust[None]).sum(2)
        best = away.argmin(1)
        if len(self.langs) == 1:
            return best, np.ones(len(share))
        near = np.partition(away, 1, axis=1)
        return best, 1 - near[:, 0] / near[:, 1]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on every row with a text and a language; None if there is none.

    One pass: each task adds up its documents' n-gram shares per language, all documents counting
    alike, and the sums are added in bounded steps. A bit's classifier is the log ratio of mean
    shares between the languages whose bit is +1 and those whose bit is -1. The model holds
    ``BUCKETS`` cells per language, whatever the number of rows.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).cast("string").alias("_t"), F.col(lang).cast("string").alias("_l"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = [t.encode() for t in batch["_t"]], batch["_l"].to_numpy()
            for a in range(0, len(texts), 64):
                share = np.rint(frequencies(texts[a:a + 64]) * SCALE).astype(np.int64)
                for name in set(langs[a:a + 64]):
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += share[langs[a:a + 64] == name].sum(0)
        yield from block_rows(sums)

    counted = rows.mapInPandas(count, "name string, block long, task long, data binary")
    return fitted(gathered(summed(counted, "int64"), "int64", BUCKETS))


def fitted(sums: dict[str, np.ndarray]) -> Model | None:
    langs = sorted(k for k, v in sums.items() if v.sum())
    if not langs:
        return None
    share = np.array([sums[k] / sums[k].sum() for k in langs])
    code = codewords(len(langs))
    weights = np.zeros((BUCKETS, code.shape[1]))
    if len(langs) > 1:
        for b in range(code.shape[1]):
            up, down = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
            weights[:, b] = np.log((up + SMOOTHING) / (down + SMOOTHING))
    # Margins are scaled so that a typical text of a language has a margin of about 1, and a bit
    # counts for a language as much as it separates the language's own mean text.
    margins = share @ weights
    scale = np.abs(margins).mean(0)
    weights /= np.where(scale == 0, 1, scale)
    trust = np.maximum(code * (share @ weights), 1e-3)
    return Model(langs, code, weights, trust / trust.sum(1, keepdims=True))


def predict(
    docs: DataFrame, model: Model | None, keep: list[str], text: str = "text",
    ambiguous_below: float = 0.01,
) -> DataFrame:
    """``keep..., lang_pred, score, ambiguous`` of every row, from the text alone; ``keep`` may hold it.

    A null text or one without a letter is ``und`` with score 0. ``ambiguous`` marks these and
    texts whose nearest two codewords are closer than ``ambiguous_below``. There is no shuffle.
    """
    own = [F.col(c) for c in keep if c != text]
    rows = docs.select(*own, F.col(text).cast("string").alias("_t"))
    schema = T.StructType(rows.schema.fields + [
        T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "_t")
            pred, score = [], []
            for a in range(0, len(texts), 64):
                part = texts[a:a + 64]
                if model is None:
                    best, sure = [0] * len(part), [0.0] * len(part)
                else:
                    best, sure = model.decode(frequencies([t.encode() for t in part]))
                for t, k, s in zip(part, best, sure):
                    known = model is not None and any(map(str.isalpha, t))
                    pred.append(model.langs[k] if known else UNDETERMINED)
                    score.append(float(s) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                [*batch.schema.names, "_lang", "_score"])

    found = rows.mapInArrow(run, schema)
    return found.select(
        *[(F.col("_t") if c == text else F.col(c)).alias(c) for c in keep],
        F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"),
        (F.col("_score") < ambiguous_below).alias("ambiguous"))


def keep_identified(docs: DataFrame, ambiguous_below: float = 0.01) -> DataFrame:
    """The documents in a language that was learned from ``docs``, with all their columns.

    Rejected are texts that are null or have no letter, and texts between the nearest two codewords,
    as those in an unknown script are. If nothing can be learned every document is rejected.
    """
    model = train(docs.filter(fold(F.col("doc_id")) != 0))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    judged = predict(docs.toDF(*names), model, names, text, ambiguous_below)
    return judged.filter("not ambiguous").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def identify(docs: DataFrame, ambiguous_below: float = 0.01) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` of every document.

    Documents whose crc32 of the id is divisible by 5 are held out: the model learns from the
    others alone, and from their ``text`` and non-null ``lang`` only. A null id counts as held out.
    Without a row to learn from every document is ``und``. Repeated rows get equal results, an
    empty table gives an empty one, and other columns are not read.
    """
    held = fold(F.col("doc_id")) == 0
    model = train(docs.filter(~held))
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"], ambiguous_below=ambiguous_below)
