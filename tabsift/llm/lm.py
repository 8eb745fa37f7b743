"""A hashed maximum-entropy language model with a class-factored softmax.

The probability of a word is that of its class, given the words before it, times its own within the
class. The first factor is a softmax over classes whose features are the previous word, the previous
two words and, as a skip feature, the word before the previous one, each hashed into a table of
weights. The second has the word itself as its only feature; its maximum-entropy solution is the
word's smoothed share of its class and needs no gradient.

The most frequent words are classes of their own, the end of a text is one, and all other words,
unknown ones among them, share classes by their last two bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.llm.blocks import block_rows, gathered, summed
from tabsift.llm.common import fold, mixed, slices, texts_of, written
from tabsift.llm.shingles import PIECE, pieces, word_hashes
from tabsift.operators.joins import keyed_join

#: Hashes that stand for the start and the end of a text.
START, END = np.uint64(0), np.uint64(1)
CLASSES = 64
#: Class 0 is the end, then come single words, then shared classes.
SINGLE = 31
SHARED = CLASSES - SINGLE - 1
TABLES, ROWS = 3, 1 << 13
STEP = 0.3
BATCH = 2048
#: At most so many words have their counts at hand in every task; the counts of others are joined.
HEAD = 1 << 19
FLUSH = 2_000_000


def tokens(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Numbers of tokens, hashes and shared classes of neighbouring texts, some at a time.

    A text's tokens are its words and then the end.
    """
    for a, b in slices([len(t) + 1 for t in texts], PIECE):
        if b - a == 1 and len(texts[a]) > PIECE:
            parts = list(pieces(texts[a]))
            words, tails = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
            stops = np.array([len(words)])
        else:
            starts, words, tails = word_hashes(b"\n".join(texts[a:b]))
            stops = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts[a:b]]))
        hashes = np.insert(words, stops, END)
        shared = SINGLE + 1 + mixed(tails.astype(np.uint64)) % np.uint64(SHARED)
        yield (np.diff(stops, prepend=0) + 1).tolist(), hashes, np.insert(shared.astype(np.int64), stops, 0)


def features(counts: list[int], hashes: np.ndarray) -> np.ndarray:
    """For each token the row of each table: previous word, previous two, the one before."""
    starts = np.cumsum(counts) - counts
    one = np.append(START, hashes[:-1])
    one[starts] = START
    two = np.append(START, one[:-1])
    two[starts] = START
    second = starts[np.asarray(counts) > 1] + 1
    two[second] = START
    with np.errstate(over="ignore"):
        both = mixed(one * np.uint64(0x9E3779B97F4A7C15) + two)
        skip = mixed(two + np.uint64(0x632BE59BD9B4E019))
    return np.stack([mixed(one) % np.uint64(ROWS), both % np.uint64(ROWS), skip % np.uint64(ROWS)]).astype(np.int64)


@dataclass
class Vocabulary:
    """What counting gives: the head words by hash, and totals; its size does not grow with rows."""

    total: int
    distinct: int
    words: np.ndarray
    counts: np.ndarray
    single: np.ndarray
    mass: np.ndarray
    members: np.ndarray

    @property
    def log_total(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    def bias(self) -> np.ndarray:
        prior = self.mass + 1.0
        return np.log(prior / prior.sum()).astype(np.float32)

    def log_members(self) -> np.ndarray:
        """log10 of what a class's own words share, an unknown one included; 0 for single words."""
        out = np.log10(self.mass + 0.5 * (self.members + 1))
        out[:SINGLE + 1] = 0
        return out

    def classes(self, hashes: np.ndarray, shared: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.single, hashes)
        at[at == len(self.single)] = 0
        if not len(self.single):
            return shared
        own = self.single[at] == hashes
        return np.where(own, self._single_class[at], shared)

    def __post_init__(self) -> None:
        # Single words are kept in order of hash; their classes follow that order too.
        self._single_class = 1 + np.arange(len(self.single))

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of head words, -1 for others."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, self.counts[at], -1)


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """``word, class, count`` of every distinct token, as hashes; counted per task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            words = np.concatenate([h for h, _ in held])
            shared = np.concatenate([c for _, c in held])
            unique, first, n = np.unique(words, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(unique.view(np.int64)), pa.array(shared[first].astype(np.int32)),
                 pa.array(n.astype(np.int64))], ["word", "class", "count"])

        for batch in batches:
            for _, hashes, shared in tokens([t.encode() for t in texts_of(batch, column)]):
                held.append((hashes, shared))
                size += len(hashes)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = texts.select(column).mapInArrow(count, "word long, class int, count long")
    return rows.groupBy("word").agg(F.min("class").alias("class"), F.sum("count").alias("count"))


def vocabulary(words: DataFrame, head: int = HEAD) -> Vocabulary:
    """Totals and the ``head`` most frequent words of a table of word counts."""
    totals = words.groupBy("class").agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect()
    mass, members = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in totals:
        mass[r["class"]], members[r["class"]] = r["n"], r["v"]
    total, distinct = int(mass.sum()), int(members.sum())
    top = _most_frequent(words, head).toPandas().sort_values(["count", "word"], ascending=[False, True])
    hashes = top["word"].to_numpy(np.int64).view(np.uint64)
    counts, kinds = top["count"].to_numpy(np.int64), top["class"].to_numpy(np.int64)
    alone = np.flatnonzero(hashes != END)[:SINGLE]
    alone = alone[np.argsort(hashes[alone])]
    for k, i in enumerate(alone.tolist()):
        mass[kinds[i]] -= counts[i]
        members[kinds[i]] -= 1
        mass[1 + k], members[1 + k] = counts[i], 1
    single = hashes[alone]
    # The end, whose class has no other member, is always at hand.
    others = hashes != END
    hashes, counts = np.append(hashes[others], END), np.append(counts[others], int(mass[0]))
    order = np.argsort(hashes)
    return Vocabulary(total, distinct, hashes[order], counts[order], single, mass, members)


def _most_frequent(words: DataFrame, most: int) -> DataFrame:
    """The words from the lowest count on that at most ``most`` words reach, to a sixteenth of an octave."""
    level = F.floor(F.log2("count") * 16).cast("int")
    sizes = words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    least, total = None, 0
    for r in sorted(sizes, reverse=True):
        total += r["n"]
        if total > most:
            break
        least = r["level"]
    return words.filter(level >= least) if least is not None else words.limit(0)


def class_log_probabilities(
    weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, kinds: np.ndarray
) -> np.ndarray:
    """Natural log of the softmax of each token's class."""
    logits = weights[0][rows[0]]
    for k in range(1, TABLES):
        logits += weights[k][rows[k]]
    logits += bias
    total = np.exp(logits) @ _ONES
    return logits[np.arange(len(kinds)), kinds] - np.log(total)


_ONES = np.ones(CLASSES, np.float32)


def sums_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and the sum of the values of each."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ordered = rows[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    starts = np.flatnonzero(new)
    sums = values.take(order[starts], 0)
    more = np.diff(np.append(starts, len(order))) - 1
    if more.any():
        # Most rows have one value only, which needs no adding.
        several = np.flatnonzero(more)
        firsts = np.cumsum(more[several]) - more[several]
        sums[several] += np.add.reduceat(values.take(order[~new], 0), firsts)
    return ordered[starts], sums


def descend(weights: np.ndarray, seen: np.ndarray, bias: np.ndarray, rows: np.ndarray, kinds: np.ndarray) -> None:
    """One gradient step on a batch, with a step size per row of weights that shrinks as it moves.

    The gradients of all tokens of a batch that share a row are added up before the row moves.
    """
    gradient = weights[0].take(rows[0], 0)
    for k in range(1, TABLES):
        gradient += weights[k].take(rows[k], 0)
    gradient += bias
    np.exp(gradient, out=gradient)
    gradient /= (gradient @ _ONES)[:, None]
    gradient[np.arange(len(kinds)), kinds] -= 1
    for k in range(TABLES):
        at, total = sums_by_row(gradient, rows[k])
        seen[k][at] += (total * total) @ _ONES / CLASSES
        total *= (STEP / np.sqrt(seen[k][at] + 1e-6))[:, None]
        weights[k][at] -= total


def trained(texts: DataFrame, column: str, vocab: Vocabulary) -> np.ndarray:
    """The weights: every task descends over its own texts, and the results are averaged.

    Tasks are weighted by their tokens. What they send is as large as the model, whatever they
    read, and is added in bounded steps.
    """
    spark = texts.sparkSession
    shared_vocab = spark.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared_vocab.value
        bias = known.bias()
        weights = np.zeros((TABLES, ROWS, CLASSES), np.float32)
        seen = np.zeros((TABLES, ROWS), np.float32)
        done = 0
        for batch in batches:
            for counts, hashes, shared in tokens([t.encode() for t in texts_of(batch, column)]):
                kinds, rows = known.classes(hashes, shared), features(counts, hashes)
                for i in range(0, len(kinds), BATCH):
                    descend(weights, seen, bias, rows[:, i:i + BATCH], kinds[i:i + BATCH])
                done += len(kinds)
        if done:
            share = np.float32(done / 1e6)
            arrays = {"weights": weights * share, "tokens": np.array([share])}
            for part in block_rows(arrays):
                yield pa.RecordBatch.from_pandas(part, preserve_index=False)

    rows = texts.select(column).mapInArrow(run, "name string, block long, task long, data binary")
    found = gathered(summed(rows, "float32"), "float32", TABLES * ROWS * CLASSES)
    shape = (TABLES, ROWS, CLASSES)
    if "tokens" not in found:
        return np.zeros(shape, np.float32)
    empty = np.zeros(TABLES * ROWS * CLASSES, np.float32)
    return (found.get("weights", empty) / found["tokens"][0]).reshape(shape).astype(np.float32)


_SCORED = ("uid long, doc_id long, held_out boolean, n_tokens long, known long, counted double, "
           "own double, classes double, words array<long>, times array<long>")


def scored(docs: DataFrame, vocab: Vocabulary, weights: np.ndarray) -> DataFrame:
    """Per document: what the head words and the classes add, and the words still to be looked up.

    ``counted`` sums log10(count + 0.5) of head words, ``own`` that of those in shared classes;
    ``classes`` the log10 probabilities of classes less what members of shared classes share.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocab, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        bias, members = known.bias(), known.log_members()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for counts, hashes, kinds in tokens([t.encode() for t in texts_of(batch, "_t")]):
                kinds, rows = known.classes(hashes, kinds), features(counts, hashes)
                classes = np.concatenate([
                    class_log_probabilities(model, bias, rows[:, i:i + BATCH], kinds[i:i + BATCH])
                    for i in range(0, len(kinds), BATCH)]).astype(np.float64) / np.log(10)
                classes -= members[kinds]
                found = known.look_up(hashes)
                head = found >= 0
                logs = np.where(head, np.log10(np.maximum(found, 0) + 0.5), 0.0)
                starts = np.cumsum(counts) - counts
                out[0] += counts
                out[1] += np.add.reduceat((found > 0).astype(np.int64), starts).tolist()
                out[2] += np.add.reduceat(logs, starts).tolist()
                out[3] += np.add.reduceat(np.where(kinds > SINGLE, logs, 0.0), starts).tolist()
                out[4] += np.add.reduceat(classes, starts).tolist()
                for start, n in zip(starts.tolist(), counts):
                    rest = hashes[start:start + n][~head[start:start + n]]
                    words, times = np.unique(rest, return_counts=True)
                    out[5].append(words.view(np.int64))
                    out[6].append(times.astype(np.int64))
            n = batch.num_rows
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(),
                     pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + n)), batch.column(0), batch.column(1),
                 *[pa.array(v, t) for v, t in zip(out, types)]],
                [c.split(" ")[0] for c in _SCORED.split(", ")])
            uid += n

    return docs.select("_id", "_held", "_t").mapInArrow(run, _SCORED)


def score_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text", head: int = HEAD,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Documents whose crc32 of the id modulo 5 is 1 are held out, the model learns from all others
    (a null id counts as empty text, so it is learned from). Tokens are the words of the text, A to
    Z in lower case, and one end. ``base_score`` sums the log10 of smoothed token shares; ``score``
    is the log10 probability of the text under the model. Words are told apart by 64-bit hashes.

    All training tokens are counted and trained on. The counts of the ``head`` most frequent words
    travel to every task, at most ``head`` of them; those of all others are joined, repeats within
    a document merged before. A null text is empty: one token, the end. Repeated rows are rows of
    their own; without training documents all tokens are unknown. Other columns are not read.
    """
    rows = docs.select(F.col(id).cast("long").alias("_id"), (fold(F.col(id)) == 1).alias("_held"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    training = rows.filter(~F.col("_held"))
    words = written(word_counts(training, "_t"), "words")
    vocab = vocabulary(words, head)
    weights = trained(training, "_t", vocab)
    table = written(scored(rows, vocab, weights), "scored")

    rest = table.select("uid", F.explode(F.arrays_zip("words", "times")).alias("_w")).select(
        "uid", F.col("_w.words").alias("word"), F.col("_w.times").alias("times"))
    looked = keyed_join(rest, words.select(F.col("word").alias("_word"), "count"), {"word": "_word"}, "left")
    count = F.coalesce("count", F.lit(0))
    added = looked.groupBy(F.col("uid").alias("_uid")).agg(
        F.sum(F.col("times") * F.log10(count + 0.5)).alias("_logs"),
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("_known"))
    joined = keyed_join(table, added, {"uid": "_uid"}, "left")
    logs = F.coalesce("_logs", F.lit(0.0))
    return joined.select(
        F.col("doc_id").alias(id), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("counted") + logs - F.col("n_tokens") * F.lit(vocab.log_total)).alias("base_score"),
        (F.col("classes") + F.col("own") + logs).alias("score"))
