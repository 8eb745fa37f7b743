"""Cheapest repair of conversations whose turns are damaged, by tables over blocks of rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.llm.common import written
from tabsift.operators.joins import keyed_join

#: Costs of the edits; a truncated row that stays costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: White space, and the characters that end a sentence.
SPACE, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Pairs of role initials that may follow each other.
PAIRS = frozenset({b"su", b"ua", b"au"})

#: Rows of a block of the tables.
BLOCK = 4
#: A slice of a conversation has at most so many rows, and about so many characters. Repair at most
#: triples the rows, and a place leaves room for 2^14.
ROWS, CHARS = 4096, 4 << 20

# Symbols of rows: one that must go, and the role's initial, in capitals where the row is truncated.
_SYMBOLS = b"xsuaoSUAO"
_CODE = np.full(256, -1, np.int64)
_CODE[list(_SYMBOLS)] = np.arange(len(_SYMBOLS))
# States: no row yet, after the system's, after a user's, after an assistant's row.
_STATES = range(4)
_USER, _ASSISTANT = 2, 3
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
# The state after an inserted or renamed row: only one role can follow.
_AFTER = [2, 2, 3, 2]


class Tables(NamedTuple):
    """Normalised vectors of costs to go, and how rows and blocks of rows change them."""

    vectors: np.ndarray  # vector, state: cost above the least
    rows: np.ndarray  # vector, symbol: the vector before the row
    row_costs: np.ndarray  # vector, symbol: what the least cost grows by
    blocks: np.ndarray  # vector, block: the vector before the block
    block_costs: np.ndarray
    edits: list[list[list[tuple[str, int]]]]  # vector, symbol, state: the edits taken and the state after


def _row_edits(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """What may be done with a row: letter, cost and the state after it, least letter first."""
    yield "D", DELETE, state
    if symbol != "x":
        cut = TRUNCATED * symbol.isupper()
        if (state, symbol.lower()) in _NEXT:
            yield "K", cut, _NEXT[state, symbol.lower()]
        yield "R", REROLE + cut, _AFTER[state]


def _before(vector: tuple[int, ...], symbol: str) -> tuple[list[int], list[tuple[str, int]]]:
    """Costs to go before a row from those after it, and the ASCII-least cheapest edits."""
    own = [min(cost + vector[to] for _, cost, to in _row_edits(symbol, q)) for q in _STATES]
    # Two rows inserted in front bring every state back to itself or its like.
    costs = [min(own[q], INSERT + own[_AFTER[q]], 2 * INSERT + own[_AFTER[_AFTER[q]]]) for q in _STATES]
    edits = []
    for start in _STATES:
        q, letters = start, ""
        while True:
            options = [(letter, to) for letter, cost, to in _row_edits(symbol, q) if cost + vector[to] == costs[q]]
            if INSERT + costs[_AFTER[q]] == costs[q]:
                options.append(("I", -1))
            letter, to = min(options)
            letters += letter
            if letter != "I":
                break
            q = _AFTER[q]
        edits.append((letters, to))
    return costs, edits


@lru_cache(1)
def tables() -> Tables:
    """All vectors that can come up are those reached from the one behind the last row."""
    found = {_LAST: 0}
    rows, row_costs, edits = [], [], []
    for vector in (queue := [_LAST]):
        steps = [_before(vector, chr(s)) for s in _SYMBOLS]
        for costs, _ in steps:
            normal = tuple(c - min(costs) for c in costs)
            if normal not in found:
                found[normal] = len(found)
                queue.append(normal)
        rows.append([found[tuple(c - min(costs) for c in costs)] for costs, _ in steps])
        row_costs.append([min(costs) for costs, _ in steps])
        edits.append([e for _, e in steps])
    one, cost = np.array(rows), np.array(row_costs)
    # A block's first row is its most significant digit; its rows are taken from the last one on.
    place = np.arange(len(_SYMBOLS) ** BLOCK)
    at = np.repeat(np.arange(len(found))[:, None], len(place), axis=1)
    total = np.zeros_like(at)
    for i in range(BLOCK):
        digit = place // len(_SYMBOLS) ** i % len(_SYMBOLS)
        total += cost[at, digit]
        at = one[at, digit]
    return Tables(np.array(queue), one, cost, at, total, edits)


# Behind the last row: nothing to do, or the answers that are still owed.
_LAST = (0, 2 * INSERT, INSERT, 0)


def solve(symbols: bytes) -> tuple[int, list[tuple[str, int]], str]:
    """Least cost; the edits up to and with each row and the state before them; the edits at the end.

    Whole blocks are looked up from the last to the first, so each boundary has its vector of costs
    to go. Tracing then goes forward: a block's inner vectors are expanded backward from the one
    behind it, and the ASCII-least edit that keeps the cost is the table's.
    """
    t = tables()
    code = _CODE[np.frombuffer(symbols, np.uint8)]
    n = len(code) // BLOCK
    weights = len(_SYMBOLS) ** np.arange(BLOCK)[::-1]
    blocks = (code[:n * BLOCK].reshape(n, BLOCK) @ weights).tolist()
    at, cost = 0, 0
    tail = code[n * BLOCK:].tolist()
    for s in reversed(tail):
        cost += int(t.row_costs[at, s])
        at = int(t.rows[at, s])
    behind = [0] * (n + 1)
    behind[n] = at
    for i in range(n - 1, -1, -1):
        cost += int(t.block_costs[at, blocks[i]])
        at = int(t.blocks[at, blocks[i]])
        behind[i] = at
    cost += int(t.vectors[at, 0])
    steps, state = [], 0
    code = code.tolist()
    for i in range(n + 1):
        part = code[i * BLOCK:(i + 1) * BLOCK]
        inner = [behind[i + 1] if i < n else 0]
        for s in reversed(part[1:]):
            inner.append(int(t.rows[inner[-1], s]))
        for s, vector in zip(part, reversed(inner)):
            letters, to = t.edits[vector][s][state]
            steps.append((letters, state))
            state = to
    return cost, steps, "I" * (_LAST[state] // INSERT)


@lru_cache(1 << 14)
def _solve_short(symbols: bytes):
    return solve(symbols)


def lines(steps: list[tuple[str, int]], end: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The repaired rows of a stretch as role and text."""
    out = []
    for (letters, state), role, text in zip(steps, roles, texts):
        for letter in letters:
            if letter == "D":
                continue
            if letter == "K":
                out.append((role, text))
                state = _NEXT[state, role[:1]]
                continue
            state = _AFTER[state]
            out.append((_NAME[state], "" if letter == "I" else text))
    if end:
        # What is owed is an answer, with the question before it where there are two.
        out += [(_NAME[s], "") for s in (_USER, _ASSISTANT)[-len(end):]]
    return out


_NAME = {_USER: "user", _ASSISTANT: "assistant"}


def illegal_pairs(initials: bytes) -> int:
    return sum(initials[i:i + 2] not in PAIRS for i in range(len(initials) - 1))


class Repair(NamedTuple):
    #: One row per conversation: faults, ``illegal``, ``gaps``, ``cost``, ``audit``, ``repaired_sha256``.
    report: DataFrame
    #: The repaired conversations: ``conv_id, place, role, text``; places ascend, with holes.
    rows: DataFrame


def repair(conversations: DataFrame, slice_rows: int = ROWS) -> Repair:
    """Find the faults of conversations and the cheapest edits that make them well formed.

    ``conversations`` has ``conv_id`` and ``turn`` (cast to long), ``role`` and ``text``; other
    columns are not read. Rows are taken by turn, nulls first, then role and text;
    null roles and texts count as one space, a null id is a conversation of its own. A row that has no
    character but white space is blank, one whose role and text came earlier a duplicate; both are
    deleted. One that does not end in ``.!?`` is truncated. The edits are letters: Keep, Rerole,
    Delete, Insert; of equally cheap ones the ASCII-least are taken. ``gaps`` counts the turn numbers
    left out between the least and the greatest one, null where that is no long.

    Rows are sorted by range of conversation and turn. A task repairs every conversation that lies
    inside its range; one that a range edge cuts, or that has more than ``slice_rows`` rows, goes on as
    slices: one letter per row meets in a task, as in the ``audit`` that a row must hold anyway, and
    the slices' texts are hashed one after the other. Equal rows of one turn are one counted row
    until then. An empty table gives empty results.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    merged = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumns({
        "h": F.xxhash64("text"), "h2": F.xxhash64("role", F.lit(0), "text")})
    first = merged.groupBy(F.col("conv_id").alias("_c"), F.col("h").alias("_1"), F.col("h2").alias("_2")).agg(
        F.min(F.struct("turn")).alias("_first"))
    stripped = F.rtrim(F.col("text"), F.lit(SPACE))
    start = F.substring("role", 1, 1)
    merged = written(
        keyed_join(merged, first, {"conv_id": "_c", "h": "_1", "h2": "_2"}).select(
            "conv_id", "turn", "role", "text", "n",
            (F.struct("turn") == F.col("_first")).alias("new"), (stripped == "").alias("blank"),
            (~F.substring(stripped, -1, 1).isin(*ENDS)).alias("cut"),
            F.when(start.isin("s", "u", "a"), start).otherwise("o").alias("initial"),
        ), "turns")
    keep = ~F.col("blank") & F.col("new")
    symbol = F.when(~keep, "x").when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    # Ranges are cut by the first characters, so that no long text is drawn for the edges.
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64)]
    pieces = written(
        merged.withColumn("symbol", symbol).repartitionByRange(*order)
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text", "n", "symbol", "initial").mapInArrow(_repairs(slice_rows), _PIECE),
        "pieces", "zstd")
    whole = pieces.filter("whole").select(*_DONE, F.lit(None).cast("string").alias("repaired_sha256"))
    whole = whole.withColumn("repaired_sha256", F.sha2(_joined().cast("binary"), 256))
    cut, reports = _sliced(pieces.filter("not whole"))
    report = whole.select(*_REPORT).unionByName(reports)
    counts = merged.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - F.col("new").cast("int")).otherwise(0)).alias("duplicate"),
        F.sum((keep & F.col("cut")).cast("long")).alias("truncated"),
    ).groupBy(F.col("conv_id").alias("_c")).agg(
        F.coalesce(
            F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), 1 - F.count("turn")),
            F.when(F.count("turn") == 0, F.lit(0).cast("long"))).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    # One row per conversation on both sides.
    report = keyed_join(report, counts, {"conv_id": "_c"}).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    parts = pieces.filter("whole").select("conv_id", "place", "roles", "texts").unionByName(
        cut.select("conv_id", "place", "roles", "texts"))
    out = parts.select("conv_id", "place", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "line")).select(
        "conv_id", (F.col("place") * F.lit(1 << 14) + F.col("i")).alias("place"),
        F.col("line.roles").alias("role"), F.col("line.texts").alias("text"))
    return Repair(report, out)


_PIECE = ("conv_id long, place long, whole boolean, symbols binary, initials binary, roles array<string>, "
          "texts array<string>, cost long, illegal long, audit string")
_DONE = ["conv_id", "cost", "illegal", "audit", "roles", "texts"]
_REPORT = ["conv_id", "cost", "illegal", "audit", "repaired_sha256"]
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("place", pa.int64()), ("whole", pa.bool_()), ("symbols", pa.binary()),
    ("initials", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string())])


def _joined():
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    return F.array_join(lines, "\n")


def _repairs(slice_rows: int):
    """Sorted rows to repaired conversations, and to slices of those that may go on elsewhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 28
        out, weight, place = [], 0, 0

        def piece(conv, symbols, initials, roles, texts, whole):
            nonlocal place
            row = {"conv_id": conv, "place": base + place, "whole": whole}
            place += 1
            if not whole:
                return row | {"symbols": symbols, "initials": initials, "roles": roles, "texts": texts}
            cost, steps, end = (_solve_short if len(symbols) <= 64 else solve)(symbols)
            fixed = lines(steps, end, roles, texts)
            return row | {
                "roles": [r for r, _ in fixed], "texts": [t for _, t in fixed], "cost": cost,
                "illegal": illegal_pairs(initials), "audit": "".join(s for s, _ in steps) + end}

        # A partition's first and last conversation may have rows in another one.
        opened, conv = True, None
        started = False
        symbols, initials, roles, texts, size = bytearray(), bytearray(), [], [], 0

        def flushed(whole: bool):
            nonlocal weight, symbols, initials, roles, texts, size
            out.append(piece(conv, bytes(symbols), bytes(initials), roles, texts, whole))
            weight += size + 64 * len(roles)
            symbols, initials, roles, texts, size = bytearray(), bytearray(), [], [], 0

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "n", "symbol", "initial")]
            for own, role, text, n, symbol, initial in zip(*columns):
                if started and own != conv:
                    if roles or not opened:
                        flushed(not opened)
                    opened = False
                conv, started = own, True
                for i in range(n):
                    if len(roles) >= slice_rows or size >= CHARS:
                        flushed(False)
                        opened = True
                    symbols += b"x" if i else symbol.encode()
                    initials += initial.encode()
                    roles.append(role)
                    texts.append(text)
                    size += len(text)
                if weight >= CHARS:
                    yield pa.RecordBatch.from_pylist(out, _ARROW)
                    out, weight = [], 0
        if started and roles:
            flushed(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return run


def _sliced(slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired slices, and the reports of their conversations."""
    solved = written(
        slices.select("conv_id", "place", "symbols", "initials").groupBy("conv_id").applyInArrow(
            _solved, "place long, conv_id long, edits string, state int, final string, cost long, illegal long, audit string"),
        "solved", "zstd")
    plan = solved.select(F.col("place").alias("_p"), "edits", "state", "final")
    repaired = written(
        keyed_join(slices.select("conv_id", "place", "roles", "texts"), plan, {"place": "_p"}).mapInArrow(
            _applied, "conv_id long, place long, roles array<string>, texts array<string>"),
        "repaired", "zstd")
    digests = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(
        _digests, "_c long, repaired_sha256 string")
    reports = keyed_join(solved.filter("audit IS NOT NULL"), digests, {"conv_id": "_c"}).select(*_REPORT)
    return repaired, reports


def _solved(group: pa.Table) -> pa.Table:
    """A whole conversation's edits, dealt out to its slices; the first also has the totals."""
    rows = sorted(group.to_pylist(), key=lambda r: r["place"])
    cost, steps, end = solve(b"".join(r["symbols"] for r in rows))
    out, at = [], 0
    for i, r in enumerate(rows):
        part = steps[at:at + len(r["symbols"])]
        at += len(part)
        out.append({"place": r["place"], "conv_id": r["conv_id"], "edits": "".join(s for s, _ in part),
                    "state": part[0][1], "final": end if i == len(rows) - 1 else ""})
    out[0] |= {"cost": cost, "illegal": illegal_pairs(b"".join(r["initials"] for r in rows)),
               "audit": "".join(s for s, _ in steps) + end}
    return pa.Table.from_pylist(out, pa.schema([
        ("place", pa.int64()), ("conv_id", pa.int64()), ("edits", pa.string()), ("state", pa.int32()),
        ("final", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string())]))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            steps, state, letters = [], r["state"], ""
            own = iter(r["roles"])
            for letter in r["edits"]:
                letters += letter
                if letter != "I":
                    role = next(own)
                    steps.append((letters, state))
                    state = _after(letters, state, role)
                    letters = ""
            fixed = lines(steps, r["final"], r["roles"], r["texts"])
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": r["conv_id"], "place": r["place"], "roles": [x for x, _ in fixed],
                  "texts": [x for _, x in fixed]}],
                pa.schema([_ARROW.field(c) for c in ("conv_id", "place", "roles", "texts")]))


def _after(letters: str, state: int, role: str) -> int:
    for letter in letters:
        state = state if letter == "D" else _NEXT[state, role[:1]] if letter == "K" else _AFTER[state]
    return state


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The running digest of sorted slices; only one slice is held at a time."""
    def pieces():
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    for conv, rows in groupby(pieces(), key=lambda r: r["conv_id"]):
        digest, glue = hashlib.sha256(), ""
        for r in rows:
            text = "\n".join(f"{role}:{t}" for role, t in zip(r["roles"], r["texts"]))
            if r["roles"]:
                digest.update((glue + text).encode())
                glue = "\n"
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([digest.hexdigest()])], names=["_c", "repaired_sha256"])


#: Fixed values of the damage, by ``crc32(conv_id:turn) % DEALS``.
DEALS, DROP, EMPTY, UNEND, REPEAT, AS_USER = 20, 0, 1, 2, 3, 4


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given to the user, by the checksum of id and turn.

    Nulls count as one space, apart from those of ``conv_id`` and ``turn`` in the result.
    """
    def named(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    deal = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % DEALS
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", deal.alias("deal"),
        F.when(deal == AS_USER, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(deal == EMPTY, "").when(deal == UNEND, F.translate(text, "".join(ENDS), "")).otherwise(text).alias("text"),
    ).filter(F.col("deal") != DROP)
    copies = F.when(F.col("deal") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_i", F.explode(copies)).select("conv_id", "turn", "role", "text")


def audit_damaged(conversations: DataFrame) -> DataFrame:
    """The report on damaged conversations for every original id; those left without rows have zeros."""
    report = repair(damaged(conversations)).report
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    report = report.withColumnRenamed("conv_id", "_c")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256().hexdigest()
    return keyed_join(ids, report, {"conv_id": "_c"}, "left").select(
        "conv_id", *[F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in names],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
