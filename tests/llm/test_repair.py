import hashlib
import itertools
import random
import re
import zlib

import pytest

from tabsift.llm.repair import BLOCK, audit_damaged, damaged, repair, solve, tables

FORM = re.compile(r"(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def apply(audit, rows):
    """The repaired rows of an audit; None where it is none of theirs. Roles follow from the place."""
    out, rows = [], iter(rows)
    for e in audit:
        if e == "I":
            out.append([None, ""])
            continue
        role, text, must, _ = next(rows)
        if must and e != "D":
            return None
        if e != "D":
            out.append([role if e == "K" else None, text])
    system = bool(out) and out[0][0] is not None and out[0][0][:1] == "s"
    for i, row in enumerate(out):
        row[0] = row[0] if row[0] is not None else "user" if i % 2 == system else "assistant"
    return out if FORM.fullmatch("".join(r[0][:1] or "-" for r in out)) else None


def all_audits(rows, most):
    """The best of all audits of at most ``most`` cost, by trying them."""
    best = None
    stack = [(0, "", 0)]
    while stack:
        cost, audit, i = stack.pop()
        if cost > most or best and (cost, audit) >= best and cost >= best[0] and i == len(rows):
            continue
        if i == len(rows) and apply(audit, rows) is not None:
            best = min(best, (cost, audit)) if best else (cost, audit)
        stack.append((cost + 2, audit + "I", i))
        if i < len(rows):
            cut = rows[i][3]
            stack += [(cost + 3, audit + "D", i + 1), (cost + cut, audit + "K", i + 1), (cost + 2 + cut, audit + "R", i + 1)]
    return best


def cheapest(rows):
    """The same by one step per row, states as texts of initials."""
    def put(states, key, value):
        if key not in states or value < states[key]:
            states[key] = value

    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(states):
        for _ in range(3):
            for q, (cost, audit) in list(states.items()):
                for c, to in after[q].items():
                    if c != "s":
                        put(states, to, (cost + 2, audit + "I"))
        return states

    states = inserted({"": (0, "")})
    for role, _, must, cut in rows:
        out = {}
        for q, (cost, audit) in states.items():
            put(out, q, (cost + 3, audit + "D"))
            if not must:
                if role[:1] in after[q]:
                    put(out, after[q][role[:1]], (cost + cut, audit + "K"))
                for c, to in after[q].items():
                    if c != "s":
                        put(out, to, (cost + 2 + cut, audit + "R"))
        states = inserted(out)
    return min(states[q] for q in ("", "a") if q in states)


def symbol(row):
    role, _, must, cut = row
    if must:
        return "x"
    c = role[:1] if role[:1] in "sua" and role else "o"
    return c.upper() if cut else c


KINDS = [("system", "t", False, 0), ("user", "t", False, 0), ("assistant", "t", False, 0), ("tool", "t", False, 0),
         ("user", "t", False, 1), ("assistant", "t", False, 1), ("user", "t", True, 0)]


@pytest.mark.parametrize("length", [0, 1, 2])
def test_tables_against_all_audits(length):
    for rows in itertools.product(KINDS, repeat=length):
        cost, steps, end = solve("".join(map(symbol, rows)).encode())
        assert (cost, "".join(s for s, _ in steps) + end) == all_audits(rows, cost) == cheapest(rows)


def test_tables_against_steps():
    r = random.Random(3)
    for _ in range(3000):
        rows = r.choices(KINDS, k=r.randint(0, 3 * BLOCK + 3))
        cost, steps, end = solve("".join(map(symbol, rows)).encode())
        audit = "".join(s for s, _ in steps) + end
        assert (cost, audit) == cheapest(rows) and apply(audit, rows) is not None


def test_tables_stay_small():
    t = tables()
    assert len(t.vectors) < 200 and t.blocks.shape == (len(t.vectors), 9 ** BLOCK)


def judged(rows):
    """Rows of one conversation in order, with their faults."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for turn, role, text in rows:
        body = text.rstrip(SPACES)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        out.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit = cheapest(out)
    text = "\n".join(f"{role}:{t}" for role, t in apply(audit, out))
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts,
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


def harm(rows):
    out = []
    for conv, turn, role, text in rows:
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if deal == 1:
            text = ""
        if deal == 2:
            text = re.sub("[.!?]", "", text)
        if deal == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if deal == 0 else 2 if deal == 3 else 1)
    return out


def conversations(seed=1):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(-3, 120)]:
        for turn in range(r.randint(1, 12)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "Sys", "u"])
            text = r.choice(["One.", "Two!", "three", "  \n", "", None, "four? \t", "x ", f"long {conv} {turn}."])
            rows.append((conv, r.choice([turn, turn + 2, None]) if r.random() < 0.2 else turn, role, text))
    rows += [(7, 3, "user", "same.")] * 30
    # One conversation with a third of all rows.
    rows += [(500, t // 2, r.choice(["user", "assistant"]), f"turn {t % 170}.") for t in range(400)]
    rows += [(501, None, "user", "a."), (501, None, None, None)]
    return rows


def table(spark, rows):
    return spark.createDataFrame(
        [(c, t, r, x, 1, "h") for c, t, r, x in rows],
        "conv_id long, turn long, role string, text string, symbol int, place string")


def by_conv(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(row)
    return out


@pytest.mark.parametrize("slice_rows", [4096, 3])
def test_repair_against_brute_force(spark, slice_rows):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in conversations()]
    got = repair(table(spark, conversations()), slice_rows=slice_rows)
    want = {conv: judged(own) for conv, own in by_conv(rows).items()}
    report = {r["conv_id"]: {k: r[k] for k in want[None]} for r in got.report.collect()}
    assert report == want
    lines = {}
    for r in got.rows.orderBy("place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, own in want.items():
        text = "\n".join(lines.get(conv, []))
        assert hashlib.sha256(text.encode()).hexdigest() == own["repaired_sha256"]


def test_audit_of_damaged_against_brute_force(spark):
    rows = conversations(2) + [(c, 0, "user", "Hi.") for c in range(1000, 1100)]
    left = by_conv(harm(rows))
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = judged(left.get(conv, []))
    got = {r["conv_id"]: {k: r[k] for k in want[None]} for r in audit_damaged(table(spark, rows)).collect()}
    assert got == want
    assert sorted(map(str, harm(rows))) == sorted(str(tuple(r)) for r in damaged(table(spark, rows)).collect())


def test_empty_table(spark):
    df = table(spark, conversations()).limit(0)
    assert audit_damaged(df).count() == 0
    got = repair(df)
    assert got.report.count() == 0 and got.rows.count() == 0
