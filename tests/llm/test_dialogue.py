"""Repair of conversations against an enumeration of edits and a plain program."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from corpusloom.llm import dialogue as D
from corpusloom.llm.common import table
from tests.conftest import DATA

WANTED = re.compile(r"(s?(ua)+)?")


def cheapest(symbols):
    """(cost, audit) by trying all edits with three insertions at most."""
    choices = ["D" if s == "x" else "DKR" for s in symbols]
    best = None
    for letters in itertools.product(*choices):
        for extra in range(4):
            for places in itertools.combinations_with_replacement(range(len(symbols) + 1), extra):
                audit = "".join("I" * places.count(i) + letters[i] for i in range(len(symbols))) + "I" * places.count(len(symbols))
                free = [c for c in audit if c != "D"]
                for roles in itertools.product("ua", repeat=sum(c in "RI" for c in free)):
                    given, left = iter(roles), iter([s.lower() for s, c in zip(symbols, letters, strict=True) if c == "K"])
                    if WANTED.fullmatch("".join(next(left) if c == "K" else next(given) for c in free)):
                        cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[c] for c in audit) + 5 * sum(s.isupper() and c != "D" for s, c in zip(symbols, letters, strict=True))
                        if best is None or (cost, audit) < best:
                            best = cost, audit
    return best


def test_cheapest_edits():
    r = random.Random(1)
    grammar = D.Grammar(["ua", "au", "x" + "s", chr(D.BASE) + "u", "ss", "Ua"])
    plain = D.Grammar()
    cases = ["", *D.SYMBOLS, *(a + b for a in D.SYMBOLS for b in D.SYMBOLS), *("".join(r.choices(D.SYMBOLS, k=r.randint(3, 4))) for _ in range(60))]
    for symbols in cases:
        want = cheapest(symbols)
        assert grammar.solve(symbols) == want == plain.solve(symbols), symbols


def test_rules_change_nothing_over_long_conversations(spark):
    r = random.Random(2)
    sequences = ["".join(r.choices(["ua", "ua", "u", "A", "x", "suaU"], k=r.randint(0, 60))) for _ in range(60)] + ["u" * 5000, "ua" * 3000 + "s" + "ua" * 3000]
    grammar = D.grammar_of(spark.createDataFrame([(s,) for s in sequences], "symbols string"), per_round=8)
    plain = D.Grammar()
    assert len(grammar.rules) > 30 and sum(len(grammar.packed(s)) for s in sequences) < 0.4 * sum(map(len, sequences))
    for s in sequences:
        assert grammar.solve(s) == plain.solve(s)


def test_ropes():
    r = random.Random(3)
    for _ in range(300):
        texts = ["".join(r.choices("DK", k=r.randint(0, 12))) for _ in range(2)]
        ropes = []
        for t in texts:
            parts = [D.LETTERS[c] for c in t] or [D.EMPTY]
            while len(parts) > 1:
                i = r.randrange(len(parts) - 1)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            ropes.append(parts[0])
        assert list(map(str, ropes)) == texts and (ropes[0] < ropes[1]) == (texts[0] < texts[1])


def by_hand(rows):
    """The contract by a plain program, row by row; the cheapest edits by a program over states."""
    convs = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        convs[conv] += [(turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    out = []
    for conv, own in convs.items():
        key = lambda x: hashlib.md5(f"{'true' if conv is None else 'false'}{'' if conv is None else conv}:{len(x[1])}:{x[1]}{x[2]}".encode()).digest()  # noqa: B023, E731
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], key(x)))  # noqa: B023
        seen, faults = set(), []
        for _, role, text in own:
            strip = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not strip else "d" if (role, text) in seen else "t" if strip[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        states = {0: (0, "", ())}

        def better(found, state, cost, audit, lines):
            if state not in found or (cost, audit) < found[state][:2]:
                found[state] = cost, audit, lines

        def with_inserts(found):
            for _ in range(3):
                for s, (cost, audit, lines) in list(found.items()):
                    better(found, 3 if s == 2 else 2, cost + 5, audit + "I", (*lines, "assistant:" if s == 2 else "user:"))
            return found

        for (_, role, text), fault in zip(own, faults, strict=True):
            after = {}
            for s, (cost, audit, lines) in with_inserts(states).items():
                better(after, s, cost + 2, audit + "D", lines)
                if fault in ("", "t"):
                    more = 5 if fault else 0
                    to = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(role[:1])
                    if to:
                        better(after, to, cost + more, audit + "K", (*lines, f"{role}:{text}"))
                    better(after, 3 if s == 2 else 2, cost + more + 1, audit + "R", (*lines, f"{'assistant' if s == 2 else 'user'}:{text}"))
            states = after
        cost, audit, lines = min(v for s, v in with_inserts(states).items() if s in (0, 3))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "text string, turn long, role string, conv_id long, conv string, key string, copies string, symbols string, figures string"


def frame(spark, rows):
    return spark.createDataFrame([(text, turn, role, conv, *"abcde") for conv, turn, role, text in rows], SCHEMA)


def generated(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No", "", " \n", "Why? ", "a" * 9000 + ".", "é ?", None, "Yes.", "ok!\t"]
    return [(r.choice([None, 1, 2, 3, 40, 41]), r.choice([None, *range(12)]), r.choice(["user", "assistant", "system", "tool", "", None, "usher"]), r.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("rows", [[], generated(1, 60), generated(2, 300), [(7, t, "user" if t % 2 else "assistant", f"{t % 9}.") for t in range(400)]])
def test_repair(spark, rows):
    """Nulls everywhere, ties, repeated rows, blank and long texts, one conversation with nearly all rows."""
    got = D.repair(D.damaged(frame(spark, rows).repartition(3)))
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows)


def test_a_conversation_without_rows(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = D.repair(D.damaged(frame(spark, [(conv, 0, "user", "x")]))).first()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_rows_after_the_edits(spark):
    """The operator's own output: rows with their edits, in a form that is wanted."""
    rows = generated(3, 200)
    whole = D.repair(D.damaged(frame(spark, rows)), whole=True).collect()
    want = {c[0]: c for c in by_hand(rows)}
    for conv, figures in want.items():
        own = sorted((r["place"], r["edit"], r["role"], r["text"]) for r in whole if r["conv"] == conv)
        assert WANTED.fullmatch("".join(r[2][0] for r in own)) and [r[1] for r in own] == [c for c in figures[7] if c != "D"]
        assert hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in own).encode()).hexdigest() == figures[8]


def test_whole_table(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, DATA, "conversations").collect()]
    assert sorted(map(tuple, D.op13_conversation_repair(spark, DATA).collect()), key=repr) == by_hand(rows)
