"""Repair of conversations against a plain search over the grammar's states and against all edit strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from pagelake.llm import turns

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"B": "su", "S": "u", "A": "a", "E": "u"}
AFTER = {("B", "s"): "S", ("B", "u"): "A", ("S", "u"): "A", ("A", "a"): "E", ("E", "u"): "A"}


def by_states(codes):
    """(cost, audit) of the cheapest repair, row by row over (cost, audit) of every state."""
    best = {"B": (0, "")}

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                for symbol in NEXT[state]:
                    if symbol != "s":
                        to, way = AFTER[state, symbol], (cost + 3, audit + "I")
                        best[to] = min(best.get(to, way), way)
        return best

    for code in codes:
        new = {}
        for state, (cost, audit) in inserted(best).items():
            ways = [(state, cost + 4, "D")]
            if code != "x":
                more = 3 if code.isupper() else 0
                for symbol in NEXT[state]:
                    if symbol == code.lower():
                        ways.append((AFTER[state, symbol], cost + more, "K"))
                    elif symbol != "s":
                        ways.append((AFTER[state, symbol], cost + 3 + more, "R"))
            for to, c, edit in ways:
                new[to] = min(new.get(to, (c, audit + edit)), (c, audit + edit))
        best = new
    return min(way for state, way in inserted(best).items() if state in "BE")


def by_strings(codes):
    """The same by trying all edit strings of at most three inserts."""
    found = []
    for inserts in range(4):
        for places in itertools.combinations(range(len(codes) + inserts), inserts):
            for edits in itertools.product("DKR", repeat=len(codes)):
                audit, rest = [], list(edits)
                audit = ["I" if k in places else rest.pop(0) for k in range(len(codes) + inserts)]
                for roles in itertools.product("ua", repeat=sum(e in "IR" for e in audit)):
                    cost, i, out, fresh = 0, 0, "", list(roles)
                    for edit in audit:
                        code = codes[i] if edit != "I" else ""
                        cost += {"D": 4, "K": 0, "R": 3, "I": 3}[edit] + (3 if code.isupper() and edit != "D" else 0)
                        if code == "x" and edit != "D":
                            cost = 10**6
                        out += "" if edit == "D" else code.lower() if edit == "K" else fresh.pop(0)
                        i += edit != "I"
                    if cost < 10**6 and re.fullmatch("(s?(ua)+)?", out):
                        found.append((cost, "".join(audit)))
    return min(found)


@pytest.mark.parametrize("codes", ["", *map("".join, itertools.product("suoUx", repeat=1)), "ux", "ua", "Uo", "aS", "su", "sUa", "uxu", "ooo", "aua", "suu"])
def test_all_edit_strings(codes):
    assert turns.cheapest(codes, "B", closed=True)["*"] == by_strings(codes) == by_states(codes)


def test_states_and_targets_agree():
    rng = random.Random(1)
    for _ in range(1500):
        codes = "".join(rng.choice("suaoUASOx" if rng.random() < 0.6 else "uaua") for _ in range(rng.randrange(14)))
        assert turns.cheapest(codes, "B", closed=True)["*"] == by_states(codes), codes


def test_tables_of_blocks_compose():
    rng = random.Random(2)
    for _ in range(150):
        codes = "".join(rng.choice("suaoUASOxxuaua") for _ in range(rng.randrange(1, 24)))
        cuts = sorted({0, len(codes), *[rng.randrange(len(codes)) for _ in range(4)]})
        blocks = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        tables = [turns.table(b) for b in blocks]
        half = len(tables) // 2
        pair = [turns.composed(t) for t in (tables[:half], tables[half:]) if t]
        top = turns.closed_way(pair)
        path = [top[0]]
        for children, (s, t) in zip([t for t in (tables[:half], tables[half:]) if t], zip(top, top[1:])):
            path += turns.way_through(children, s, t)[1][1:]
        ways = [turns.cheapest(b, turns.STATES[s], closed=False)[turns.STATES[t]] for b, s, t in zip(blocks, path, path[1:])]
        end = turns.CLOSING[turns.STATES[path[-1]]]
        assert (sum(c for c, _ in ways) + 3 * len(end), "".join(a for _, a in ways) + end) == by_states(codes), codes


def plain(original, damaged):
    """One row for every id, conversations one by one."""
    out = []
    for conv in {r[0] for r in original}:
        rows = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", 0))
        said = [(r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in rows]
        numbers = [r[1] for r in rows if r[1] is not None]
        marks, codes, seen = [], "", set()
        for role, text in said:
            shown = text.translate({ord(c): None for c in SPACE})
            mark = "b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "-"
            seen.add((role, text))
            marks.append(mark)
            first = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if mark in "bd" else first.upper() if mark == "t" else first
        cost, audit = by_states(codes)
        state, i, lines = "B", 0, []
        for edit in audit:
            if edit == "D":
                i += 1
                continue
            symbol = "s" if state == "B" and edit == "K" and codes[i] in "sS" else NEXT[state][-1]
            state = AFTER[state, symbol]
            role = {"u": "user", "a": "assistant"}.get(symbol)
            lines.append(f"{role}:" if edit == "I" else f"{said[i][0] if edit == 'K' else role}:{said[i][1]}")
            i += edit != "I"
        firsts = [r[:1] for r, _ in said]
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, marks.count("b"), marks.count("d"), marks.count("t"), bad, cost, audit, digest))
    return sorted(out, key=repr)


def table(spark, rows):
    full = [(c, t, r, x, 7, "k", 1) for c, t, r, x in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, at long, c string, part long")


def check(spark, rows, **how):
    df = table(spark, rows)
    got = sorted((tuple(r) for r in turns.repaired_digests(df, df, **how).collect()), key=repr)
    assert got == plain(rows, rows)


def conversations(n, longest, seed=0):
    rng, rows = random.Random(seed), []
    for c in range(n):
        turn = 0
        for k in range(rng.randrange(1, longest)):
            turn += rng.choice([1, 1, 1, 2])
            role = rng.choice(["user", "assistant"][k % 2 : k % 2 + 1] * 6 + ["system", "user", "assistant", "tool", ""])
            rows.append((c, turn, role, rng.choice([f"text {k}.", f"words {k}!", "same words.", f"cut {k}", "", " \n"])))
    return rows


def test_conversations_one_by_one(spark):
    check(spark, conversations(60, 9))


@pytest.mark.parametrize(("block", "fan"), [(2, 2), (5, 3), (64, 1024)])
def test_long_conversations_in_blocks(spark, block, fan):
    check(spark, [*conversations(6, 40, seed=3), *[(99, k, "user" if k % 3 else "assistant", f"t{k}.") for k in range(150)]], block=block, fan=fan)


def test_odd_rows(spark):
    long = "w " * 50000 + "."
    rows = [
        (None, 1, "user", "a."), (None, 2, "assistant", "b."), (1, None, "user", "x."), (1, None, None, None), (2, 5, "user", long), (2, 5, "user", long),
        (3, 1, "user", "é漢😀。"), (3, 2, "assistant", "b? "), (4, 1, None, "x."), (5, 3, "system", "only system."), (6, 1, "", "no role."),
        (7, 1, "user", "q?"), (7, 1, "assistant", "r."), (7, 1, "user", "q?"),
    ]
    check(spark, rows)
    assert turns.repaired_digests(table(spark, []), table(spark, [])).collect() == []


def test_ids_without_rows_are_returned(spark):
    df = table(spark, [(1, 1, "user", "a."), (2, 1, "user", "a.")])
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.repaired_digests(df.where("conv_id = 1"), df).collect()}
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in [None, *range(5)]] + [(None, None, None, None), (3, 9, None, "é.")]
    want = []
    for c, t, role, text in rows:
        shown = [" " if v is None else str(v) for v in (c, t, role, text)]
        fault = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        if fault:
            said = "" if fault == 1 else re.sub("[.!?]", "", shown[3]) if fault == 2 else shown[3]
            want += [(c, t, "user" if fault == 4 else shown[2], said)] * (2 if fault == 3 else 1)
    got = [tuple(r) for r in turns.damage(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    damaged = turns.damage(table(spark, rows))
    found = sorted((tuple(r) for r in turns.repaired_digests(damaged, table(spark, rows)).collect()), key=repr)
    assert found == plain(rows, want)
