"""Repairs against exhaustive search, over cut conversations, with colliding hashes, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from offerlens.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, row long, fault int, audit string"


def _every(rows):
    """All (cost, audit, roles) of edits with at most two turns inserted in a place, by brute force."""
    inserts = [(2 * n, "I" * n, "".join(x)) for n in range(3) for x in itertools.product("ua", repeat=n)]
    choices = []
    for initial, fault in rows:
        own = [(3, "D", "")]
        if fault in (repair.SOUND, repair.CUT):
            more = fault == repair.CUT
            own += [(more, "K", initial), (2 + more, "R", "u"), (2 + more, "R", "a")]
        choices += [inserts, own]
    for combination in itertools.product(*choices, inserts):
        roles = "".join(c[2] for c in combination)
        if re.fullmatch(r"(s?(ua)+)?", roles):
            yield sum(c[0] for c in combination), "".join(c[1] for c in combination)


def _run(rows):
    program = repair.Repair()
    for row in rows:
        program.row(*row)
    return program.end()


def test_cheapest_audits():
    rng = random.Random(1)
    runs = [rows for n in range(2) for rows in itertools.product(itertools.product("suat", range(4)), repeat=n)]
    runs += [tuple((rng.choice("suuaat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(2, 3))) for _ in range(150)]
    for rows in runs:
        assert _run(rows) == min(_every(rows)), rows


@pytest.mark.parametrize("mask", [(1 << 61) - 1, 1, 7])
def test_pieces_and_colliding_hashes(monkeypatch, mask):
    """Any cut of a run gives the audit of the whole, also if nearly all hashes collide."""
    monkeypatch.setattr(repair, "_MASK", mask)
    rng = random.Random(mask)
    for _ in range(60):
        rows = [(rng.choice("suuaa"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 60))]
        want, best = _run(rows), {0: (0, "")}
        for initial, fault in rows:  # the same program over plain strings
            for _ in range(2):
                for s, (c, a) in list(best.items()):
                    t, new = repair.NEXT[s][repair.FILLED[s]], (c + 2, a + "I")
                    best[t] = min(new, best.get(t, new))
            after = {}
            for s, (c, a) in best.items():
                moves = [(s, c + 3, "D")]
                if fault in (0, 3):
                    more = fault == 3
                    moves += [(repair.NEXT[s][repair.FILLED[s]], c + 2 + more, "R")] + ([(repair.NEXT[s][initial], c + more, "K")] if initial in repair.NEXT[s] else [])
                for t, cost, edit in moves:
                    after[t] = min((cost, a + edit), after.get(t, (cost, a + edit)))
            best = after
        assert want == repair.joined([[(0, t, c, a) for t, (c, a) in best.items()]])
        cuts = sorted({0, len(rows), *(rng.randint(0, len(rows)) for _ in range(4))})
        pieces = [[e for begin in range(4) for e in repair._run(rows[a:b], begin).piece(begin)] for a, b in zip(cuts, cuts[1:])]
        assert repair.joined(pieces) == want


def test_shared_beginnings():
    rng, audits = random.Random(2), repair.Audits()
    nodes = {0: ""}
    for _ in range(1500):
        node = rng.choice(list(nodes)[-40:])
        letter = rng.choice("DIKR")
        nodes[audits.longer(node, letter)] = nodes[node] + letter
    for node, text in nodes.items():
        assert audits.text(node) == text and nodes[audits.ancestor(node, len(text) // 3)] == text[: len(text) // 3]
    for a, b in (rng.sample(list(nodes), 2) for _ in range(4000)):
        assert audits.less(a, b) == (nodes[a] < nodes[b])


def _plain(rows):
    """The contract for (conv_id, turn, role, text) rows without equal turns but for repeats."""
    found = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            found[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        cost, audit = _run([(r[1][:1], f) for r, f in zip(own, faults)])
        turns = [r[0] for r in own if r[0] is not None]
        left, fixed, state = iter(own), [], 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(left)[1:]
            if edit != "D":
                role = role if edit == "K" else repair.ROLES[repair.FILLED[state]]
                state = repair.NEXT[state][role[0]]
                fixed.append(f"{role}:{text}")
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in fixed))
        yield (
            conv,
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(k) for k in (1, 2, 3)),
            sum(a[1][:1] + b[1][:1] not in repair.LEGAL for a, b in zip(own, own[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(fixed).encode()).hexdigest(),
        )


def _same(spark, rows):
    frame = spark.createDataFrame([(*r, "c", 7, 2, "a") for r in rows], SCHEMA)
    got = [tuple(r) for r in repair.repairs(frame).collect()]
    assert sorted(got, key=repr) == sorted(_plain(rows), key=repr)
    return got


def test_long_conversations_over_many_ranges(spark):
    rng = random.Random(4)
    say = lambda: rng.choice(["Yes.", "No!", "what", "So it is. ", "", "Well, then?\n"]) + str(rng.randrange(40)) * rng.randrange(2) + rng.choice(["", "."])
    rows = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), say()) for t in range(2500)]
    rows += [(c, t, ["user", "assistant"][t % 2], say()) for c in range(2, 60) for t in range(rng.randint(1, 9))]
    rng.shuffle(rows)
    got = _same(spark, rows)
    assert max(len(r[7]) for r in got) > 2000


def test_odd_rows(spark):
    long = "word " * 300_000 + "end."
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello."), (None, None, None, None), (3, None, "user", "Lost."), (3, None, "user", "Lost."), (3, None, None, "x")]
    rows += [(4, 5, "user", long), (4, 6, "assistant", long), (4, 9, "user", long), (5, 1, "", ""), (5, 2, "", "Nobody."), (6, 1, "user", "Same."), (6, 1, "user", "Same."), (6, 2, "User", "\x1f"), (6, -7, "system", "é.\x85")]
    rows += [(7, 2**62, "user", "Far."), (7, 2**62 + 5, "assistant", "Away.")] + [(c, t, "user", "One.") for c in range(8, 40) for t in (0, 1)]
    got = _same(spark, rows)
    gone = [r for r in rows if zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20 == 0]
    assert gone
    only = _same(spark, [gone[0]])  # no row is left
    assert only == [(gone[0][0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] and len(got) == len({r[0] for r in rows})
    assert _same(spark, []) == []
