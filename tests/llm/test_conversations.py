"""Conversation repair against plain dynamic programming over whole strings."""

import hashlib
import random
import re
import zlib

import pytest

from siftspark.llm import turns as C

WORD = re.compile(r"[^\x20\x09-\x0D]")


def best_edits(turns):
    """Cheapest edits, least first; suffix by suffix. ``turns``: (role, fault)."""
    after = {"u": "a", "a": "u", "s": "u", "": "u"}
    best = {q: (2 * len(t), t) for q, t in (("", ""), ("s", "II"), ("u", "I"), ("a", ""))}
    for role, fault in reversed(turns):
        now = {}
        for q in best:
            options, state = [], q
            for inserts in range(4):
                lead = (2 * inserts, "I" * inserts)
                moves = [("D", 3, state)]
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    ok = role[:1] if (role[:1] == "s" and state == "") or (role[:1] == "u" and state in ("", "s", "a")) or (role[:1] == "a" and state == "u") else None
                    moves += [("K", more, ok)] if ok else []
                    moves.append(("R", 2 + more, after[state]))
                options += [(lead[0] + c + best[s][0], lead[1] + a + best[s][1]) for a, c, s in moves]
                state = after[state]
            now[q] = min(options)
        best = now
    return best[""]


def plain(rows):
    """Rows (turn, role, text) of a conversation, in order -> the digest."""
    seen, faults = set(), []
    for _, role, text in rows:
        words = WORD.findall(text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    known = [t for t, _, _ in rows if t is not None]
    cost, audit = best_edits([(r, f) for (_, r, _), f in zip(rows, faults, strict=True)])
    out, state, row = [], "", iter(rows)
    for edit in audit:
        due = "assistant" if state == "u" else "user"
        if edit == "I":
            out.append(f"{due}:")
            state = due[0]
            continue
        _, role, text = next(row)
        if edit != "D":
            role = due if edit == "R" else role
            out.append(f"{role}:{text}")
            state = role[0]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in out))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def damaged(rows):
    """Rows (conv, turn, role, text) -> conversations after damage."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        mine += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def made():
    pick = random.Random(11)
    texts = ["Yes.", "No", "So? ", "\t", "", "a.b", "Ünder!", ".", "x ", "Well.\n", None, "one. two", "Hi!\x0b"]
    roles = ["user", "assistant", "user", "assistant", "system", "User", "", "tool", None, "u", "s"]
    rows = []
    for conv in range(150):
        turns = [t for t in range(pick.randrange(12)) for _ in range(1 + (pick.random() < 0.1))]
        rows += [(conv, t if pick.random() > 0.05 else None, (["user", "assistant"][t % 2] if pick.random() < 0.7 else pick.choice(roles)), pick.choice(texts) if pick.random() < 0.5 else f"Text {t}.") for t in turns]
    for conv, n in ((None, 200), (1000, 2600), (1001, 31), (1002, 32), (1003, 33), (1004, 65)):
        rows += [(conv, t * 2, ["user", "assistant"][t % 2] if pick.random() < 0.8 else pick.choice(roles), f"{pick.randrange(n)}." if pick.random() < 0.8 else pick.choice(texts)) for t in range(n)]
    return rows


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_auction_matches_dynamic_programming():
    pick = random.Random(1)
    faults = ["", "blank", "duplicate", "truncated"]
    for _ in range(1500):
        turns = [(pick.choice(["system", "user", "assistant", "x"]), pick.choice([0, 0, 0, 1, 2, 3])) for _ in range(pick.randrange(1, 14))]
        shape = "".join(C._LETTERS[4 * f + "suax".index(r[0])] for r, f in turns)
        audit, state = (x[0] for x in C._solved(shape, C._END, 1))
        arcs, price = C._lattice(shape, C._END)
        assert (C.auction(arcs, price, 0), audit + C._TAIL[state]) == best_edits([(r, faults[f]) for r, f in turns])
        # prices stay dual feasible for all arcs
        assert all(price[k] <= cost + price[to] for k, mine in enumerate(arcs) for _, cost, to in mine)


def test_costs_between_states():
    """Matrices of two halves multiply to that of the whole."""
    pick = random.Random(2)
    for _ in range(300):
        shape = "".join(pick.choice(C._LETTERS) for _ in range(pick.randrange(2, 12)))
        cut = pick.randrange(1, len(shape))
        assert C._product([C._matrix(shape[:cut]), C._matrix(shape[cut:])]) == list(C._matrix(shape))


@pytest.mark.parametrize("parts", [3, 7])
def test_brute_force(spark, parts):
    rows = made()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, pos string").repartition(parts)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in C.op11_conversation_repair(df).collect()}
    want = {c: plain(r) for c, r in damaged(rows).items()}
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_levels(spark, monkeypatch):
    """More levels of the trees than one, on one long conversation in many parts."""
    monkeypatch.setattr(C, "FAN", 3)
    monkeypatch.setattr(C, "TURNS", 4)
    pick = random.Random(4)
    rows = [(7, t, pick.choice(["user", "assistant", "system"]), pick.choice(["a.", "b", "", f"{t}!"])) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = C.digest(df).collect()
    assert tuple(got[c] for c in COLUMNS) == plain([r[1:] for r in rows])


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello?"), (2, None, None, "x."), (2, 4, "assistant", "y"), (3, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = [tuple(r) for r in C.repair(df).orderBy("conv_id", "at").collect()]
    assert got == [(1, 0, 0, "K", "user", "Hi."), (1, 1, 1, "R", "assistant", "Hello?"), (2, 0, None, "R", "user", "x."), (2, 1, 4, "K", "assistant", "y")]


def test_long_text_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "a. " * 700_000)], "conv_id long, turn long, role string, text string")
    (got,) = C.digest(df).collect()
    assert (got.audit, got.cost, got.truncated) == ("KI", 2, 0)
    assert C.op11_conversation_repair(df.limit(0)).count() == 0
    nobody = C.digest(df.limit(0), df).collect()
    assert [tuple(r) for r in nobody] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_sql(spark):
    import duckdb
    import pandas as pd

    rows = [r for r in made() if r[0] is None or r[0] < 1000]
    con = duckdb.connect()
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", table)
    want = {r[0]: r[1:] for r in con.sql(C.OP11_SQL).fetchall()}
    assert want == {c: plain(r) for c, r in damaged(rows).items()}
