import hashlib
import itertools
import random
import re
import zlib

import pytest

from paddock.llm import structure

GRAMMAR = re.compile("(s?(ua)+)?")


def text_of(value):
    return " " if value is None else str(value)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, _, role, text in turns:
        shown = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def output(audit, turns):
    """Repaired rows of an audit, None if it leads to no legal conversation."""
    size, rows, i = len(audit) - audit.count("D"), [], 0
    for letter in audit:
        role = ("user", "assistant")[(len(rows) - size % 2) % 2]
        if letter == "I":
            rows.append((role, ""))
        else:
            if letter != "D":
                rows.append((turns[i][2] if letter == "K" else role, turns[i][3]))
            i += 1
    if size % 2 and (not rows or not rows[0][0].startswith("s") or audit.replace("D", "")[0] != "K"):
        return None
    return rows if GRAMMAR.fullmatch("".join(r[0][:1] or "-" for r in rows)) else None


def cheapest(turns):
    found = faults(turns)
    best = (10**9, "", [])
    gaps = ["", "I", "II"]
    for letters in itertools.product(*["D" if f in ("blank", "duplicate") else "DKR" for f in found]):
        cost = sum({"D": 4, "K": 0, "R": 3}[c] + (3 if f == "truncated" and c != "D" else 0) for c, f in zip(letters, found))
        for added in itertools.product(gaps, repeat=len(turns) + 1):
            total = cost + 3 * len("".join(added))
            audit = added[0] + "".join(c + a for c, a in zip(letters, added[1:]))
            if (total, audit) < best[:2]:
                rows = output(audit, turns)
                if rows is not None:
                    best = (total, audit, rows)
    return best


def by_hand(rows):
    out = []
    for conv in {r[0] for r in rows}:
        key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
        turns = sorted((r for r in damaged(rows) if r[0] == conv), key=key)
        known = [r[1] for r in turns if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        found = faults(turns)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, mended = cheapest(turns) if turns else (0, "", [])
        whole = "\n".join(f"{role}:{text}" for role, text in mended)
        out.append((conv, gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture
def turns(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, position int")

    return make


def conversations(seed, count=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in sorted(rng.sample(range(7), rng.randint(1, 4))):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, turn, role, rng.choice(["Yes.", "No!", "and so", " \t", "", None, "Why?\n", "Yes."])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_equal_brute_force(turns, rows, seed):
    given = conversations(seed)
    given += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (500, None, "user", "a."), (500, None, None, None), (501, 3, "user", "same."), (501, 3, "user", "same."), (502, -2, "user", "é 漢字 🙂")]
    assert rows(structure.repair_damaged(turns(given))) == by_hand(given)


def test_conversation_that_loses_all_turns(turns, rows):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256().hexdigest()
    assert rows(structure.repair_damaged(turns([(conv, 0, "user", "Hi.")]))) == [(conv, 0, 0, 0, 0, 0, 0, "", empty)]


def test_empty_table(turns, rows):
    assert rows(structure.repair_damaged(turns([]))) == []


def test_long_conversation_equals_strings(monkeypatch, turns, rows):
    """The program against one that carries whole strings, over many turns and shared prefixes."""
    monkeypatch.setattr(structure, "REBASE", 16)
    rng = random.Random(3)
    for pattern in ("ua", "u", "uuaa", "a", "suax"):
        read = [(rng.choice(pattern), rng.random() < 0.1, rng.random() < 0.2) for _ in range(400)]
        repair = structure.Repair()
        best = {0: (0, "")}

        def insert(best):
            for _ in range(3):
                for s, t in ((0, 2), (1, 2), (3, 2), (2, 3)):
                    if s in best:
                        new = (best[s][0] + 3, best[s][1] + "I")
                        best[t] = min(best.get(t, new), new)

        insert(best)
        for initial, delete, cut in read:
            repair.read(initial, delete, cut)
            new = {}

            def offer(state, cost, audit):
                new[state] = min(new.get(state, (cost, audit)), (cost, audit))

            for s, (cost, audit) in best.items():
                offer(s, cost + 4, audit + "D")
                for t, want in ((1, "s"), (2, "u"), (3, "a")):
                    if not delete and (s, t) in {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}:
                        if initial == want:
                            offer(t, cost + 3 * cut, audit + "K")
                        if t > 1:
                            offer(t, cost + 3 + 3 * cut, audit + "R")
            insert(new)
            best = new
        assert repair.close() == min(best[s] for s in (0, 3) if s in best)
    long = [(1, i, "user", f"Turn {i}.") for i in range(3000)]
    found = structure.find_repairs(turns(long)).collect()[0]
    assert len(found.audit) >= 3000 and structure.apply_repairs(turns(long), structure.find_repairs(turns(long))).count() % 2 == 0


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(structure, "_PRIME", 1)  # every hash is zero
    audits, rng = structure.Audits(), random.Random(4)
    nodes = [0]
    for _ in range(300):
        nodes.append(audits.add(rng.choice(nodes[-8:]), rng.choice("DIKR")))
    for x, y in itertools.product(nodes[::7], nodes[::5]):
        assert audits.less(x, y) == (audits.text(x) < audits.text(y))
