import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from webloom.llm import conversation_repair as repair

ROLES = {"u": "user", "a": "assistant"}
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        mine = out.setdefault(conv, [])
        mine += [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def brute(rows):
    """What a conversation's damaged rows should give: a search over all edits, by cost and then by their letters."""
    kinds, seen = [], set()
    for _, role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, best, done = [(0, "", 0, "", ())], None, set()
    while queue:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            best = cost, audit, lines
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for initial, role in ROLES.items():
            if (state, initial) in AFTER:
                heapq.heappush(queue, (cost + 5, audit + "I", i, AFTER[state, initial], (*lines, f"{role}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state, lines))
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 * (kinds[i] == "truncated")
                if not role or (state, role[0]) in AFTER:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, AFTER[state, role[0]] if role else state, (*lines, f"{role}:{text}")))
                for initial, new in ROLES.items():
                    if (state, initial) in AFTER:
                        heapq.heappush(queue, (cost + more + 1, audit + "R", i + 1, AFTER[state, initial], (*lines, f"{new}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def made(n, longest, seed):
    rng = random.Random(seed)
    texts = ["Hi.", "Hi.", "ok", "What?", "", " \t", "No end", "Yes! \n", "x.y", "É…", None, "Fine.", "One.", "Two!", "Three?"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "sys"]
    rows = []
    for c in range(n):
        turn = 0
        for _ in range(rng.randrange(longest)):
            turn += rng.choice([0, 1, 1, 1, 1, 2, 3])
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((c, turn if rng.random() < 0.95 else None, role, rng.choice(texts) if rng.random() < 0.5 else f"Turn {rng.randrange(40)}."))
    return rows


def test_automaton_equals_search():
    repairer, rng = repair.Repairer(), random.Random(2)
    for rows in damage(made(700, 14, 3)).values():
        assert repair._whole(repairer, *map(list, zip(*rows, strict=True)) if rows else ([], [], [])) == brute(rows)
    assert len(repairer.vectors) < 200 and rng


@pytest.mark.parametrize("limits", [{}, {"hot_turns": 7}, {"hot_turns": 2, "hot_chars": 10}])
def test_repair(spark, limits):
    rows = made(40, 12, 4) + [(None, t, "user", f"Null {t % 3}.") for t in range(9)] + [(500 + t, t, "user", "Only.") for t in range(60)]
    rows += [(900, 1, "user", "Same.")] * 30 + [(901, t, ("user", "assistant")[t % 2], "Same.") for t in range(25)] + [(902, None, "system", "No turn.")] * 3
    table = spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id long, turn long, role string, text string, conv string, n int")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(table, **limits).collect()}
    want = {c: brute(v) for c, v in damage(rows).items()}
    assert got == want
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in want.values())


def test_long_conversation_in_blocks(spark):
    rng = random.Random(8)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "assistant", "system", "x"]), rng.choice(["A.", "b", "C!", "", f"{t}.", f"{t}?"])) for t in range(3000)]
    rows += [(1, 5000, "user", "x" * 300_000 + "."), (2, 0, "user", "Short.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(table, hot_turns=200).collect()}
    assert got == {c: brute(v) for c, v in damage(rows).items()}


def test_undamaged_and_empty(spark):
    rows = [(1, 0, "system", "Be good."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hi!"), (2, 0, "assistant", "Cut")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.cost, r.audit) for r in repair.repair(table, hurt=False).collect()}
    assert got == {1: (0, "KKK"), 2: (2, "D")}
    assert repair.repair(table.limit(0)).collect() == []
