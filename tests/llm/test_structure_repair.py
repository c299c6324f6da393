"""Conversation repair against an exhaustive search."""

from __future__ import annotations

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from lagline.llm import queries, structure_repair
from lagline.llm.structure_repair import AT_END, MUST_GO, Tables, before_turn, last_letters

WHITE = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """(cost, edits, repaired turns) by trying every edit in every state of the automaton, keeping the least (cost, letters)."""
    # state: roles so far matter only as none / s / ...u / ...a
    def after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    best = {"": (0, "", ())}

    def insertions(best):
        for _ in range(4):
            for state, (cost, letters, out) in list(best.items()):
                for role in ("user", "assistant"):
                    to = after(state, role[0])
                    new = (cost + 2, letters + "I", (*out, (role, "")))
                    if to and (to not in best or new < best[to]):
                        best[to] = new
        return best

    for role, text, must_go, truncated in turns:
        # All insertion counts are tried: at most four in a row can be of use.
        best, now = insertions(best), {}
        for state, (cost, letters, out) in best.items():
            ways = [(state, 3, "D", out)]
            if not must_go:
                ways += [(after(state, role[:1]), truncated, "K", (*out, (role, text)))]
                ways += [(after(state, r[0]), 2 + truncated, "R", (*out, (r, text))) for r in ("user", "assistant")]
            for to, extra, letter, new_out in ways:
                new = (cost + extra, letters + letter, new_out)
                if to is not None and (to not in now or new < now[to]):
                    now[to] = new
        best = now
    return min(insertions(best)[s] for s in ("", "a") if s in insertions(best))


def judged(rows):
    """Rows with what must go and what is truncated; counts of faults."""
    seen, out, counts = set(), [], defaultdict(int)
    for role, text in rows:
        words = text.strip(WHITE)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        out.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    return out, counts


def expected(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation's (turn, role, text)."""
    plain = lambda x: " " if x is None else str(x)
    rows = sorted(((t, plain(r), plain(x)) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    numbers = [t for t, _, _ in rows if t is not None]
    turns, counts = judged([(r, x) for _, r, x in rows])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(turns)
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha256(text.encode()).hexdigest()


def least_by_search(symbols):
    """Least (cost, audit) by enumerating all repairs of a few turns, insertions of up to three turns included."""
    found = []

    def legal_end(roles):
        return roles == "" or (roles.removeprefix("s") != "" and roles.removeprefix("s").replace("ua", "") == "")

    def go(i, roles, cost, letters, inserted):
        if roles not in ("", "s") and not (roles.removeprefix("s") + "a").startswith("ua") or "uu" in roles or "aa" in roles or "sa" in roles or "s" in roles[1:]:
            return
        if cost > 3 * len(symbols):
            return  # deleting everything is cheaper
        if i == len(symbols) and legal_end(roles):
            found.append((cost, letters))
        if inserted < 3:
            for role in "ua":
                go(i, roles + role, cost + 2, letters + "I", inserted + 1)
        if i < len(symbols):
            s = symbols[i]
            go(i + 1, roles, cost + 3, letters + "D", 0)
            if s != MUST_GO:
                if s // 2 < 3:
                    go(i + 1, roles + "sua"[s // 2], cost + s % 2, letters + "K", 0)
                for role in "ua":
                    go(i + 1, roles + role, cost + 2 + s % 2, letters + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


def by_tables(tables, symbols):
    symbols = np.array(symbols, dtype=np.int64)
    to, paid = tables.through(symbols)
    cost = tables.end_cost + int(paid[tables.end]) + tables.vectors[to[tables.end]][0]
    letters, state = tables.trace(symbols, 0, tables.end)
    return cost, "".join(letters) + last_letters(state)


def test_block_tables_against_enumeration():
    rng, tables = random.Random(1), [Tables(1), Tables(3), Tables()]
    for n in range(5):
        for _ in range(40):
            symbols = [rng.randrange(9) for _ in range(n)]
            want = least_by_search(symbols)
            assert [by_tables(t, symbols) for t in tables] == [want] * 3, symbols


def test_block_tables_against_plain_dynamic_programming():
    rng, tables = random.Random(2), Tables()
    for _ in range(300):
        symbols = [rng.choice((0, 2, 2, 3, 4, 4, 5, 6, 7, 8)) for _ in range(rng.randint(0, 60))]
        turns = [("suax"[s // 2] if s != MUST_GO else "u", "", s == MUST_GO, s % 2) for s in symbols]
        cost, audit, _ = cheapest(turns)
        assert by_tables(tables, symbols) == (cost, audit)


def test_normalised_vectors_are_few_and_exact():
    tables = Tables()
    assert len(tables.vectors) < 100 and tables.to.shape == (len(tables.vectors), 9**4)
    vector, at, paid = AT_END, tables.end, tables.end_cost
    for symbol in (0, 3, 8, 5, 5, 7, 2, 8, 8, 8, 8, 8, 8, 1):
        vector, paid, at = before_turn(symbol, vector), paid + tables.one_paid_array[at, symbol], tables.one_to[at][symbol]
        assert vector == tuple(c + paid for c in tables.vectors[at])


def random_rows(rng, convs, longest):
    rows = []
    for conv in convs:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Good.", "Good.", "What?", "no end", " \n", "", "Yes! \t", None, "é?"])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, text))
    return rows


def found(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int")
    repairs, faults = structure_repair.repair_structure(turns)
    costs = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in structure_repair.digests(repairs).collect()}
    counts = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) for r in faults.collect()}
    assert costs.keys() == counts.keys()
    return {c: counts[c] + costs[c] for c in costs}


def wanted(rows):
    by_conv = defaultdict(list)
    for conv, *rest in rows:
        by_conv[conv].append(rest)
    return {conv: expected(turns) for conv, turns in by_conv.items()}


def test_repairs_against_brute_force(spark):
    rows = random_rows(random.Random(3), [*range(60), None], 14)
    rng = random.Random(4)
    rng.shuffle(rows)
    assert found(spark, rows) == wanted(rows)


@pytest.mark.parametrize("rows_per_part", [1, 7])
def test_conversations_over_many_parts(spark, monkeypatch, rows_per_part):
    monkeypatch.setattr(structure_repair, "ROWS_PER_PART", rows_per_part)
    rng = random.Random(5)
    rows = random_rows(rng, [1, 2, None], 12) + random_rows(rng, [3], 12) * 3
    while len(rows) < 70:
        rows += random_rows(rng, [3], 40)
    assert found(spark, rows) == wanted(rows)


def test_repaired_turns_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "More?"), (1, 3, "assistant", "Yes.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    repairs, _ = structure_repair.repair_structure(turns)
    kept = structure_repair.repaired_turns(repairs).orderBy("part", "place").collect()
    cost, audit, out = cheapest(judged([(r, t) for _, _, r, t in rows])[0])
    assert [(r.role, r.text) for r in kept] == list(out) and repairs.first().audit == audit and repairs.first().cost == cost
    repairs, faults = structure_repair.repair_structure(turns.limit(0))
    assert structure_repair.digests(repairs).count() == faults.count() == 0


def test_query_against_brute_force(spark, small_tables):
    rows, every = [], set()
    for r in spark.read.parquet(f"{small_tables}/conversations.parquet").collect():
        plain = lambda x: " " if x is None else str(x)
        harm, role, text = crc32(f"{plain(r.conv_id)}:{plain(r.turn)}".encode()) % 20, plain(r.role), plain(r.text)
        every.add(r.conv_id)
        if harm:
            text = "" if harm == 1 else text.translate({ord(c): None for c in ".!?"}) if harm == 2 else text
            rows += [(r.conv_id, r.turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    want = wanted(rows)
    got = queries.QUERIES["op11_structure_repair"](spark, small_tables).collect()
    assert {r.conv_id for r in got} == every and len(got) == len(every)
    for r in got:
        row = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        assert row == want.get(r.conv_id, (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())), r.conv_id
