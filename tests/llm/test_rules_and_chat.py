"""Quality rules against SQL and brute force; chat repair against an exhaustive search."""

from __future__ import annotations

import heapq
import random
from collections import Counter

import pytest
from check_queries import compare, duck

from lagline.llm import chat_repair, quality_rules, queries

DOCS = "doc_id long, text string, n_words string, words string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def test_rules_equal_sql(spark, small_tables):
    got = queries.QUERIES["op1_quality_rules"](spark, small_tables).toPandas()
    assert compare(got, duck(small_tables).execute(queries.SQL["op1_quality_rules"]).fetchdf()) is None


def test_rules_use_no_python(spark, small_tables):
    plan = queries.QUERIES["op1_quality_rules"](spark, small_tables)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def repeated_words(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)})


def test_repeated_windows_against_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", " \n\t ", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 5000]
    got = {r.doc_id: r for r in quality_rules.rule_ledger(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts[:-1]):
        assert got[i].n_repeat_words == repeated_words(text), text
        assert got[i].n_words == len((text or "").split())
    assert got[len(texts) - 1].n_repeat_words == 5000


def test_rules_on_odd_rows(spark):
    rows = [(None, "word " * 30), (1, None), (1, None), (2, "a\na\nb\n\n \n")]
    judged = quality_rules.apply_policy(quality_rules.rule_ledger(docs_of(spark, rows)))
    out = judged.collect()
    assert len(out) == 4 and all(r.base_failed and not r.kept for r in out)
    two = next(r for r in out if r.doc_id == 2)
    assert (two.n_lines, two.n_dup_lines) == (3, 1)
    assert quality_rules.rule_ledger(docs_of(spark, [])).count() == 0


def test_ablation_counts_what_one_rule_alone_rejects(spark, small_tables):
    ledger = queries.QUERIES["op1_quality_rules"](spark, small_tables)
    rows = ledger.collect()
    for r in quality_rules.ablations(ledger).collect():
        bit = quality_rules.bit_mask((r.rule,))
        assert r.n_failed == sum(bool(x.fail_bits & bit) for x in rows)
        assert r.n_only_this == sum(x.fail_bits == bit for x in rows)
    lenient = quality_rules.apply_policy(ledger.drop("base_failed", "policy", "kept"), quality_rules.LENIENT).where("kept").count()
    assert lenient >= ledger.where("kept").count()


LEGAL = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}


def cheapest(roles):
    """Least (cost, turns) by Dijkstra over (turns read, state)."""
    best, heap = {}, [(0, 0, 0, 0)]
    while heap:
        cost, turns, i, state = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best[i, state] = cost, turns
        for r in LEGAL[state]:
            heapq.heappush(heap, (cost + 3, turns + 1, i, r + 1))
        if i < len(roles):
            for r in LEGAL[state]:
                heapq.heappush(heap, (cost + (0 if r == roles[i] else 2), turns + 1, i + 1, r + 1))
            if state:
                heapq.heappush(heap, (cost + (1 if roles[i] == state - 1 else 3), turns, i + 1, state))
    return min(best[len(roles), s] for s in (2, 3))


NAMES = {-1: (None, "tool"), 0: ("system", " System"), 1: ("user", "Human"), 2: ("assistant", "gpt")}


@pytest.mark.parametrize("per_part", [20_000, 60])
def test_repair_is_cheapest_and_legal(spark, monkeypatch, per_part):
    monkeypatch.setattr(chat_repair, "ROWS_PER_PART", per_part)
    rng = random.Random(7)
    roles = {c: [rng.choice([-1, 0, 1, 1, 2, 2]) for _ in range(rng.randint(1, 9) if c else 400)] for c in range(60)}
    rows = [(c, i, rng.choice(NAMES[r]), f"{c}.{i}", "extra") for c, turns in roles.items() for i, r in enumerate(turns)]
    rows += [(None, i, "user", f"n{i}", "extra") for i in range(200)]
    rng.shuffle(rows)
    out = chat_repair.repair_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")).toPandas()
    nameless = out[out.conv_id.isna()]
    assert Counter(nameless.action) == {"keep": 1, "merge": 199} and set(nameless.cost) == {199} and nameless.seq.is_unique
    for conv, pieces in out.groupby("conv_id"):
        conv, pieces = int(conv), pieces.sort_values("seq")
        turns = [chat_repair.ROLES.index(r) for r in pieces[pieces.action != "merge"].given_role]
        assert all(b in LEGAL[a + 1] for a, b in zip(turns, turns[1:])) and turns[0] in LEGAL[0] and turns[-1] + 1 in (2, 3)
        cost = sum({"keep": 0, "relabel": 2, "insert": 3}.get(p.action, 1 if chat_repair.role_number(p.role) == chat_repair.ROLES.index(p.given_role) else 3)
                   for p in pieces.itertuples())
        assert (cost, len(turns)) == cheapest(roles[conv]) and set(pieces.cost) == {cost}
        assert pieces[pieces.turn.notna()].turn.tolist() == list(range(len(roles[conv]))) and pieces.seq.is_unique
        text = "".join(pieces.rendered)
        assert text.count(chat_repair.END) == len(turns) == text.count("<|") - len(turns) and text.endswith(chat_repair.END)
        at = [text.index(f"{conv}.{i}") for i in range(min(3, len(roles[conv])))]
        assert at == sorted(at)


def test_repair_of_odd_rows(spark):
    shape = "conv_id long, turn long, role string, text string"
    rows = [(None, None, None, None), (None, None, "user", "hi"), (1, 0, "system", "rules"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 1, "assistant", "x" * 300_000)]
    out = chat_repair.repair_chats(spark.createDataFrame(rows, shape)).toPandas()
    assert out[out.conv_id == 1].sort_values("seq").action.tolist() == ["relabel"]
    assert out[out.conv_id == 2].sort_values("seq").action.tolist() == ["keep", "merge"]
    assert "".join(out[out.conv_id == 3].sort_values("seq").rendered) == "<|user|>\n" + "x" * 300_000 + "<|end|>\n"
    assert (out.conv_id.isna() & out.turn.isna()).sum() >= 2
    assert chat_repair.repair_chats(spark.createDataFrame([], shape)).count() == 0


def test_well_formed_conversations_are_kept(spark, small_tables):
    out = queries.QUERIES["op2_chat_repair"](spark, small_tables)
    source = spark.read.parquet(f"{small_tables}/conversations.parquet")
    assert out.where("turn IS NOT NULL").count() == source.count() and out.where("cost > 0 AND action = 'keep' AND role <> given_role").count() == 0
