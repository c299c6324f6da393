"""Periodic runs against brute force."""

from __future__ import annotations

import random
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from lagline.llm import periodic_runs, queries
from lagline.llm.periodic_runs import Runs, lyndon_array


def longest_lyndon_prefixes(s):
    """By definition: up to the next suffix that is smaller."""
    suffix = [s[i:] for i in range(len(s))]
    return [next((j for j in range(i + 1, len(s)) if suffix[j] < suffix[i]), len(s)) - i for i in range(len(s))]


def test_grouping_gives_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(1500):
        letters = rng.choice("12345")
        s = [rng.randrange(int(letters)) for _ in range(rng.randint(1, 30))]
        if rng.random() < 0.5:
            s = (s[: rng.randint(1, 5)] * 12)[:40]
        symbols = np.unique(s, return_inverse=True)[1].tolist()
        for order in (symbols, [max(symbols) - x for x in symbols]):
            assert lyndon_array(order, max(symbols) + 1) == longest_lyndon_prefixes(order)


def brute_runs(words, least=24, periods=3):
    n, out = len(words), []
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            start, stop = i, j + p
            if stop - start >= max(least, periods * p) and not any(words[start : stop - q] == words[start + q : stop] for q in range(1, p)):
                out.append((start, stop, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts_with_runs(rng, n):
    for _ in range(n):
        out = []
        for _ in range(rng.randint(1, 4)):
            block = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 14))]
            if rng.random() < 0.4:
                block = block * rng.randint(1, 3) + [rng.choice("ab")]
            out += (block * rng.randint(1, 9))[: rng.randint(1, 90)] + [rng.choice("abxyz") for _ in range(rng.randint(0, 12))]
        yield out


def check(texts, **settings):
    finder = Runs(**settings)
    least, periods = finder.min_words, finder.min_periods
    for words, (runs, split) in zip(texts, finder.of([" ".join(w).encode() for w in texts])):
        assert [w.decode() for w in split] == words
        assert list(map(tuple, runs.tolist())) == brute_runs(words, least, periods), words


def test_runs_against_brute_force():
    check(list(texts_with_runs(random.Random(2), 500)))
    check(list(texts_with_runs(random.Random(3), 300)), min_words=9, min_periods=4)
    check([list(w) for w in ("", "a", "a" * 23, "a" * 24, "ab" * 12, "ab" * 11 + "a", "abcdefgh" * 3, "abcdefgh" * 2 + "abcdefg", "abcdefghi" * 3)])


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_of_colliding_hashes_keep_runs_exact():
    word = list(thue_morse(1024))
    other = [{"a": "b", "b": "a"}[c] for c in word]
    check([word * 3, word + other, word + other + word, (word + other) * 2, word * 3 + other * 3, word + word[:500] * 3])


def test_too_far_extension_is_compared(monkeypatch):
    """With a hash that calls everything equal, the comparison alone must give the runs of every root."""
    finder = Runs()
    symbols = np.array([0, 1] * 15 + [2] + [1, 0] * 14)
    assert finder._compared(symbols, 1, 0, len(symbols), 2) == (0, 30, 2)
    assert finder._compared(symbols, 40, 0, len(symbols), 2) == (31, 59, 2)
    assert finder._compared(np.arange(60), 3, 0, 60, 2) is None
    monkeypatch.setattr(periodic_runs.Rolling, "span", lambda self, sums, start, stop: np.zeros(len(start), dtype=np.uint64))
    check([w for w in texts_with_runs(random.Random(5), 40)])


def test_runs_of_two_periods_are_refused():
    with pytest.raises(ValueError):
        Runs(min_periods=2)
    check(list(texts_with_runs(random.Random(4), 100)), min_words=1, min_periods=3)


def outcome(words):
    runs = brute_runs(words)
    dropped = {i for a, b, p in runs for i in range(a + p, b)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return runs, best, kept


def test_odd_rows(spark):
    loop = "one two three " * 10
    rows = [(None, loop, "x"), (None, loop, "x"), (1, None, None), (1, "", "x"), (2, "é\x0b" * 30 + "end", "x"), (3, "long" * 5000 + " word", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id, [(a.start, a.start + a.length, a.period) for a in r.runs], r.kept_text) for r in periodic_runs.periodic_runs(docs).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        runs, _, kept = outcome([w.decode() for w in (text or "").encode().split()])
        want.append((doc_id, runs, kept))
    assert got == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, small_tables):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()}
    got = queries.QUERIES["op12_periodic_runs"](spark, small_tables).collect()
    assert len(got) == len(docs)
    planted = 0
    for row in got:
        words = [w.decode() for w in (docs[row.doc_id] or "").encode().split()]
        h, n = crc32(str(row.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        if len(words) > 3000:
            continue  # too long for the brute force
        runs, best, kept = outcome(words)
        planted += bool(runs)
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == sha256("".join(f"{a},{b - a},{p}\n" for a, b, p in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == sha256(kept.encode()).hexdigest()
        assert (row.start, row.length, row.period) == ((best[0], best[1] - best[0], best[2]) if best else (None, None, None))
        assert row.exponent_milli == (1000 * (best[1] - best[0]) // best[2] if best else None)
    assert planted > 5
