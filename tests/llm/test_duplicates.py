"""Near duplicates, repeated passages and benchmark passages against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lagline.llm import components, decontaminate, minhash_dedup, queries, substring_dedup

SHAPE = "doc_id long, text string, node long, band string, start int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "b", 2) for i, t in rows], SHAPE)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def classes(rows):
    """doc_id -> (set size, smallest id of the component)."""
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            shared.update((j, i) for j in holders[g])
            holders[g].append(i)
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(rng, n_groups, size):
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [400_000, 1000])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", block)
    rng = random.Random(3)
    rows = near_copies(rng, 6, 30) + near_copies(rng, 60, 2)
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(1000, ""), (1001, None), (1002, "One Two"), (1003, "one two"), (1004, "\n \t")]
    out = minhash_dedup.near_duplicates(docs_of(spark, rows)).collect()
    want = classes(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_components_on_the_small_table(spark, small_tables):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()]
    out = queries.QUERIES["op3_minhash_dedup"](spark, small_tables).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == classes(rows)


def test_near_duplicates_of_odd_rows(spark):
    text = "a b c d e f g h i j"
    out = minhash_dedup.near_duplicates(docs_of(spark, [(None, text), (5, text), (5, text), (7, text), (None, "x y z u v w"), (9, "lonely words here")])).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in out) == Counter({
        (None, 5, False): 1, (5, 5, True): 2, (7, 5, False): 1, (None, None, True): 1, (9, 9, True): 1})
    left = minhash_dedup.keep_first_of_each(docs_of(spark, [(None, text), (5, text), (None, "x y z u v w"), (None, None)]))
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter({(5, text): 1, (None, "x y z u v w"): 1, (None, None): 1})
    assert minhash_dedup.near_duplicates(docs_of(spark, [])).count() == 0
    assert minhash_dedup.keep_first_of_each(docs_of(spark, [(1, text), (2, text), (3, "")])).orderBy("doc_id").select("doc_id").collect() == [(1,), (3,)]


def test_one_row_of_each_group_stays(spark):
    text, near = "a b c d e f g h i j " * 3, "x y z u v w"
    rows = [(5, text)] * 4 + [(5, text.upper()), (7, text), (None, text)] + [(None, near)] * 3 + [(None, near.upper())] + [(5, "")] * 2 + [(5, " "), (None, None), (None, None), (5, "other words here")]
    left = minhash_dedup.keep_first_of_each(docs_of(spark, rows)).collect()
    assert Counter((r.doc_id, (r.text or "").lower()) for r in left) == Counter(
        {(5, text): 1, (None, near): 1, (5, ""): 1, (5, " "): 1, (None, ""): 1, (5, "other words here"): 1})
    assert minhash_dedup.keep_first_of_each(docs_of(spark, [])).count() == 0


def test_pruning_bound_is_the_binomial_tail():
    from math import comb

    for n, m in minhash_dedup.least_matches(0.75, 1e-7):
        tail = lambda k: sum(comb(n + 1, i) * 0.75**i * 0.25 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= 1e-7 and (m == 0 or tail(m - 1) < 1e-7)


def test_connected_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(parent[a], parent[b])
            changed |= parent[a] != low or parent[b] != low
            parent[a] = parent[b] = low
    assert got == {x: p for x, p in parent.items() if any(x in e and e[0] != e[1] for e in edges)}


def cuts(rows):
    first = {}
    for i, t in rows:
        words = (t or "").encode().split()
        for k in range(len(words) - 49):
            key = tuple(words[k : k + 50])
            first[key] = min(first.get(key, (1, 0)), (i is None, i or 0))
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = {k + j for k in range(len(words) - 49) if first[tuple(words[k : k + 50])] < (i is None, i or 0) for j in range(50)}
        out.append((i, len(words), len(gone), b" ".join(w for j, w in enumerate(words) if j not in gone).decode()))
    return Counter(out)


def test_cuts_equal_brute_force(spark):
    rng = random.Random(4)
    passages = [" ".join(f"p{rng.randrange(500)}" for _ in range(n)) for n in (49, 50, 51, 70, 200)]
    rows = []
    for i in range(80):
        parts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60)))]
        parts += [rng.choice(passages) for _ in range(rng.randint(0, 3))]
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    rows += [(200, None), (201, ""), (202, "a " * 120), (203, "a " * 80), (None, passages[3]), (None, "a " * 60), (5, rows[5][1]), (5, passages[4])]
    out = substring_dedup.remove_repeated_passages(docs_of(spark, rows)).collect()
    assert Counter(tuple(r) for r in out) == cuts(rows)
    assert substring_dedup.remove_repeated_passages(docs_of(spark, [])).count() == 0


def test_cuts_on_the_small_table(spark, small_tables):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()]
    want = Counter((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in cuts(rows))
    assert Counter(tuple(r) for r in queries.QUERIES["op4_substring_dedup"](spark, small_tables).collect()) == want


def test_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "WIDTH_BITS", 8)
    monkeypatch.setattr(substring_dedup, "BLOCK_BITS", 6)
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) + " " + shared * (i % 3 == 0)) for i in range(30)]
    assert Counter(tuple(r) for r in substring_dedup.remove_repeated_passages(docs_of(spark, rows)).collect()) == cuts(rows)


def plain_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_bit_parallel_distance_equals_the_table():
    rng = random.Random(2)
    for _ in range(400):
        item = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 80))]
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        assert decontaminate.best_distance(item, words)[0] == plain_distance(item, words)


def test_contaminations_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    rng = random.Random(6)
    item = lambda n: [f"i{rng.randrange(400)}" for _ in range(n)]
    items = [(k, item(rng.randint(1, 60))) for k in range(12)] + [(90, []), (91, ["i1"] * 20)]
    rows = []
    for i in range(120):
        words = item(rng.randint(0, 120))
        if i % 2:
            passage = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 1 + len(passage) // 4)):
                at = rng.randrange(len(passage) + 1)
                passage[at : at + rng.randint(0, 1)] = item(rng.randint(0, 1))
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        rows.append((i, ", ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rows += [(300, None), (301, ""), (None, ", ".join(items[3][1])), (5, rows[5][1])]
    benchmark = spark.createDataFrame([(k, " ".join(w) or None) for k, w in items], "item_id long, text string")
    got = decontaminate.contaminations(docs_of(spark, rows), benchmark)
    want = Counter()
    for i, text in rows:
        words = decontaminate.plain_words(text)
        for k, w in items:
            edits = plain_distance([x.encode() for x in w], words) if w else 99
            if w and edits <= len(w) // 5:
                want[i, k, edits, len(w)] += 1
    assert Counter(tuple(r) for r in got.collect()) == want and len(want) > 30
    kept = decontaminate.drop_contaminated(docs_of(spark, rows), benchmark)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {k[0] for k in want}
    assert kept.columns == SHAPE.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert decontaminate.contaminations(docs_of(spark, []), benchmark).count() == 0
    assert decontaminate.contaminations(docs_of(spark, rows), benchmark.limit(0)).count() == 0


def test_clean_rows_of_a_contaminated_id_stay(spark):
    benchmark = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    dirty = "so one two three four five six seven it is"
    rows = [(None, dirty), (None, "clean"), (None, "clean"), (None, None), (4, dirty), (4, dirty), (4, "other"), (5, "other"), (6, dirty)]
    left = decontaminate.drop_contaminated(docs_of(spark, rows), benchmark).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter({(None, "clean"): 2, (None, None): 1, (4, "other"): 1, (5, "other"): 1})


def test_rolling_hashes_depend_on_the_words_only():
    from lagline.llm.words import Rolling, WordHashes

    hashes, roll = WordHashes(), Rolling(5, 9)
    rng = random.Random(1)
    words = [rng.choice([b"a", b"b"]) for _ in range(3000)]
    with np.errstate(over="ignore"):
        values = roll.of(hashes.of(words))
    seen = {}
    for i, v in enumerate(values):
        assert seen.setdefault(tuple(words[i : i + 5]), v) == v
    assert len(set(seen.values())) == len(seen) == 32


def test_text_hashes_tell_words_apart_as_split_does(monkeypatch):
    from lagline.llm import words

    monkeypatch.setattr(words, "_CHUNK", 50)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1c\x85 é") for _ in range(rng.randint(0, 40))).encode() for _ in range(300)] + [b"", b" ", b"x"]
    codes, sizes = words.TextHashes().read(texts)
    assert sizes.tolist() == [len(t.split()) for t in texts]
    names = [w for t in texts for w in t.split()]
    assert len(set(zip(names, codes.tolist()))) == len(set(names)) == len(set(codes.tolist()))
    assert words.TextHashes().read([])[0].tolist() == []


def thue_morse_pairs():
    """Words and their complements, of lengths at which sums of letters times powers of an odd base agree modulo 2^64."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    return [(word[:n], word[:n].translate(str.maketrans("ab", "ba"))) for n in (256, 1024, 2048, 4096)]


def test_words_whose_sums_agree_are_told_apart():
    from lagline.llm import words

    every = [w for pair in thue_morse_pairs() for w in pair]
    assert len(set(words.TextHashes().read([" ".join(every).encode()])[0].tolist())) == len(every)


def test_such_words_link_nothing_and_remove_nothing(spark):
    rows, clean = [], []
    for k, (one, other) in enumerate(thue_morse_pairs()):
        before, after = ([f"{x}{k}w{i}" for i in range(30)] for x in "pq")
        clean += [(4 * k, one), (4 * k + 1, other)]
        rows += [(4 * k + 2, " ".join([*before, one, *after])), (4 * k + 3, " ".join([*before, other, *after]))]
    # the same at the level of words: long runs of two words in both orders
    for one, other in thue_morse_pairs()[1:3]:
        rows += [(100 + len(one), " ".join(one)), (101 + len(one), " ".join(other))]
    near = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(clean, "doc_id long, text string")).collect()}
    assert all(i == c for i, c in near.items()) and len(near) == len(clean)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated_passages(docs).collect()}
    assert got == removed_by_brute_force(rows)


def removed_by_brute_force(rows):
    first = {}
    windows = {i: [tuple(w[k : k + 50]) for k in range(len(w) - 49)] for i, w in ((i, t.split()) for i, t in rows)}
    for i, ws in sorted(windows.items()):
        for w in ws:
            first.setdefault(w, i)
    return {i: len({k + j for k, w in enumerate(ws) if first[w] < i for j in range(50)}) for i, ws in windows.items()}
