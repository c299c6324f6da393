"""Mixing, resharding, the token store and the pipeline."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lagline.llm import pivotal_mix, queries, reshard, token_store

SHAPE = "doc_id long, text string, source string, size string, slot long, row string, copies int"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "r", 2) for r in rows], SHAPE)


ODD = [(None, "a b c", "x"), (None, "a b c", None), (1, None, "x"), (2, "", None), (3, "d " * 9, "y"), (3, "d " * 9, "y"), (4, "w " * 50_000, "z"), (5, "q", None)]


def test_targets_stop_at_twice_the_size():
    sizes = [("b", 100), ("a", 1000), (None, 50), ("c", 5000)]
    got = pivotal_mix.targets(sizes)
    # weights a 3, b 1, c 2, null 3 of 1.5 * 6150
    assert got[None] == 100 and got["b"] == 200 and got["a"] == 2000 and got["c"] == pytest.approx(1.5 * 6150 - 2300)
    assert pivotal_mix.targets([]) == {} and pivotal_mix.targets([("a", 0)]) == {"a": 0.0}


def test_pivot_keeps_mass_and_leaves_one():
    rng = random.Random(1)
    for trial in range(200):
        rows = [(rng.randint(1, 50), rng.random(), str(i)) for i in range(rng.randint(1, 40))]
        taken, held, mass = pivotal_mix.pivot(rows, f"t{trial}")
        total = sum(rows[i][0] for i in taken) + (rows[held][0] * mass if held is not None else 0)
        assert total == pytest.approx(sum(s * p for s, p, _ in rows)) and held not in taken and len(set(taken)) == len(taken)


def test_pivot_expectation():
    rows = [(7, 0.3, "a"), (2, 0.6, "b"), (11, 0.45, "c"), (5, 0.8, "d")]
    got, n = Counter(), 4000
    for trial in range(n):
        taken, held, mass = pivotal_mix.pivot(rows, f"e{trial}")
        for i in taken:
            got[i] += 1
        if held is not None:
            got[held] += mass
    assert [got[i] / n for i in range(4)] == pytest.approx([p for _, p, _ in rows], abs=0.04)


@pytest.mark.parametrize("group, fan_in", [(4096, 512), (16, 2)])
def test_mix_comes_near_its_targets(spark, small_tables, monkeypatch, group, fan_in):
    monkeypatch.setattr(pivotal_mix, "GROUP", group)
    monkeypatch.setattr(pivotal_mix, "FAN_IN", fan_in)
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)).alias("source"))
    rows = pivotal_mix.copies(docs).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    want = pivotal_mix.targets([(s, sum(r["size"] for r in g)) for s, g in by.items()])
    for source, group_rows in by.items():
        assert {r.target for r in group_rows} == {want[source]}
        assert abs(sum(r["size"] * r.copies for r in group_rows) - want[source]) <= max(r["size"] for r in group_rows)
        assert all(0 <= r.copies <= 2 for r in group_rows)
    again = {r.doc_id: r.copies for r in pivotal_mix.copies(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.copies for r in rows}


def test_mix_of_odd_rows(spark):
    out = pivotal_mix.copies(docs_of(spark, ODD)).collect()
    assert len(out) == len(ODD) and all(r.copies == 0 for r in out if r["size"] == 0)
    mixed = pivotal_mix.mix(docs_of(spark, ODD))
    assert mixed.columns == docs_of(spark, []).columns
    assert mixed.count() == sum(r.copies for r in out)
    assert pivotal_mix.mix(docs_of(spark, [])).count() == 0 == pivotal_mix.copies(docs_of(spark, [])).count()


def test_repeated_rows_are_split_among_groups(spark, monkeypatch):
    monkeypatch.setattr(pivotal_mix, "GROUP", 32)
    rows = [(7, "same words again", "a")] * 900 + [(None, "no id here", "a")] * 900 + [(i, f"word {i}", "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    numbered = docs.select(F.concat_ws("|", "source", "text").alias("order"), F.monotonically_increasing_id().alias("row"), F.lit(60).cast("long").alias("groups"))
    sizes = [r["count"] for r in pivotal_mix.dealt(numbered).groupBy("cell").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 200
    got = pivotal_mix.copies(docs).collect()
    assert len(got) == len(rows) and len({r.row for r in got}) == len(rows)
    for source in "ab":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= max(r.size for r in mine)


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(2)
    for _ in range(200):
        supply = [rng.randint(0, 60) for _ in range(rng.randint(1, 6))]
        n = rng.randint(1, 6)
        capacity = reshard.equal_capacities(sum(supply), n) if rng.random() < 0.5 else [rng.randint(0, 40) + sum(supply) // n + 1 for _ in range(n)]
        flow = reshard.cheapest_flow(supply, capacity, [o if o < n else None for o in range(len(supply))])
        assert [sum(r) for r in flow] == supply and all(sum(r[k] for r in flow) <= capacity[k] for k in range(n)) and min(map(min, flow)) >= 0
        moved = sum(x for o, r in enumerate(flow) for k, x in enumerate(r) if o != k)
        assert moved == sum(s - min(s, capacity[o] if o < n else 0) for o, s in enumerate(supply))
    with pytest.raises(ValueError):
        reshard.cheapest_flow([5], [4], [0])


@pytest.mark.parametrize("block_rows", [16_384, 10])
def test_shards_are_even_and_whole(spark, small_tables, monkeypatch, block_rows):
    monkeypatch.setattr(reshard, "BLOCK_ROWS", block_rows)
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_reshard"](spark, small_tables).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by, largest = defaultdict(list), max(map(len, texts.values())) + 1
    for r in rows:
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r["size"] == len(texts[r.doc_id]) + 1
        by[r.shard].append(r)
    total = sum(r["size"] for r in rows)
    assert set(by) == set(range(8)) and all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values())
    assert all(abs(sum(r["size"] for r in g) - total / 8) <= 9 * largest for g in by.values())
    old = Counter()
    for r in rows:
        old[r.old_shard] += r["size"]
    least = sum(max(0, old[s] - total // 8) for s in range(8))
    assert abs(sum(r["size"] for r in rows if r.shard != r.old_shard) - least) <= 64 * largest


def test_shards_of_odd_rows_and_untouched_shards(spark):
    out = reshard.reshard(docs_of(spark, ODD), F.lit(0), 1, 3, files_per_shard=2)
    assert out.count() == len(ODD) and out.columns == ["doc_id", "text", "source", "row", "copies", "shard", "slot", "size", "old_shard"]
    assert reshard.reshard(docs_of(spark, []), F.lit(0), 1, 3).count() == 0
    assert reshard.affected_shards([[5, 0, 0], [0, 2, 3], [0, 0, 1]]) == [1, 2]
    # capacities that already fit move nothing
    even = docs_of(spark, [(i, "abc", "x") for i in range(12)])
    kept = reshard.reshard(even, F.col("doc_id") % 3, 3, 3).collect()
    assert all(r.shard == r.old_shard == r.doc_id % 3 for r in kept)


def truth(rows):
    """doc_id -> Counter of (start, n_tokens, crc) by the tokenizer on whole texts."""
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(VOCABULARY), 0, Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out[doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
        at += len(ids)
    return out


def test_store_round_trip(spark, small_tables):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect())
    out = queries.QUERIES["op10_token_store"](spark, small_tables).collect()
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out) == truth(rows)


def test_store_of_odd_rows_and_many_shards(spark, monkeypatch):
    for name, value in (("SHARD_BYTES", 400), ("BLOCK_IDS", 32), ("PART_KEYS", 20)):
        monkeypatch.setattr(token_store, name, value)
    rng = random.Random(3)
    texts = ["Ünïcode ΑΣ ΑΣ. don't stop", "á ́b <|endoftext|>x 12345", "x " * 700, "\t \n", "日本語 テスト"]
    texts += [" ".join(rng.choice("alpha beta Gamma 42 !? é".split()) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(7, texts[7], "s")] * 3 + [(None, "none", "s")] * 2 + [(-5, None, None)]
    out = token_store.round_trip(docs_of(spark, rows), VOCABULARY).collect()
    ordered = sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is None, r[0] or 0))
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out) == truth(ordered)
    assert token_store.round_trip(docs_of(spark, []), VOCABULARY).count() == 0


def test_index_is_minimal_perfect_and_knows_strangers(spark):
    ids = np.arange(50_000, dtype=np.uint64) * np.uint64(3)
    zero = np.zeros(len(ids), dtype=np.uint64)
    sizes, bits = token_store.build_levels(ids, zero)
    slots = token_store.slots(ids, zero, sizes, bits)
    assert sorted(slots) == list(range(len(ids))) and len(bits) < 5 * len(ids)
    kept = token_store.write_store(docs_of(spark, [(i, f"w{i}", "s") for i in range(300)]), VOCABULARY)
    wanted = spark.createDataFrame([(i, 0) for i in range(250, 350)] + [(5, 1), (None, 0)], "doc_id long, occurrence long")
    found = {(r.doc_id, r.occurrence): r.found for r in token_store.look_up(kept, wanted).collect()}
    assert {k for k, v in found.items() if v} == {(i, 0) for i in range(250, 300)} and len(found) == 102


def test_pipeline_stages_against_their_operators(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, corpus_pipeline.store(stage(spark, docs, small_tables), f"test-{k}")
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert docs.join(before, columns, "left_anti").count() == 0, name
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in docs.collect()) == truth(rows)


def test_all_eleven_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_words_of_colliding_hashes_keep_their_ids(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lagline.llm.token_store import TokenIds
    from lagline.llm.words import TextHashes

    path = public_tokenizers.path("word_bpe_49k.json")
    library, word = Tokenizer.from_file(path), "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [f"{w[:n]} and {w[:n]}." for n in (512, 1024, 2048, 4096) for w in (word, word.translate(str.maketrans("ab", "ba")))]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in TokenIds(path, 2).of([t.encode() for t in texts])] == want
    # Even where the first hash of every piece is the same, the second one keeps them apart.
    spans = TextHashes.spans
    monkeypatch.setattr(TextHashes, "spans", lambda self, data, a, b, lane=0: spans(self, data, a, b, lane) * (lane != 0))
    assert [ids.tolist() for ids in TokenIds(path, 2).of([t.encode() for t in texts])] == want
