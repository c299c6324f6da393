"""BPE encoding and decoding against the tokenizer library."""

from __future__ import annotations

import random
from hashlib import sha256

import public_tokenizers
import pytest

from lagline.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def odd_texts():
    rng = random.Random(7)
    parts = list(" \n\t\r  aZ1'.,éß\x00\x1c\x85　 日🙂́՘꟎�") + ["'s", "'LL", "<|endoftext|>", "<|endof", "  ", "\n\n", " the", "er"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return texts + ["", " ", "\n" * 500, "ab" * 40_000, "word " * 60_000, thue_morse(4096), thue_morse(4096).translate(str.maketrans("ab", "ba")), "é" * 9_999]


def test_ids_and_texts_equal_the_librarys(library):
    words = bpe.Vocabulary(PATH)
    encoder = bpe.Encoder(words)
    for text in odd_texts():
        ids = encoder.encode(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert words.decode(ids) == library.decode(ids, skip_special_tokens=False), text[:80]


def test_any_ids_decode_as_the_librarys(library):
    words, rng = bpe.Vocabulary(PATH), random.Random(3)
    for _ in range(2000):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 6))]
        assert words.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_small_caches_and_chunks_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "_CACHED_PIECES", 3)
    encoder = bpe.Encoder(bpe.Vocabulary(PATH))
    for text in odd_texts()[:400]:
        for size in (1, 7):
            cut = list(bpe.chunks(text, size))
            assert "".join(cut) == text
            if "<|endoftext|>" not in text:
                assert [i for c in cut for i in encoder.encode(c).tolist()] == library.encode(text, add_special_tokens=False).ids


def by_lowest_rank(symbols, vocabulary):
    """Merging by search of the whole list, without a queue."""
    symbols = list(symbols)
    while True:
        ranked = [(vocabulary.ranks[a][b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if b in vocabulary.ranks[a]]
        if not ranked:
            return symbols
        rank, i = min(ranked)
        symbols[i : i + 2] = [vocabulary.made[rank]]


def test_queue_merges_as_a_plain_search_does():
    vocabulary, rng = bpe.Vocabulary(PATH), random.Random(11)
    for _ in range(300):
        word = "".join(rng.choice("aeihnst ") for _ in range(rng.randint(0, 30))).encode()
        assert vocabulary.encode_word(word) == by_lowest_rank([vocabulary.first[b] for b in word], vocabulary)


def test_odd_rows(spark, library):
    rows = [(None, "some text", "x"), (1, None, None), (1, "", "x"), (1, "same", "x"), (1, "same", "x"), (None, "some text", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, tuple(r.ids), r.text) for r in bpe.round_trip(docs, PATH).collect()), key=repr)
    want = sorted(((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, _ in rows), key=repr)
    assert got == want
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [99_999, 64, None])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_ids(nulls, PATH).collect()} == {1: "", 2: "", 3: "a"}


def test_query_against_the_library(spark, small_tables, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()}
    got = queries.QUERIES["op13_bpe"](spark, small_tables).collect()
    assert len(got) == len(docs)
    for row in got:
        ids = library.encode(docs[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
