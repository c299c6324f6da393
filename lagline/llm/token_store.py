"""Token ids in binary shards, with a minimal perfect hash index from document keys to shard offsets.

Files. Documents are range-partitioned by id into shards. A shard is a run of blocks; a block row holds the raw ids of
consecutive documents (``payload``, little-endian unsigned, ``width`` bytes an id) and its
directory: ids, lengths and offsets. Blocks have about 65,536 ids, so nothing but a single long text is ever larger.

Index. Keys are (id, occurrence), so repeated ids stay addressable. They are dealt by hash to index parts of about 100,000
keys; each part is one row with a minimal perfect hash (levels of bit arrays: a key sets the bit that only it
hits, colliding keys go on to the next level; the rank of its bit is its slot) and slot-ordered arrays of 32-bit
fingerprints and places. A lookup reads one part, a few bits and one slot; a wrong fingerprint means "not here".

A null text is empty and has only the end id. Null ids come last, as occurrences of one null key. Equal ids are
ordered by a hash of their text. An empty table gives empty files and an empty index. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagline.llm.scratch import bound_batches, store
from lagline.llm.words import TextHashes, mix, odd_numbers, texts_of

END_ID = 1
BLOCK_IDS = 1 << 16
SHARD_BYTES = 48 << 20
PART_KEYS = 100_000
# Bits per key and level.
SPARE = 2

_CACHED_WORDS = 1_000_000
_CHUNK = 2 << 20
_SEEDS = mix(odd_numbers(256, 41))
_OCCURRENCE, _PRINT = odd_numbers(2, 42)
_NULL = 1 << 62


class TokenIds:
    """Token ids of whole texts, every distinct word encoded once.

    The tokenizer drops white space and never joins words across it, lower-cases everything, and keeps letters and punctuation
    apart. So texts are lower-cased and cut at white space and before the ASCII punctuation (but no apostrophe) that ends a
    word after a letter; pieces are told apart by two 64-bit hashes, unseen ones are encoded together, and a text's ids are gathered from those of
    its pieces. Texts with a marker of special tokens, which are matched as written, or with combining marks, which the
    tokenizer composes before it lower-cases, are encoded as they are.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.hashes = Tokenizer.from_file(path), np.dtype(f"<u{width}"), TextHashes()
        letters = np.zeros(256, dtype=bool)
        letters[ord("a") : ord("z") + 1] = True
        marks = np.zeros(256, dtype=bool)
        marks[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True
        latin = np.zeros(256, dtype=bool)
        latin[0x80:0xC0] = True
        latin[[0x97, 0xB7]] = False  # the signs among the letters that begin with C3
        self.letters, self.marks, self.latin = letters, marks, latin
        self._forget()

    def _forget(self) -> None:
        self.codes, self.checks, self.slots = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.flat, self.starts, self.sizes = np.empty(0, dtype=self.dtype), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        odd = [b"<|" in t or b"\xcc" in t or b"\xcd" in t for t in texts]
        out: list[np.ndarray] = [None] * len(texts)
        for i in (i for i, x in enumerate(odd) if x):
            found = self.tokenizer.encode(texts[i].decode("utf-8", "replace"), add_special_tokens=False)
            out[i] = np.array(found.ids, dtype=self.dtype)
        plain, at = [i for i, x in enumerate(odd) if not x], 0
        while at < len(plain):
            stop, size = at, 0
            while stop < len(plain) and (stop == at or size + len(texts[plain[stop]]) < _CHUNK):
                size += len(texts[plain[stop]]) + 1
                stop += 1
            for i, ids in zip(plain[at:stop], self._chunk([texts[i].lower() for i in plain[at:stop]])):
                out[i] = ids
            at = stop
        return out

    def _pieces(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin and end."""
        space = self.hashes.space[data]
        begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        mark = self.marks[data]
        tail = np.flatnonzero(mark[1:] & ~mark[:-1]) + 1
        before = data[tail - 1]
        tail = tail[self.letters[before] | (self.latin[before] & (data[np.maximum(tail - 2, 0)] == 0xC3))]
        other = np.flatnonzero(~mark)
        tail = tail[space[other[np.searchsorted(other, tail)]]]
        return np.sort(np.concatenate([begin, tail])), np.sort(np.concatenate([end, tail]))

    def _learn(self, codes: np.ndarray, checks: np.ndarray, words: list[bytes]) -> None:
        self.checks = np.append(self.checks, checks)
        for at in range(0, len(words), 4_000):
            part = words[at : at + 4_000]
            found = self.tokenizer.encode([w.decode("utf-8", "replace") for w in part], is_pretokenized=True, add_special_tokens=False)
            sizes = np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(part))
            new = codes[at : at + 4_000]
            where = np.searchsorted(self.codes, new)
            self.codes = np.insert(self.codes, where, new)
            self.slots = np.insert(self.slots, where, np.arange(len(self.sizes), len(self.sizes) + len(part)))
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
            self.sizes = np.append(self.sizes, sizes)
            self.flat = np.append(self.flat, np.array(found.ids, dtype=self.dtype))

    def _chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        whole = b" ".join([b"", *texts, b""])
        data = np.frombuffer(whole, dtype=np.uint8)
        begin, end = self._pieces(data)
        codes, first, back = np.unique(self.hashes.spans(whole, begin, end), return_index=True, return_inverse=True)
        # A second hash, so that a piece takes another one's ids only where both of its hashes and its length agree.
        check = self.hashes.spans(whole, begin, end, lane=1)

        def unseen() -> np.ndarray:
            if not len(self.codes):
                return np.ones(len(codes), dtype=bool)
            return self.codes[np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)] != codes

        new = unseen()
        if len(self.sizes) + new.sum() > _CACHED_WORDS:
            self._forget()
            new = unseen()
        self._learn(codes[new], check[first[new]], [whole[begin[i] : end[i]] for i in first[new].tolist()])
        slot = self.slots[np.searchsorted(self.codes, codes)][back] if len(codes) else np.empty(0, dtype=np.int64)
        if (self.checks[slot] != check).any():
            return [np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=self.dtype) for t in texts]
        sizes = self.sizes[slot]
        after = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[slot] - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        pieces = np.searchsorted(begin, ends, side="right")
        return np.split(ids, np.concatenate([[0], after])[pieces][:-1])


def id_width(path: str) -> int:
    """Bytes that the largest id of a vocabulary needs: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


_BLOCKS = "shard int, block int, first_id long, first_row long, n_ids long, doc_ids array<long>, lengths array<int>, offsets array<int>, payload binary"
_BLOCK_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("first_row", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("payload", pa.binary())])


def _write_blocks(path: str, width: int):
    def run(batches):
        words, end = TokenIds(path, width), np.array([END_ID], dtype=f"<u{width}").tobytes()
        shard, block, first_id, first_row = TaskContext.get().partitionId(), 0, 0, 0
        ids, lengths, parts = [], [], []

        def out() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "block": block, "first_id": first_id, "first_row": first_row, "n_ids": int(offsets[-1]), "doc_ids": ids,
                "lengths": lengths, "offsets": offsets[:-1].tolist(), "payload": b"".join(parts)}], schema=_BLOCK_SCHEMA)

        for batch in batches:
            for doc_id, code in zip(batch.column(0).to_pylist(), words.of(texts_of(batch.column(1)))):
                code = code.tobytes() + end
                ids.append(doc_id), parts.append(code), lengths.append(len(code) // width)
                if sum(lengths) >= BLOCK_IDS or len(ids) >= BLOCK_IDS // 8:
                    yield out()
                    block, first_id, first_row = block + 1, first_id + sum(lengths), first_row + len(ids)
                    ids, lengths, parts = [], [], []
        if ids:
            yield out()

    return run


def _spread(doc_id: np.ndarray, occurrence: np.ndarray, seed: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(doc_id ^ seed) + occurrence * _OCCURRENCE)


def _print_of(doc_id: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return (_spread(doc_id, occurrence, _PRINT) >> np.uint64(32)).astype(np.uint32)


def build_levels(doc_id: np.ndarray, occurrence: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and the concatenated bits (one byte each) of a minimal perfect hash over distinct keys."""
    sizes, bits = [], []
    while len(doc_id):
        size = max(64, SPARE * len(doc_id))
        at = (_spread(doc_id, occurrence, _SEEDS[len(sizes)]) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size), bits.append(alone)
        rest = ~alone[at]
        doc_id, occurrence = doc_id[rest], occurrence[rest]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, dtype=bool)


def slots(doc_id: np.ndarray, occurrence: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of every key; -1 where a key hits no bit and so cannot be one of the index's."""
    rank = np.concatenate([[0], np.cumsum(bits)])
    out, open_, start = np.full(len(doc_id), -1, dtype=np.int64), np.arange(len(doc_id)), 0
    for level, size in enumerate(sizes):
        at = start + (_spread(doc_id[open_], occurrence[open_], _SEEDS[level]) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, start = open_[~hit], start + size
    return out


def _plain_keys(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return rows["key_id"].to_numpy(dtype=np.int64).view(np.uint64), rows["occurrence"].to_numpy(dtype=np.int64).view(np.uint64)


_PLACES = ("shard", "block", "offset", "n_tokens")
_INDEX = "part long, n_keys long, sizes array<int>, bits binary, prints binary, " + ", ".join(f"{p} binary" for p in _PLACES)


def _build_part(key, rows):
    ids, occurrence = _plain_keys(rows)
    sizes, bits = build_levels(ids, occurrence)
    order = np.argsort(slots(ids, occurrence, sizes, bits))
    return pd.DataFrame([{
        "part": key[0], "n_keys": len(rows), "sizes": sizes, "bits": np.packbits(bits).tobytes(),
        "prints": _print_of(ids, occurrence)[order].tobytes(),
        **{p: rows[p].to_numpy(dtype="<i4")[order].tobytes() for p in _PLACES}}])


def _look_up(key, wanted, index):
    found = wanted[["doc_id", "occurrence"]].copy()
    if not len(wanted) or not len(index):
        return found.assign(found=False, **{p: -1 for p in _PLACES})
    part = index.iloc[0]
    ids, occurrence = _plain_keys(wanted)
    bits = np.unpackbits(np.frombuffer(part["bits"], dtype=np.uint8))[: sum(part["sizes"])].astype(bool)
    slot = slots(ids, occurrence, list(part["sizes"]), bits)
    safe = np.maximum(slot, 0)
    known = (slot >= 0) & (np.frombuffer(part["prints"], dtype=np.uint32)[safe] == _print_of(ids, occurrence))
    return found.assign(found=known, **{p: np.where(known, np.frombuffer(part[p], dtype="<i4")[safe], -1) for p in _PLACES})


@dataclass(frozen=True)
class TokenStore:
    """Blocks, shard starts and index of a written store."""

    blocks: DataFrame
    shards: DataFrame
    keys: DataFrame
    index: DataFrame
    n_parts: int
    width: int


def _keyed(df: DataFrame, n_parts: int) -> DataFrame:
    """Adds what an index key is made of: the id (0 for null), the occurrence (beyond all others for null) and its part."""
    df = df.withColumn("key_id", F.coalesce("doc_id", F.lit(0))).withColumn(
        "occurrence", F.col("occurrence") + F.when(F.col("doc_id").isNull(), _NULL).otherwise(0))
    return df.withColumn("part", F.pmod(F.xxhash64("key_id", "occurrence"), F.lit(n_parts)).cast("long"))


def write_store(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
    """Encode every text, write shards and index into the shared folder."""
    spark = docs.sparkSession
    bound_batches(spark)
    width = id_width(tokenizer_path)
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = plain.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n_shards = max(1, -(-total // SHARD_BYTES))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_key"), F.col("row")]
    sorted_docs = plain.withColumns({"text_key": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(
        n_shards, *order).sortWithinPartitions(*order)
    blocks = store(sorted_docs.select("doc_id", "text").mapInArrow(_write_blocks(tokenizer_path, width), _BLOCKS), "blocks")

    per_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"), F.sum(F.size("doc_ids")).alias("rows"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = store(per_shard.select(
        "shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shard_row")), "shards")

    entries = blocks.select("shard", "block", "first_row", F.posexplode(F.arrays_zip("doc_ids", "lengths", "offsets")).alias("pos", "e")).join(
        shards, "shard").select(
        F.col("e.doc_ids").alias("doc_id"), (F.col("shard_row") + F.col("first_row") + F.col("pos")).alias("row_no"),
        "shard", "block", F.col("e.offsets").alias("offset"), F.col("e.lengths").alias("n_tokens"))
    firsts = entries.groupBy("doc_id").agg(F.min("row_no").alias("first_no"), F.count("*").alias("n"))
    counts = firsts.agg(F.sum("n"), F.count("*")).first()
    n_keys = counts[0] or 0
    if n_keys == counts[1]:
        entries = entries.withColumn("occurrence", F.lit(0).cast("long"))
    else:
        again = firsts.where("n > 1").select(F.col("doc_id").alias("again_id"), "first_no")
        entries = entries.join(again, F.col("doc_id").eqNullSafe(F.col("again_id")), "left").withColumn(
            "occurrence", F.when(F.col("first_no").isNull(), F.lit(0)).otherwise(F.col("row_no") - F.col("first_no")).cast("long"))
    n_parts = max(1, -(-n_keys // PART_KEYS))
    keys = entries.select("doc_id", "occurrence")
    indexed = _keyed(entries, n_parts).select("part", "key_id", "occurrence", *_PLACES)
    index = store(indexed.groupBy("part").applyInPandas(_build_part, _INDEX), "index")
    return TokenStore(blocks, shards, keys, index, n_parts, width)


def look_up(kept: TokenStore, keys: DataFrame) -> DataFrame:
    """``doc_id, occurrence, found, shard, block, offset, n_tokens`` of distinct keys ``(doc_id, occurrence)``."""
    wanted = _keyed(keys.select("doc_id", "occurrence"), kept.n_parts)
    shape = "doc_id long, occurrence long, found boolean, " + ", ".join(f"{p} int" for p in _PLACES)
    return wanted.groupBy("part").cogroup(kept.index.groupBy("part")).applyInPandas(_look_up, shape)


def _read_ids(width: int):
    def run(batches):
        names = ["doc_id", "occurrence", "start", "n_tokens", "ids"]
        for batch in batches:
            for i, (first, payload, docs) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)))):
                ids = np.frombuffer(payload, dtype=f"<u{width}").astype("<u4")
                parts = [ids[d["offset"] : d["offset"] + d["n_tokens"]].tobytes() for d in docs]
                yield pa.RecordBatch.from_arrays([
                    pa.array([d["doc_id"] for d in docs], pa.int64()), pa.array([d["occurrence"] for d in docs], pa.int64()),
                    pa.array([first + d["offset"] for d in docs], pa.int64()), pa.array([len(p) // 4 for p in parts], pa.int64()),
                    pa.array(parts, pa.binary())], names=names)

    return run


def read_ids(kept: TokenStore, keys: DataFrame) -> DataFrame:
    """``doc_id, occurrence, start, n_tokens, ids`` (unsigned 32-bit, little-endian) of the keys that the store has.

    Places come from the index. Documents wanted from one block are gathered first (a block's worth at most), so each payload moves once.
    """
    place = look_up(kept, keys).where("found")
    wanted = place.groupBy("shard", "block").agg(F.collect_list(F.struct("doc_id", "occurrence", "offset", "n_tokens")).alias("docs"))
    there = kept.blocks.select("shard", "block", "first_id", "payload").join(wanted, ["shard", "block"]).join(kept.shards, "shard")
    return there.select((F.col("shard_start") + F.col("first_id")).alias("first"), "payload", "docs").mapInArrow(
        _read_ids(kept.width), "doc_id long, occurrence long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a store of ``docs`` and read every document back by key: ``doc_id, start, n_tokens, ids_crc32``."""
    kept = write_store(docs, tokenizer_path, id_col, text_col)
    return read_ids(kept, kept.keys).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
