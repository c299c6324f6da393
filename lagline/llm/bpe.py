"""Byte-level BPE encoding by a priority queue of merge ranks, and decoding by vocabulary strings.

Encoding. A text is split at the vocabulary's added tokens, which are matched as written, then into pieces before every space that a
non-space follows: pre-tokens never cross such a place. A piece is cut by the tokenizer file's own pre-tokenizer; each
pre-token is a doubly linked list of byte symbols, and a heap holds the rank and place of every adjacent pair that the vocabulary
merges. The lowest rank, leftmost first, is merged; its neighbours' new pairs are pushed, and entries whose symbols have
changed since are stale and skipped. A pre-token of n bytes costs n log n, however long it is. Pieces and pre-tokens seen before come from
a cache of bounded size, which a worker process keeps from task to task.

Decoding looks up every id's vocabulary string, joins the strings and reads the bytes as UTF-8 (what is not UTF-8 becomes U+FFFD).

Rows are encoded where they lie, without a shuffle. A null text is empty, an empty text has no ids; texts are read whole, in
chunks of about a million characters, so a very long one needs little more than its ids. Null or repeated document ids are kept as
they are, one row in, one row out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import re
import sys
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagline.llm.scratch import bound_batches

CHUNK_CHARS = 1 << 20
# Ids of one result batch; a longer text is a batch of its own.
BATCH_IDS = 1 << 20

_CACHED_PIECES = 300_000
_CACHED_CHARS = 64
_CUT = re.compile(r"(?= \S)")
_WIDE_SPACE = re.compile(r" (?:\s|\Z)")
# Fixed value: how byte-level tokenizers cut pre-tokens. Below U+0530 every version of Unicode has the same letters, numbers and
# spaces; pieces with other characters are cut by the tokenizer library itself.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SETTLED = "\u0530"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Vocabulary:
    """Symbols, merges and added tokens of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model, steps = parts["model"], parts["pre_tokenizer"] or {}
        if model["type"] != "BPE" or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or parts["normalizer"] or (
                model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback")):
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in parts["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not supported")
        self.path, ids = path, model["vocab"]
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        letters = byte_letters()
        self.first = [ids[letter] for letter in letters]
        # Rank of each pair, by its left symbol, then its right one; the last entry, for -1, is of no symbol.
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(ids.values()) + 2)]
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[left]].setdefault(ids[right], rank)
            self.made.append(ids[left + right])
        as_byte = {letter: b for b, letter in enumerate(letters)}
        self.strings = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for string, i in [*ids.items(), *self.added.items()]:
            self.strings[i] = bytes(map(as_byte.__getitem__, string)) if as_byte.keys() >= set(string) else string.encode()

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; ids that the vocabulary does not have stand for nothing."""
        known = self.strings
        try:
            return b"".join(map(known.__getitem__, ids)).decode("utf-8", "replace")
        except IndexError:
            return b"".join(known[i] for i in ids if i < len(known)).decode("utf-8", "replace")


    def encode_word(self, word: bytes) -> list[int]:
        """Ids of a pre-token: always the pair of lowest rank, leftmost first, is merged."""
        n = len(word)
        symbols, ranks, made = list(map(self.first.__getitem__, word)), self.ranks, self.made
        # A queue entry is one number: the rank, then the place of the left symbol.
        shift = n.bit_length()
        places = (1 << shift) - 1
        queue = [rank << shift | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (rank := ranks[a].get(b)) is not None]
        if not queue:
            return symbols
        heapify(queue)
        # Place n ends the list on both sides; -1 is no symbol, so pairs with it have no rank.
        symbols.append(-1)
        before, after = list(range(-1, n)), list(range(1, n + 2))
        while queue:
            entry = heappop(queue)
            i, rank = entry & places, entry >> shift
            right = after[i]
            if ranks[symbols[i]].get(symbols[right]) != rank:
                continue  # stale: one of its symbols was merged meanwhile
            new, nxt, left = made[rank], after[right], before[i]
            symbols[i], symbols[right], after[i], before[nxt] = new, -1, nxt, i
            rank = ranks[new].get(symbols[nxt])
            if rank is not None:
                heappush(queue, rank << shift | i)
            rank = ranks[symbols[left]].get(new)
            if rank is not None:
                heappush(queue, rank << shift | left)
        return [s for s in symbols if s >= 0]


class _Cache(dict):
    """Text -> ids, worked out when missing; long texts are not kept.

    A full cache becomes the older half, which is asked before anything is worked out again, so frequent texts stay.
    """

    def __init__(self, find):
        self.find, self.older = find, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        found = self.older.get(text)
        if found is None:
            found = self.find(text)
        if len(text) <= _CACHED_CHARS:
            if len(self) >= _CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class Encoder:
    """Texts to ids."""

    def __init__(self, vocabulary: Vocabulary):
        import regex
        from tokenizers import Tokenizer

        self.vocabulary = vocabulary
        self.plain_cut = regex.compile(PRE_TOKENS).findall
        self.library_cut = Tokenizer.from_file(vocabulary.path).pre_tokenizer.pre_tokenize_str
        self.pieces = _Cache(self._ids)
        # By the piece without the space that it begins with.
        self.spaced = _Cache(self._spaced_ids)
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if vocabulary.added else None

    def cut(self, piece: str) -> list[str]:
        """The piece's pre-tokens."""
        if piece and max(piece) < _SETTLED:
            return self.plain_cut(piece)
        return [piece[a:b] for _, (a, b) in self.library_cut(piece)]

    def _ids(self, piece: str) -> tuple[int, ...]:
        parts = self.cut(piece)
        if len(parts) == 1:
            return tuple(self.vocabulary.encode_word(piece.encode()))
        return tuple(chain.from_iterable(self.spaced[p[1:]] if p[0] == " " and not p[1:2].isspace() else self.pieces[p] for p in parts))

    def _spaced_ids(self, rest: str) -> tuple[int, ...]:
        if rest.isalpha() and max(rest) < _SETTLED:
            return tuple(self.vocabulary.encode_word(b" " + rest.encode()))  # a space and letters are one pre-token
        return self._ids(" " + rest)

    def _chunk(self, chunk: str) -> np.ndarray:
        if _WIDE_SPACE.search(chunk):
            found = map(self.pieces.__getitem__, _CUT.split(chunk))
        else:
            # Every space begins a piece; the first piece may lack it.
            rest = iter(chunk.split(" "))
            found = chain([self.pieces[next(rest)]], map(self.spaced.__getitem__, rest))
        return np.fromiter(chain.from_iterable(found), dtype=np.int32)

    def encode(self, text: str) -> np.ndarray:
        parts = self.marks.split(text) if self.marks else [text]
        found = []
        for i, part in enumerate(parts):
            if i % 2:
                found.append(np.array([self.vocabulary.added[part]], dtype=np.int32))
            else:
                found += map(self._chunk, chunks(part))
        return np.concatenate(found) if found else np.empty(0, dtype=np.int32)


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut where no pre-token can cross."""
    at = 0
    while at < len(text):
        place = _CUT.search(text, at + size) if at + size < len(text) else None
        stop = place.start() if place else len(text)
        yield text[at:stop]
        at = stop


def worker_encoder(path: str) -> Encoder:
    """The encoder of this worker process, which keeps its vocabulary and caches from task to task."""
    # A module of its own in the worker: this one's globals come anew with every task.
    kept = sys.modules.setdefault("lagline_bpe_worker", ModuleType("lagline_bpe_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(Vocabulary(path))
        gc.freeze()  # the vocabulary stays, so collections need not walk it
    return kept[path]


def _encode(path: str):
    def run(batches):
        encoder = worker_encoder(path)

        def out() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids], names=["doc_id", "ids"])

        for batch in batches:
            keys, found, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key), found.append(encoder.encode(text.as_py() or ""))
                size += len(found[-1])
                if size >= BATCH_IDS:
                    yield out()
                    keys, found, size = [], [], 0
            if keys:
                yield out()

    return run


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text, without special tokens around it."""
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return plain.mapInArrow(_encode(tokenizer_path), "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches):
        vocabulary = worker_encoder(path).vocabulary
        for batch in batches:
            ids, edges = batch.column(1), batch.column(1).offsets.to_numpy()
            flat = ids.values.fill_null(len(vocabulary.strings)).to_numpy()  # a null id is none of the vocabulary's
            texts = [vocabulary.decode(flat[a:b].tolist()) if known else "" for a, b, known in zip(edges, edges[1:], ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return run


def decode_ids(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, text``: the text of every array of ids, special tokens included; null ids are an empty text."""
    bound_batches(encoded.sparkSession)
    plain = encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return plain.mapInArrow(_decode(tokenizer_path), "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, text``: every text encoded, and decoded again from its ids."""
    return decode_ids(encode_texts(docs, tokenizer_path, id_col, text_col), tokenizer_path)
