"""Benchmark passages in documents, with edits, by the pigeonhole principle.

Texts are compared as lower-cased words (runs of letters, digits and underscores). An item of n words may
differ from a passage by k = n // 5 word edits. Cut into k + 1 pieces, an item that occurs with at most k edits has at
least one piece untouched, so documents are searched for exact pieces only (a hash per piece length, one vector
operation per document). Every hit names the place where the item would begin, and Myers' bit-parallel
distance decides there on the words themselves; hash collisions cannot add a match.

Items come from the benchmark in blocks of bounded size. One block at a time is broadcast, held against all documents and given up once its
matches are written, so memory is bounded whatever the benchmark's size; every further block costs one more scan of the documents. No document is
shuffled, so copies and hot words matter to no one.

Null or empty documents match nothing, and items without words match nothing. Null ids are reported as they are, repeated
rows of documents each match, repeated items are reported by each of their ids. Empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagline.llm.scratch import bound_batches, store
from lagline.llm.words import Rolling, WordHashes

WORDS_PER_EDIT = 5
# Items are broadcast in blocks of at most this many words (a longer item is a block of its own).
BLOCK_WORDS = 500_000

_WORD = re.compile(r"\w+")


def plain_words(text: str | None) -> list[bytes]:
    return [w.encode("utf-8", "replace") for w in _WORD.findall((text or "").lower())]


def best_distance(item: list[bytes], words: list[bytes]) -> tuple[int, int]:
    """Fewest edits between ``item`` and any run of ``words``, and where the first such run ends."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[bytes, int] = {}
    for i, word in enumerate(item):
        places[word] = places.get(word, 0) | 1 << i
    plus, minus, score = full, 0, m
    best, end = m, 0
    for i, word in enumerate(words):
        equal = places.get(word, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(horizontal | plus) & full, plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if score < best:
            best, end = score, i + 1
    return best, end


class _Pieces:
    """Pieces of a block of items: per length, sorted hashes and whose piece each is."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]):
        self.items, self.hashes = items, WordHashes()
        cut: dict[int, list[tuple[int, int]]] = {}
        for number, (_, words) in enumerate(items):
            pieces = len(words) // WORDS_PER_EDIT + 1
            edges = [len(words) * p // pieces for p in range(pieces + 1)]
            for a, b in zip(edges, edges[1:]):
                cut.setdefault(b - a, []).append((number, a))
        self.by_length = []
        for length, owners in sorted(cut.items()):
            roll = Rolling(length, 31)
            keys = np.array([roll.of(self.hashes.of(items[n][1][a : a + length]))[0] for n, a in owners], dtype=np.uint64)
            order = np.argsort(keys, kind="stable")
            self.by_length.append((roll, keys[order], [owners[i] for i in order]))

    def starts(self, words: list[bytes]) -> set[tuple[int, int]]:
        """(item number, word where the item would begin) for every piece found."""
        codes, out = self.hashes.of(words), set()
        for roll, keys, owners in self.by_length:
            found = roll.of(codes)
            low = np.searchsorted(keys, found)
            for at in np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == found):
                i = int(low[at])
                while i < len(keys) and keys[i] == found[at]:
                    out.add((owners[i][0], int(at) - owners[i][1]))
                    i += 1
        return out

    def matches(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item id, fewest edits, words of the item) of every item that the text contains."""
        words = plain_words(text)
        best: dict[int, int] = {}
        for number, start in sorted(self.starts(words)):
            item = self.items[number][1]
            budget = len(item) // WORDS_PER_EDIT
            if best.get(number, budget + 1) == 0:
                continue
            edits, _ = best_distance(item, words[max(0, start - budget) : max(0, start + len(item) + budget)])
            if edits <= budget:
                best[number] = min(edits, best.get(number, edits))
        return [(self.items[n][0], d, len(self.items[n][1])) for n, d in sorted(best.items())]


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("item_words", pa.int64())])


def _search(shared):
    def run(batches):
        with np.errstate(over="ignore"):
            pieces = _Pieces(shared.value)
            for batch in batches:
                rows = []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for found in pieces.matches(text):
                        rows.append((i, *found))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.record_batch([ids, *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))], schema=_FOUND)

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    block, size = [], 0
    for item_id, text in benchmark.toLocalIterator():
        words = plain_words(text)
        if not words:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item_id, words))
        size += len(words)
    if block:
        yield block


def contaminations(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, edits, item_words``: one row per document row and benchmark item it contains."""
    spark = docs.sparkSession
    bound_batches(spark)
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = benchmark.select(F.col(f"`{item_col}`").cast("long"), F.col(f"`{item_text_col}`").cast("string"))
    shape = "doc_id long, item_id long, edits long, item_words long"
    out = spark.createDataFrame([], shape)
    for number, block in enumerate(_blocks(items)):
        shared = spark.sparkContext.broadcast(block)
        out = out.unionByName(store(plain.mapInArrow(_search(shared), shape), f"matches-{number}"))
        shared.destroy()
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, whatever their ids."""
    numbered = store(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = contaminations(numbered, benchmark, "__row", text_col, item_col, item_text_col).select(F.col("doc_id").alias("__found")).distinct()
    return numbered.join(found, F.col("__row") == F.col("__found"), "left_anti").drop("__row")
