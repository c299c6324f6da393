"""Removal of 50-word passages that an earlier document has, behind a count-min prefilter.

The *anchor* of a window is the smallest 25-word hash inside it. Equal windows have equal anchors, and neighbouring windows
share them: a document is a sequence of runs of about 14 windows with one anchor.

1. Every task counts anchors in a count-min sketch; the tasks' sketches are merged cell by cell (saturating at two)
   in two bounded rounds and the merged one, of fixed size, is broadcast. A cell never undercounts, so no repeated window is
   lost; a full sketch only lets more windows pass.
2. Runs whose anchor may be repeated are grouped exactly by anchor. Where all runs of an anchor are the same words, its windows are in these
   documents and no others: the smallest document keeps the run, in the others it goes.
3. Where an anchor has different runs (at the edges of passages and around edits), its windows are grouped exactly by a 128-bit
   hash of each window, to the same end. Those anchors reach the tasks as a bitmap of the same fixed size; a false hit only means that a
   window is looked at twice.

Windows are judged on the input. Groups are reduced before the shuffle and joined back by key, so a hot passage stays splittable.

A null text has no words. A null id counts as larger than every other id (and not smaller than another null id), so such a document can
lose words but never takes any. Rows with equal ids never take words from each other. Texts under 50 words
keep all. Rows are found again by id and text hash, so repeated rows get equal results. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagline.llm.scratch import bound_batches, store
from lagline.llm.words import Rolling, TextHashes, mix, odd_numbers, texts_of

WINDOW, ANCHOR = 50, 25
# Only periodic texts have runs of more windows than an anchor can cover; shorter runs keep rolling hashes free of cancelling terms.
RUN = 64
# The sketch has DEPTH rows of 2**WIDTH_BITS cells; one bit of each (6 MB) is broadcast.
DEPTH, WIDTH_BITS, BLOCK_BITS = 3, 24, 18
_MERGED_AT_ONCE = 64

_CELLS = odd_numbers(DEPTH, 21)


class Windows:
    """The windows of a batch of texts, as arrays: document number, start in all words, anchor."""

    def __init__(self):
        self.hashes = TextHashes()
        self.grams, self.runs = Rolling(ANCHOR, 22), Rolling(WINDOW, 25)
        self.first, self.second = Rolling(WINDOW, 23), Rolling(WINDOW, 24)

    def read(self, texts: list[bytes]) -> None:
        self.codes, sizes = self.hashes.read(texts)
        self.offsets = np.cumsum(sizes) - sizes
        per_text = np.maximum(sizes - WINDOW + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), per_text)
        self.start = np.arange(len(self.text)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + self.offsets[self.text]
        self.anchor = self._smallest()[self.start] if len(self.text) else np.empty(0, dtype=np.uint64)

    def _smallest(self) -> np.ndarray:
        low, width, span = self.grams.of(self.codes), 1, WINDOW - ANCHOR + 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        return np.minimum(low[: len(low) - (span - width)], low[span - width :])

    def run_starts(self) -> np.ndarray:
        """Window numbers where the anchor or the text changes, and within long runs every ``RUN`` windows after such a place."""
        if not len(self.text):
            return np.empty(0, dtype=np.int64)
        change = (self.anchor[1:] != self.anchor[:-1]) | (self.text[1:] != self.text[:-1])
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        parts = -(-np.diff(np.append(starts, len(self.text))) // RUN)
        return np.repeat(starts, parts) + RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))


def _cell(anchors: np.ndarray, row: int) -> np.ndarray:
    return (mix(anchors * _CELLS[row]) >> np.uint64(64 - WIDTH_BITS)).astype(np.int64)


_PLANES = pa.schema([("task", pa.int32()), ("row", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_PLANE_SHAPE = "task int, row int, block int, once binary, twice binary"


def _anchors_of_texts():
    windows = Windows()

    def read(column: pa.Array) -> np.ndarray:
        windows.read(texts_of(column))
        return windows.anchor[windows.run_starts()]

    return read


def _anchors_as_they_are():
    return lambda column: column.to_numpy().view(np.uint64)


def _sketch(reader):
    def run(batches):
        read, counts = reader(), np.zeros((DEPTH, 1 << WIDTH_BITS), dtype=np.uint8)
        with np.errstate(over="ignore"):
            for batch in batches:
                anchors = read(batch.column(0))
                for row in range(DEPTH):
                    at, n = np.unique(_cell(anchors, row), return_counts=True)
                    counts[row, at] = np.minimum(counts[row, at] + n, 2)
        task = TaskContext.get().partitionId()
        for row in range(DEPTH):
            blocks = counts[row].reshape(-1, 1 << BLOCK_BITS)
            for block in np.flatnonzero(blocks.any(axis=1)):
                cells = blocks[block]
                yield pa.RecordBatch.from_pylist([{
                    "task": task, "row": row, "block": int(block),
                    "once": np.packbits(cells >= 1).tobytes(), "twice": np.packbits(cells >= 2).tobytes()}], schema=_PLANES)

    return run


def _merge(batches):
    once, twice, task = {}, {}, TaskContext.get().partitionId()
    for batch in batches:
        for r in batch.to_pylist():
            key = r["row"], r["block"]
            a1, a2 = np.frombuffer(r["once"], dtype=np.uint8), np.frombuffer(r["twice"], dtype=np.uint8)
            if key in once:
                twice[key] = twice[key] | a2 | (once[key] & a1)
                once[key] = once[key] | a1
            else:
                once[key], twice[key] = a1, a2
    for (row, block), plane in once.items():
        yield pa.RecordBatch.from_pylist([{
            "task": task, "row": row, "block": block, "once": plane.tobytes(), "twice": twice[row, block].tobytes()}], schema=_PLANES)


def sketch_bits(rows: DataFrame, reader, plane: str) -> bytes:
    """The merged sketch of all tasks: one bit per cell, set where the cell was hit ``once`` or more, or ``twice`` or more."""
    partial = rows.mapInArrow(_sketch(reader), _PLANE_SHAPE)
    some = partial.repartition(F.col("row"), F.col("block"), F.col("task") % _MERGED_AT_ONCE).mapInArrow(_merge, _PLANE_SHAPE)
    merged = some.repartition("row", "block").mapInArrow(_merge, _PLANE_SHAPE).select("row", "block", plane)  # 64 rows a block at most
    bits = np.zeros((DEPTH, 1 << (WIDTH_BITS - 3)), dtype=np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    for row, block, found in merged.collect():  # as many as the sketch has blocks
        bits[row, block * size : (block + 1) * size] = np.frombuffer(found, dtype=np.uint8)
    return bits.tobytes()


def _hits(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    found = np.ones(len(anchors), dtype=bool)
    for row in range(DEPTH):
        at = _cell(anchors, row)
        found &= (bits[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return found


def _rows(batch: pa.RecordBatch, text: np.ndarray, names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    at = pa.array(text)
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, columns)], names=["doc_id", "text_key", *names])


def _repeated_runs(shared):
    """Runs of windows whose anchor may be in two documents."""
    def run(batches):
        windows, bits = Windows(), np.frombuffer(shared.value, dtype=np.uint8).reshape(DEPTH, -1)
        with np.errstate(over="ignore"):
            for batch in batches:
                windows.read(texts_of(batch.column(2)))
                starts = windows.run_starts()
                sizes = np.diff(np.append(starts, len(windows.text)))
                good = _hits(bits, windows.anchor[starts])
                starts, sizes = starts[good], sizes[good]
                text, begin = windows.text[starts], windows.start[starts]
                words = windows.runs.span(windows.runs.sums(windows.codes), begin, begin + sizes + WINDOW - 1)
                yield _rows(
                    batch, text, ["anchor", "run", "start", "size"], windows.anchor[starts].view(np.int64), words.view(np.int64),
                    (begin - windows.offsets[text]).astype(np.int32), sizes.astype(np.int32))

    return run


def _unclear_windows(shared):
    """Windows whose anchor may be one with different runs."""
    def run(batches):
        windows, bits = Windows(), np.frombuffer(shared.value, dtype=np.uint8).reshape(DEPTH, -1)
        with np.errstate(over="ignore"):
            for batch in batches:
                windows.read(texts_of(batch.column(2)))
                starts = windows.run_starts()
                good = _hits(bits, windows.anchor[starts])
                at = np.flatnonzero(np.repeat(good, np.diff(np.append(starts, len(windows.text)))))
                text, begin = windows.text[at], windows.start[at]
                hashes = [x.span(x.sums(windows.codes), begin, begin + WINDOW).view(np.int64) for x in (windows.first, windows.second)]
                yield _rows(batch, text, ["start", "h1", "h2"], (begin - windows.offsets[text]).astype(np.int32), *hashes)

    return run


def _cut(batches):
    for batch in batches:
        sizes, removed, kept = [], [], []
        for text, cuts in zip(texts_of(batch.column(1)), batch.column(2)):
            words = text.split()
            sizes.append(len(words))
            if cuts.is_valid:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                begin, size = (cuts.values.field(name).to_numpy() for name in ("start", "size"))
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + size + WINDOW - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            removed.append(sizes[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
        ], names=["doc_id", "n_words", "n_removed", "kept_text"])


# A group of equal runs or windows that two documents have, and who loses it.
_REPEATED = "last_id > first_id OR (nameless AND first_id IS NOT NULL)"
_LATER = "doc_id IS NULL OR doc_id > first_id"


def _owners() -> list:
    return [F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.max(F.col("doc_id").isNull()).alias("nameless")]


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every row of ``docs``; kept words are joined by one space."""
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.col(f"`{text_col}`").cast("string")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    repeated = spark.sparkContext.broadcast(sketch_bits(plain.select("text"), _anchors_of_texts, "twice"))
    runs = store(plain.mapInArrow(_repeated_runs(repeated), "doc_id long, text_key long, anchor long, run long, start int, size int"), "runs")

    anchors = store(runs.groupBy("anchor").agg(*_owners(), F.min("run").alias("one"), F.max("run").alias("other")).where(_REPEATED).select(
        "anchor", "first_id", (F.col("one") == F.col("other")).alias("clear")), "anchors")
    whole = runs.join(anchors.where("clear"), "anchor").where(_LATER).select("doc_id", "text_key", "start", "size")

    unclear = spark.sparkContext.broadcast(sketch_bits(anchors.where("NOT clear").select("anchor"), _anchors_as_they_are, "once"))
    windows = plain.mapInArrow(_unclear_windows(unclear), "doc_id long, text_key long, start int, h1 long, h2 long")
    first = windows.groupBy("h1", "h2").agg(*_owners()).where(_REPEATED).select("h1", "h2", "first_id")
    single = windows.join(first, ["h1", "h2"]).where(_LATER).select("doc_id", "text_key", "start", F.lit(1).alias("size"))

    cuts = whole.unionByName(single).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "size")).alias("cuts")).withColumnsRenamed(
        {"doc_id": "cut_id", "text_key": "cut_key"})
    marked = plain.join(cuts, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("text_key") == F.col("cut_key")), "left")
    return marked.select("doc_id", "text", "cuts").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")
