"""Near duplicates on word shingles: MinHash bands, sequential Bayesian pruning, exact verification.

1. Every document becomes its set of distinct 5-word shingles (64-bit hashes), a 128-fold MinHash signature and 32
   band keys of four values each. Equal sets are one node from here on, so copies cost nothing later.
2. Nodes that share a band are candidates. Their signatures are compared in batches of 16 values: with a uniform prior, the
   posterior probability that the similarity reaches the threshold after m of n matches is a binomial tail; a pair
   is given up as soon as it falls below ``miss``. Signature values are stored as one byte; a byte matches by chance
   in 1 of 256 cases, which only ever keeps a pair longer.
3. Survivors are verified on the full sets.

A bucket of any size is never expanded into all its pairs. Buckets hold sets of similar size only (others cannot
reach the threshold). Every member is first compared with one centre of its bucket, the one whose bands are the most
common, so a group of near copies shares one centre; verified links give nodes common labels. Buckets are then united by
centre, which drops the repetitions of a group over its bands, and only where two labels are left, members of *different* labels are compared,
in blocks of bounded size: 512-fold signatures in batches, the survivors verified on the spot. A block keeps track of what it has
linked and yields only links that join two labels. Pairs under one label cannot change a component, so nothing is lost.

Documents without words link with nothing and are their own component. Null ids form no component of their own: a component's id is its
smallest non-null id, and null if there is none (then ``kept`` is true, but ``keep_first_of_each`` keeps one row). Repeated rows are copies of each other. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagline.llm.components import connected_components
from lagline.llm.scratch import bound_batches, drop, store
from lagline.llm.words import TextHashes, mix, odd_numbers, texts_of

SHINGLE = 5
BANDS, ROWS = 32, 4
BATCH = 16
# Similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 75, 100
MISS = 1e-7
# Signature values where what is still open is compared in blocks, and shingles per block.
LONG = 512
BLOCK_SHINGLES = 400_000

_MIX = odd_numbers(SHINGLE, 11)
_SHORT = odd_numbers(SHINGLE, 12)
_SCALE, _SHIFT = odd_numbers(LONG, 13), mix(odd_numbers(LONG, 14))
_BAND = odd_numbers(ROWS, 15)


def shingle_sets(texts: list[bytes], hashes: TextHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    codes, sizes = hashes.read([t.lower() for t in texts])
    return [_shingles(words) for words in np.split(codes, np.cumsum(sizes)[:-1])] if len(texts) else []


def _shingles(codes: np.ndarray) -> np.ndarray:
    n = len(codes)
    with np.errstate(over="ignore"):
        if n >= SHINGLE:
            total = sum(codes[i : n - SHINGLE + 1 + i] * _MIX[i] for i in range(SHINGLE))
            return np.unique(mix(total))
        if n:
            return mix(np.atleast_1d((codes * _SHORT[:n]).sum(dtype=np.uint64) + np.uint64(n)))
    return np.empty(0, dtype=np.uint64)


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Minimum of each of the first ``size`` hash functions, in slices so that very long texts stay small in memory."""
    best = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            part = shingles[at : at + 1024]
            values = part[None, :] * _SCALE[:size, None]
            values += _SHIFT[:size, None]
            values ^= values >> np.uint64(32)
            np.minimum(best, values.min(axis=1), out=best)
    return best


def bytes_of(values: np.ndarray) -> bytes:
    """One byte per signature value."""
    return (mix(values) >> np.uint64(56)).astype(np.uint8).tobytes()


def band_keys(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = mix(values).reshape(BANDS, ROWS)
        return mix((rows * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


_SKETCH = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("codes", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sketch(batches):
    hashes = TextHashes()
    for batch in batches:
        sizes, keys, codes, bands = [], [], [], []
        for shingles in shingle_sets(texts_of(batch.column(3)), hashes):
            sizes.append(len(shingles))
            if not len(shingles):
                keys.append(None), codes.append(None), bands.append(None)
                continue
            values = signature(shingles)
            keys.append(blake2b(shingles.tobytes(), digest_size=16).digest())
            codes.append(bytes_of(values))
            bands.append(band_keys(values))
        yield pa.record_batch([
            batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(codes, pa.binary()),
            pa.array(bands, pa.list_(pa.int64()))], schema=_SKETCH)


def least_matches(threshold: float, miss: float, batch: int = BATCH, total: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """After each n signature values, the fewest matches with P(similarity >= threshold | matches) >= miss.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), whose upper tail at t is
    P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, total + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs (left row x, right row y) of signatures survive all batches."""
    alive, matches = np.arange(len(x)), np.zeros(len(x), dtype=np.int16)
    for end, least in bounds:
        part = slice(end - BATCH, end)
        matches = matches + (left[x[alive], part] == right[y[alive], part]).sum(axis=1, dtype=np.int16)
        going = matches >= least
        alive, matches = alive[going], matches[going]
    return alive


def _codes(column: pa.Array, size: int = BANDS * ROWS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), size)


def similar(left: np.ndarray, right: np.ndarray) -> bool:
    """The threshold on two whole sets."""
    if DENOMINATOR * min(len(left), len(right)) < NUMERATOR * max(len(left), len(right)):
        return False
    both = np.concatenate([left, right])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return DENOMINATOR * shared >= NUMERATOR * (len(left) + len(right) - shared)


def _prune(miss: float):
    bounds = least_matches(NUMERATOR / DENOMINATOR, miss)

    def run(batches):
        for batch in batches:
            rows = np.arange(batch.num_rows)
            alive = pa.array(surviving(_codes(batch.column(2)), _codes(batch.column(3)), rows, rows, bounds))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(alive) for i in (0, 1)], names=["a", "b"])

    return run


def _long_rows(batches):
    hashes = TextHashes()
    for batch in batches:
        sets = shingle_sets(texts_of(batch.column(1)), hashes)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([bytes_of(signature(x, LONG)) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
            names=["node", "codes", "shingles"])


class _Block:
    """Members of one block, or of two to be held against each other."""

    def __init__(self, low: int, high: int, rows: list[list]):
        node, n, label, block = (np.concatenate([r[i] for r in rows]) for i in range(4))
        self.low, self.high, self.node, self.n, self.block = low, high, node, n, block
        self.codes = np.concatenate([r[4] for r in rows])
        self.sets = [np.frombuffer(x, dtype=np.uint64) for r in rows for x in r[5]]
        names, self.label = np.unique(label, return_inverse=True)
        self.parent = list(range(len(names)))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def links(self, bounds: list[tuple[int, int]]):
        """Linked pairs of nodes that join two labels."""
        same = self.low == self.high
        x, y = (np.arange(len(self.node)),) * 2 if same else (np.flatnonzero(self.block == self.low), np.flatnonzero(self.block == self.high))
        for at in range(0, len(x), 256):
            rows = x[at : at + 256, None]
            roots = np.array([self.find(i) for i in range(len(self.parent))])[self.label]
            open_ = roots[rows] != roots[y]
            open_ &= DENOMINATOR * np.minimum(self.n[rows], self.n[y]) >= NUMERATOR * np.maximum(self.n[rows], self.n[y])
            if same:
                open_ &= self.node[rows] < self.node[y]
            i, k = np.nonzero(open_)
            i, k = x[at + i], y[k]
            for alive in surviving(self.codes, self.codes, i, k, bounds).tolist():
                a, b = int(i[alive]), int(k[alive])
                left, right = self.find(self.label[a]), self.find(self.label[b])
                if left != right and similar(self.sets[a], self.sets[b]):
                    self.parent[left] = right
                    yield int(self.node[a]), int(self.node[b])


def _compare_blocks(miss: float):
    """Rows sorted by (centre, low, high): the members of one or two blocks of a centre, compared across labels."""
    bounds = least_matches(NUMERATOR / DENOMINATOR, miss, total=LONG)

    def out(key: tuple, rows: list[list]) -> pa.RecordBatch:
        found = list(_Block(key[1], key[2], rows).links(bounds))
        return pa.RecordBatch.from_arrays([pa.array([f(p) for p in found], pa.int64()) for f in (min, max)], names=["a", "b"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            numbers = [batch.column(i).to_numpy() for i in range(7)]
            columns = [*numbers[3:], _codes(batch.column(7), LONG), batch.column(8).to_pylist()]
            keys = np.stack(numbers[:3])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for start, end in zip(edges, edges[1:]):
                if start == end:
                    continue
                at = tuple(keys[:, start])
                if at != key and rows:
                    yield out(key, rows)
                    rows = []
                key = at
                rows.append([c[start:end] for c in columns])
        if rows:
            yield out(key, rows)

    return run


class _Sets(OrderedDict):
    """The shingle sets of the texts seen last."""

    def __init__(self, hashes: TextHashes):
        super().__init__()
        self.hashes = hashes

    def of(self, key: int, text: bytes) -> np.ndarray:
        if key not in self:
            if len(self) >= 64:
                self.popitem(last=False)
            self[key] = shingle_sets([text], self.hashes)[0]
        return self[key]


def _verify(batches):
    sets = _Sets(TextHashes())
    for batch in batches:
        good = []
        a, b, ta, tb = batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), texts_of(batch.column(3))
        for i in range(batch.num_rows):
            if similar(sets.of(a[i], ta[i]), sets.of(b[i], tb[i])):
                good.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(good, pa.int64())) for i in (0, 1)], names=["a", "b"])


def _keyed_texts(batches):
    hashes = TextHashes()
    for batch in batches:
        keys = [blake2b(x.tobytes(), digest_size=16).digest() for x in shingle_sets(texts_of(batch.column(2)), hashes)]
        good = pa.array([i for i, (k, want) in enumerate(zip(keys, batch.column(1).to_pylist())) if k == want], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(2).take(good).cast(pa.binary())], names=["node", "body"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept`` for every row of ``docs``; ``text_key`` is a hash of the text."""
    return _classes(docs, id_col, text_col, miss).drop("row", "component")


def _classes(docs: DataFrame, id_col: str, text_col: str, miss: float = MISS, row_col: str | None = None) -> DataFrame:
    """``near_duplicates`` with ``row``, the number of the row in ``row_col``, and ``component``, which ids have no part in and which is null without words."""
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.col(f"`{text_col}`").cast("string")
    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), row.alias("row"), text.alias("text"))
    sketches = store(plain.mapInArrow(
        _sketch, "doc_id long, text_key long, row long, n_shingles long, set_key binary, codes binary, bands array<long>"), "sketches")
    # One node per distinct set, numbered once and for all by the stored table; one of its rows is named by id and text.
    nodes = sketches.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")).alias("one"), F.first("n_shingles").alias("n"),
        F.first("codes").alias("codes"), F.first("bands").alias("bands"))
    nodes = store(nodes.select(
        "set_key", F.col("one.doc_id").alias("first_id"), F.col("one.text_key").alias("first_text"), "n", "codes", "bands",
        F.monotonically_increasing_id().alias("node")), "nodes")
    rows = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count("*").alias("in_band")).where("in_band > 1").select("band")
    # Similar sets are of similar size: each node joins its own size class and the next larger one, a pair shares one of them.
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(DENOMINATOR / NUMERATOR))
    classed = store(rows.join(shared, "band", "left_semi").select(
        "node", "n", F.explode(F.array(*(F.xxhash64("band", size_class + i) for i in (0, 1)))).alias("band")), "classed")
    mass = classed.join(classed.groupBy("band").agg(F.count("*").alias("in_band")), "band").groupBy("node").agg(F.sum("in_band").alias("mass"))
    weighed = classed.join(mass, "node")
    # the smallest (-mass, node) as one struct of longs
    first = F.min(F.struct((-F.col("mass")).alias("mass"), F.col("node").alias("centre")))
    centres = weighed.groupBy("band").agg(F.count("*").alias("in_band"), first.alias("c")).where("in_band > 1").select("band", "c.centre")
    members = store(classed.join(centres, "band").select("centre", "node", "n").distinct(), "members")
    signed = store(nodes.join(members.select("node").distinct(), "node", "left_semi").select(
        "node", "set_key", "first_id", "first_text", "codes"), "signed")
    texts = store(
        plain.join(
            signed.select("node", "first_id", "first_text", "set_key"),
            F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_text"))).select("node", "set_key", "text")
        .mapInArrow(_keyed_texts, "node long, body binary").dropDuplicates(["node"]), "texts")

    side = lambda table, key, value, to: table.select(F.col("node").alias(key), F.col(value).alias(to))
    pairs = members.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    likely = (pairs.join(side(signed, "a", "codes", "ca"), "a").join(side(signed, "b", "codes", "cb"), "b")
              .select("a", "b", "ca", "cb").mapInArrow(_prune(miss), "a long, b long"))
    starred = store(likely.join(side(texts, "a", "body", "ta"), "a").join(side(texts, "b", "body", "tb"), "b")
                    .select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long"), "links")

    # Nodes that hang on the same neighbour are linked through it, which is enough to see which pairs are still open.
    hooks = starred.groupBy("b").agg(F.min("a").alias("hook"))
    further = hooks.select(F.col("b").alias("h"), F.col("hook").alias("next"))
    labels = hooks.join(further, F.col("hook") == F.col("h"), "left").select("b", F.coalesce("next", "hook").alias("label"))
    labelled = store(members.join(labels, F.col("node") == F.col("b"), "left").select(
        "centre", "node", "n", F.coalesce("label", "node").alias("label")), "labelled")
    open_centres = labelled.groupBy("centre").agg(F.sum("n").alias("shingles"), F.min("label").alias("least"), F.max("label").alias("most")).where(
        "least < most").select("centre", F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    open_ = store(labelled.join(open_centres, "centre").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "open")
    whole = store(open_.select("node").distinct().join(texts, "node").select("node", "body").mapInArrow(
        _long_rows, "node long, codes binary, shingles binary"), "whole")
    dealt = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(whole, "node").select(
        "centre", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "n", "label", "block", "codes", "shingles")
    rest = dealt.repartition("centre", "low", "high").sortWithinPartitions("centre", "low", "high").mapInArrow(_compare_blocks(miss), "a long, b long")
    every = starred.unionByName(rest)
    labels = connected_components(every).withColumnsRenamed({"node": "of"})
    drop(members, texts, labelled, open_, whole)
    named = nodes.select("node", "first_id").join(labels, F.col("node") == F.col("of")).select("node", "first_id", "component")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    grouped = store(named.join(least, "component").select(F.col("node").alias("of"), "component_id", "component"), "grouped")
    ids = nodes.select("set_key", "first_id", "node").join(grouped, F.col("node") == F.col("of"), "left").select(
        "set_key", F.when(F.col("of").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("component", "node").alias("component"))
    out = sketches.select("doc_id", "text_key", "row", "n_shingles", "set_key").join(ids, "set_key", "left").select(
        "doc_id", "text_key", "row", "n_shingles", "component", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = store(out.withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "classes")
    drop(sketches, nodes, signed, classed, starred, grouped)
    return out


def keep_first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the one with the smallest id, null last.

    Repeated rows and rows without an id are in their text's group like others. Without words, rows are a group where id and text are the same.
    """
    numbered = store(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    rows = _classes(numbered, id_col, text_col, row_col="__row")
    wordless = lambda name: F.when(F.col("component").isNull(), F.col(name))
    kept = rows.groupBy("component", wordless("doc_id").alias("of_id"), wordless("text_key").alias("of_text")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("one")).select(F.col("one.row").alias("__kept"))
    return numbered.join(kept, F.col("__row") == F.col("__kept"), "left_semi").drop("__row")
