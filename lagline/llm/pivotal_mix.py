"""Mixing sources to target sizes by pivotal dependent rounding.

A source with target T and total size S takes every document T / S times on average. The whole part is taken by all; the
fractional part p becomes 0 or 1 by the pivotal method: of two undecided documents one passes mass to the other until one of
them is decided. Mass is counted in words, so each pass keeps the source's expected words exactly; which of the
two directions it takes is random with the probabilities that leave every document's expectation unchanged. One
document at most stays undecided, so a source ends within one document's size of its target.

The passing runs in a reduction tree: groups of some thousand documents of a source (dealt by hash of id and text, so a
source of any size is split; rows of one id and text that would fill a group alone are dealt by their row numbers as well) each leave one undecided document, those meet in groups again, until
each source has one, which is rounded at random. Random numbers are hashes of the id and the level, so reruns agree.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating, and share ``share`` of all sizes; a target stops
at ``most`` times its source's size and the excess is shared again by weight.

Null and empty texts have size 0 and are never taken. Rows with null ids take part like others; repeated
rows are mixed each by itself. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagline.llm.scratch import bound_batches, store
from lagline.llm.words import word_array

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
# Documents per group on average at the lowest level, residuals per group above.
GROUP, FAN_IN = 4096, 512


def targets(sizes: list[tuple[str | None, int]], share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> dict[str | None, float]:
    """Target size per source."""
    ordered = sorted((s for s, _ in sizes if s is not None)) + [None] * any(s is None for s, _ in sizes)
    size = dict(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    left, open_, out = share * sum(size.values()), list(ordered), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= most * size[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * size[s]
        left = max(0.0, left - sum(out[s] for s in full))
        open_ = [s for s in open_ if s not in full]
    return out


def _uniform(*parts: object) -> float:
    return int.from_bytes(blake2b(repr(parts).encode(), digest_size=7).digest(), "big") / (1 << 56)


def pivot(rows: list[tuple[int, float, str]], seed: str) -> tuple[list[int], int | None, float]:
    """Round ``(size, p, name)`` one after the other: the rows that are taken, the one left undecided and its p."""
    taken, held, mass = [], None, 0.0
    for i, (size, p, name) in enumerate(rows):
        if p <= 0 or size <= 0:
            continue
        if p >= 1:
            taken.append(i)
            continue
        if held is None:
            held, mass = i, p
            continue
        a, b = rows[held][0], size
        # the held row gains x words from this one, or gives y words to it
        x, y = min((1 - mass) * a, p * b), min(mass * a, (1 - p) * b)
        if _uniform(seed, rows[held][2], name) * (x + y) < y:
            up, down = mass + x / a, p - x / b
            decided_held, decided_this = (1 - mass) * a <= p * b, p * b <= (1 - mass) * a
        else:
            up, down = mass - y / a, p + y / b
            decided_held, decided_this = mass * a <= (1 - p) * b, (1 - p) * b <= mass * a
        if decided_held and round(up):
            taken.append(held)
        if decided_this and round(down):
            taken.append(i)
        if decided_held and decided_this:
            held = None
        elif decided_held:
            held, mass = i, down
        else:
            mass = up
    return taken, held, mass


def _level(level: int):
    def run(key, rows):
        rows = rows.sort_values(["order", "row"], kind="stable").reset_index(drop=True)
        taken, held, mass = pivot(list(zip(rows["size"].tolist(), rows["p"].tolist(), rows["order"].tolist())), f"{level}")
        state = np.zeros(len(rows))
        state[taken] = 1
        if held is not None:
            state[held] = mass
        return rows.assign(p=state, open=[i == held for i in range(len(rows))])

    return run


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with a ``cell`` below ``groups``: by ``order``, and by ``row`` as well where an order has more rows than a group."""
    repeated = store(rows.groupBy("order").count().where(F.col("count") > GROUP).select(F.col("order").alias("of"), F.ceil(F.col("count") / GROUP).alias("spread")), "repeated")
    share = F.pmod(F.xxhash64("row"), F.col("spread"))  # null, and so without effect on the hash, for other rows
    return rows.join(repeated, F.col("order") == F.col("of"), "left").withColumn("cell", F.pmod(F.xxhash64("order", share), "groups")).drop("of", "spread")


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``row, doc_id, source, size, source_size, target, copies``.

    ``row_col`` names a column that numbers the rows; without it they are numbered here.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.col(f"`{text_col}`").cast("string")
    sized = store(docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.size(word_array(text)).cast("long").alias("size"), F.xxhash64(text).alias("text_key"),
        F.col(row_col).alias("row") if row_col else F.monotonically_increasing_id().alias("row")), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    found = totals.collect()  # one row per source, the mix's own parameters
    size = {r.source: r.source_size for r in found}
    target = targets(list(size.items()))
    rate = {s: target[s] / size[s] if size[s] else 0.0 for s in size}
    plan = spark.createDataFrame(
        [(r.source, size[r.source], float(target[r.source]), int(rate[r.source]), rate[r.source] - int(rate[r.source]), max(1, -(-r.n // GROUP))) for r in found],
        "source string, source_size long, target double, whole int, part double, groups long").withColumnRenamed("source", "of")
    planned = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # A random order that reruns share: hash of id and text, not of where a row was read.
    order = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_key").cast("string")), 256)
    rows = dealt(planned.withColumns({"order": order, "p": F.col("part")}))

    named = ("doc_id", "source", "text_key", "row", "size", "order", "p", "cell")
    shape = T.StructType([*(rows.schema[c] for c in named), T.StructField("open", T.BooleanType())])
    current, most_groups, decided, level = rows.where("p > 0 AND size > 0").select(*named), max([1, *(-(-r.n // GROUP) for r in found)]), [], 0
    while True:
        done = store(current.groupBy("source", "cell").applyInPandas(_level(level), shape), f"pivot-{level}")
        if most_groups == 1:
            break
        decided.append(done.where("NOT open"))
        most_groups, level = -(-most_groups // FAN_IN), level + 1
        current = done.where("open").drop("open").withColumn("cell", F.pmod(F.floor(F.col("cell") / FAN_IN), F.lit(most_groups)))
    # the last undecided document of each source
    chance = (F.conv(F.substring(F.sha2(F.concat("order", F.lit("last")), 256), 1, 12), 16, 10).cast("double")) / float(1 << 48)
    last = done.withColumn("p", F.when(F.col("open"), (chance < F.col("p")).cast("double")).otherwise(F.col("p")))
    every = last
    for more in decided:
        every = every.unionByName(more)
    picked = every.where("p > 0.5").select(F.col("row").alias("picked"))
    return planned.join(picked, F.col("row") == F.col("picked"), "left").select(
        "row", "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.col("whole") + F.col("picked").isNotNull().cast("int")).otherwise(0).cast("int").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    numbered = store(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    chosen = copies(numbered, id_col, text_col, source_col, row_col="__row").where("copies > 0").select(
        F.col("row").alias("__taken"), F.col("copies").alias("__copies"))
    return numbered.join(chosen, F.col("__row") == F.col("__taken")).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[numbered[f"`{c}`"] for c in docs.columns])
