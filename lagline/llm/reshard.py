"""Moving documents from old shards to shards of new capacities with the fewest bytes moved.

1. Sizes are summed per old shard and block (a block is some ten thousand documents of a shard, dealt by a hash of id and text).
2. A minimum-cost flow from old shards (their bytes) to new ones (their capacities) costs 0 to stay and 1 per byte to move. The
   graph has one node per shard, so it is solved on the driver whatever the data's size.
3. Each flow is a range of the old shard's bytes in block order. Most blocks lie inside one range and move or stay whole;
   a block on a border (one per flow at most) is cut between documents. A document goes where its middle byte lies, so a shard misses its
   capacity by less than a document per flow.
4. Shards that give or take anything are written anew, the others keep their files. Texts are shuffled once, to their files.

Positions are running sums in two steps (block sums, then inside a block), never over a whole shard in one task. What is joined to the
documents has one row per block.
The law is ``bytes``: sizes near equal for equal capacities.

A null text has no bytes and size 1. Null ids, ties and repeated rows are placed one by one; rows that agree in id and text share a block. A null
old shard counts as shard 0. An empty table gives empty shards. Extra
columns are carried along when files are written, but for those named like the results (shard, slot, size, old_shard), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagline.llm.scratch import store

BLOCK_ROWS = 16_384
# Bytes of text per written file, about; a block is not cut over files.
FILE_BYTES = 64 << 20


def cheapest_flow(supply: list[int], capacity: list[int], stays: list[int | None]) -> list[list[int]]:
    """Bytes from each old shard to each new one at the least number of moved bytes.

    ``stays[o]`` is the new shard that old shard ``o`` becomes (None if it goes). Capacities must hold the supply.
    Successive shortest paths over the residual graph of the transport problem.
    """
    n_old, n_new = len(supply), len(capacity)
    cost = [[0 if stays[o] == n else 1 for n in range(n_new)] for o in range(n_old)]
    flow = [[0] * n_new for _ in range(n_old)]
    left, room = list(supply), list(capacity)
    while any(left):
        # Bellman-Ford from all old shards with bytes left: distances of old and new shards.
        far = float("inf")
        d_old, d_new = [0 if x else far for x in left], [far] * n_new
        via_new: list[int | None] = [None] * n_new
        via_old: list[int | None] = [None] * n_old
        changed = True
        while changed:
            changed = False
            for o in range(n_old):
                for n in range(n_new):
                    if d_old[o] + cost[o][n] < d_new[n]:
                        d_new[n], via_new[n], changed = d_old[o] + cost[o][n], o, True
                    if flow[o][n] and d_new[n] - cost[o][n] < d_old[o]:
                        d_old[o], via_old[o], changed = d_new[n] - cost[o][n], n, True
        end = min((n for n in range(n_new) if room[n]), key=lambda n: d_new[n], default=None)
        if end is None:
            raise ValueError("the capacities do not hold all bytes")
        path, n, most = [], end, room[end]
        while True:
            o = via_new[n]
            path.append((o, n, 1))
            if via_old[o] is None:
                most = min(most, left[o])
                break
            n = via_old[o]
            path.append((o, n, -1))
            most = min(most, flow[o][n])
        for o, n, sign in path:
            flow[o][n] += sign * most
        left[path[-1][0]] -= most
        room[end] -= most
    return flow


def equal_capacities(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def affected_shards(flow: list[list[int]]) -> list[int]:
    """New shards that give or take bytes (a shard that keeps all its bytes and takes none is not touched)."""
    moves = [(o, n) for o, row in enumerate(flow) for n, x in enumerate(row) if x and o != n]
    return sorted({n for _, n in moves} | {o for o, _ in moves if o < len(flow[0])})


def _new_shard(flow: list[list[int]], position: Column) -> Column:
    """New shard of a byte position of its old shard: what stays comes first, then one range per flow."""
    shard = F.lit(None).cast("int")
    for o, row in enumerate(flow):
        at = 0
        for n in sorted(range(len(row)), key=lambda n: (n != o, n)):
            if row[n]:
                shard = F.when((F.col("__old") == o) & (position >= at) & (position < at + row[n]), F.lit(n)).otherwise(shard)
                at += row[n]
    return shard


_ORDER = ("__id", "__text")


def reshard(
    docs: DataFrame, old_shard: Column, n_old: int, n_new: int, id_col: str = "doc_id", text_col: str = "text", capacities: list[int] | None = None,
    files_per_shard: int | None = None,
) -> DataFrame:
    """``docs`` with ``shard``, ``slot``, ``old_shard`` and ``size`` (bytes of the text plus 1), read back from the shards' files.

    Old shard i keeps its number as new shard i. Slots count a shard's rows from 0.
    """
    text = F.col(f"`{text_col}`").cast("string")
    marked = docs.withColumns({
        "__old": F.coalesce(old_shard.cast("int"), F.lit(0)), "__size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
        "__id": F.col(f"`{id_col}`").cast("long"), "__text": F.xxhash64(text)})
    marked = marked.drop(*(c for c in docs.columns if c.lower() in {"shard", "slot", "size", "old_shard"}))
    carried = [c for c in marked.columns if not c.startswith("__")]

    found = {r["__old"]: r for r in marked.groupBy("__old").agg(F.sum("__size").alias("bytes"), F.count("*").alias("n")).collect()}  # one row per shard
    supply = [found[o].bytes if o in found else 0 for o in range(n_old)]
    flow = cheapest_flow(supply, capacities or equal_capacities(sum(supply), n_new), [o if o < n_new else None for o in range(n_old)])
    files_per_shard = files_per_shard or max(1, -(-sum(supply) // (n_new * FILE_BYTES)))
    n_blocks = F.array(*(F.lit(max(1, -(-found[o].n // BLOCK_ROWS)) if o in found else 1) for o in range(n_old)))
    blocked = marked.withColumn("__block", F.pmod(F.xxhash64(*_ORDER), F.get(n_blocks, F.col("__old"))).cast("int"))

    sums = blocked.groupBy("__old", "__block").agg(F.sum("__size").alias("bytes"), F.count("*").alias("n"))
    ahead = Window.partitionBy("__old").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    placed = sums.withColumn("start", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)))
    first, last = _new_shard(flow, F.col("start")), _new_shard(flow, F.col("start") + F.col("bytes") - 1)
    placed = store(placed.withColumns({"shard": first, "last": last}), "blocks")
    whole = placed.where("shard = last").select("__old", "__block", "shard", "n")
    border = placed.where("shard <> last").select("__old", "__block", "start")

    inside = Window.partitionBy("__old", "__block").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("start") + F.sum("__size").over(inside) - F.floor((F.col("__size") + 1) / 2)
    cut = lambda df: df.join(border, ["__old", "__block"]).withColumn("middle", middle).withColumn("shard", _new_shard(flow, F.col("middle"))).drop("start", "middle")
    counts = whole.unionByName(cut(blocked.select("__old", "__block", "__size", *_ORDER)).groupBy("__old", "__block", "shard").agg(F.count("*").alias("n")))
    before = Window.partitionBy("shard").orderBy("__old", "__block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block and shard
    slots = store(counts.select("__old", "__block", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot")), "slots")

    moved = blocked.join(slots.join(whole.select("__old", "__block"), ["__old", "__block"], "left_semi"), ["__old", "__block"])
    split = cut(blocked).join(slots, ["__old", "__block", "shard"])
    every = moved.unionByName(split).withColumn("__file", F.pmod(F.xxhash64("__old", "__block"), F.lit(files_per_shard)))
    dealt = every.repartition("shard", "__file")
    rank = F.row_number().over(Window.partitionBy("shard", "__file", "__old", "__block").orderBy(*_ORDER))
    result = dealt.withColumn("slot", F.col("first_slot") + rank - 1).select(
        *(F.col(f"`{c}`") for c in carried), "shard", "slot", F.col("__size").alias("size"), F.col("__old").alias("old_shard"))
    affected = affected_shards(flow)
    files = store(result.where(F.col("shard").isin(affected)), "shards", partition_by=["shard"]).select(*result.columns)
    untouched = sorted(set(range(n_new)) - set(affected))
    return files.unionByName(result.where(F.col("shard").isin(untouched))) if untouched else files
