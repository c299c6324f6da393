"""Minimum-cost repair of chat roles, and rendering of the repaired turns.

A legal conversation is an optional system turn, then user and assistant in turn, beginning with the user. Turn by turn, a
conversation may keep a turn (cost 0), merge it into the turn before it (1 if the roles agree, else 3), relabel it (2), or
insert an empty turn first (3 each). Dynamic programming over the automaton's states finds the cheapest repair; equal costs go to the repair
with fewer turns, then to the earlier rule in that order.

One turn is a small matrix "cost and new turns from state to state", and a run of turns is the product of its matrices (minimum for sum, sum for
product). So conversations are sorted over all partitions and may span any number of them: each partition reduces its part of a
conversation to one matrix, the few parts are chained to find the state at every border, and each partition then traces its own
part. No conversation is gathered, however long.

The result has one row per piece: every input turn is one, and inserted turns are pieces without text. ``rendered`` of all pieces in
order (``seq``) is the formatted conversation; a piece that starts a turn closes the one before it.

Roles are compared trimmed and lower-cased, with common aliases. Null or unknown roles equal no role and are relabelled or
merged; null texts are empty; null conversation ids form one conversation; turns of equal number are ordered by a hash of
role and text, null turn numbers come first. Repeated rows are turns of their own. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagline.llm.scratch import bound_batches, store

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}
KEEP, MERGE, MERGE_OTHER, RELABEL, INSERT = 0, 1, 3, 2, 3
# State 0 is the start, state r + 1 is "the last turn has role r". Where each state may go:
NEXT = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}
FINAL = (2, 3)
ROWS_PER_PART = 20_000
START, END = "<|{role}|>\n", "<|end|>\n"

_STATES = 4
# A cost counts 2^32 per unit and 1 per new turn, so one integer orders by cost, then by turns.
_UNIT = 1 << 32
_NEVER = 1 << 60

Steps = list[tuple[int, int, str, int]]


def role_number(role: str | None) -> int:
    """Place in ROLES, -1 for anything else."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else -1


def _insertions() -> dict[tuple[int, int], list[int]]:
    """Shortest chain of inserted roles from state to state."""
    out = {(s, s): [] for s in range(_STATES)}
    for _ in range(_STATES):
        for (s, t), chain in list(out.items()):
            for role in NEXT[t]:
                if len(out.get((s, role + 1), [0] * _STATES)) > len(chain) + 1:
                    out[s, role + 1] = [*chain, role]
    return out


CHAINS = _insertions()


def moves(role: int) -> dict[tuple[int, int], tuple[int, tuple[int, ...], str, int]]:
    """Cheapest way from state to state over one turn: cost, inserted roles, action, role it is given."""
    best: dict[tuple[int, int], tuple[int, tuple[int, ...], str, int]] = {}
    for (s, mid), chain in CHAINS.items():
        ways = [(mid, MERGE if role == mid - 1 else MERGE_OTHER, 0, "merge", mid - 1)] if mid else []
        ways = [(r + 1, KEEP if r == role else RELABEL, 1, "keep" if r == role else "relabel", r) for r in NEXT[mid]] + ways
        for to, cost, new, action, given in ways:
            total = (cost + INSERT * len(chain)) * _UNIT + new + len(chain)
            if (s, to) not in best or total < best[s, to][0]:
                best[s, to] = (total, tuple(chain), action, given)
    return best


MOVES = {role: moves(role) for role in range(-1, len(ROLES))}


def _matrix(role: int) -> np.ndarray:
    m = np.full((_STATES, _STATES), _NEVER, dtype=np.int64)
    for (s, t), way in MOVES[role].items():
        m[s, t] = way[0]
    return m


MATRICES = {role: _matrix(role) for role in MOVES}
IDENTITY = np.where(np.eye(_STATES, dtype=bool), 0, _NEVER)
# Ending a conversation: insert turns up to a final state.
ENDING = {s: min(((INSERT * _UNIT + 1) * len(CHAINS[s, t]), t) for t in FINAL if (s, t) in CHAINS) for s in range(_STATES)}


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _NEVER)


def trace(roles: list[int], entry: int, leave: int) -> Steps:
    """The cheapest repair of a run of turns between two states: per turn, inserted roles, action, given role."""
    far = np.full(_STATES, _NEVER, dtype=np.int64)
    far[entry] = 0
    back = np.zeros((len(roles), _STATES), dtype=np.int8)
    for i, role in enumerate(roles):
        ways = far[:, None] + MATRICES[role]
        back[i] = ways.argmin(axis=0)
        far = np.minimum(ways.min(axis=0), _NEVER)
    out, state = [], leave
    for i in range(len(roles) - 1, -1, -1):
        before = int(back[i][state])
        _, chain, action, given = MOVES[roles[i]][before, state]
        out.append((chain, action, given))
        state = before
    return out[::-1]


def _number(batches):
    """Numbers the rows of a sorted partition."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.num_rows
        conv, turn, role, text = batch.columns
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(size, part, dtype=np.int32)), pa.array(np.arange(n, n + size, dtype=np.int64)), conv, turn,
            pa.array([role_number(r) for r in role.to_pylist()], pa.int8()), role, text], names=["part", "idx", "conv_id", "turn", "number", "role", "text"])
        n += size


def _runs(batches, *columns: int):
    """Consecutive rows of one (part, conversation): the part, the conversation and the rows' values of ``columns``."""
    key, rows = None, []
    for batch in batches:
        lists = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for i, at in enumerate(zip(lists[0], lists[1])):
            if at != key:
                if rows:
                    yield *key, rows
                key, rows = at, []
            rows.append(tuple(lists[c][i] for c in columns))
    if rows:
        yield *key, rows


_SEGMENT = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("edge", pa.int32()), ("matrix", pa.list_(pa.int64()))])


def _segments(batches):
    """A matrix for the first and the last conversation of every part; those between are whole."""
    def row(part, conv, roles, edge):
        product = IDENTITY
        for (role,) in roles:
            product = times(product, MATRICES[role])
        return pa.RecordBatch.from_pylist(
            [{"part": part, "conv_id": conv, "n_turns": len(roles), "edge": edge, "matrix": product.ravel().tolist()}], schema=_SEGMENT)

    last = None
    for part, conv, roles in _runs(batches, 2):
        if last is None or last[0] != part:
            if last and last[3] != 0:
                yield row(*last)
            yield row(part, conv, roles, 0)
            last = (part, conv, roles, 0)
        else:
            last = (part, conv, roles, 1)
    if last and last[3] != 0:
        yield row(*last)


@dataclass(frozen=True)
class Border:
    """What a part must know about a conversation that goes on beyond it."""

    entry: int
    leave: int
    first_turn: int  # turns of the conversation before this part, input and repaired
    first_new: int
    cost: int | None
    is_last: bool


_BORDERS = "part int, conv_id long, entry int, leave int, first_turn long, first_new long, cost long, is_last boolean"


def _chain(rows):
    """States at the borders of one conversation that spans parts, by one pass over its segment matrices."""
    parts = rows.sort_values("part").to_dict("records")
    far, backs = np.where(np.arange(_STATES) == 0, 0, _NEVER), []
    fars = [far]
    for s in parts:
        ways = far[:, None] + np.array(s["matrix"]).reshape(_STATES, _STATES)
        backs.append(ways.argmin(axis=0))
        far = np.minimum(ways.min(axis=0), _NEVER)
        fars.append(far)
    total, state = min((int(far[s]) + ENDING[s][0], s) for s in range(_STATES))
    states = [state]
    for back in reversed(backs):
        states.append(int(back[states[-1]]))
    states.reverse()
    turns = rows.sort_values("part")["n_turns"]
    return pd.DataFrame({
        "part": [s["part"] for s in parts], "conv_id": rows.sort_values("part")["conv_id"].array, "entry": states[:-1], "leave": states[1:],
        "first_turn": (turns.cumsum() - turns).array, "first_new": [int(f[s]) % _UNIT for f, s in zip(fars, states[:-1])],
        "cost": total // _UNIT, "is_last": [i == len(parts) - 1 for i in range(len(parts))]})


_PIECES = pa.schema([
    ("conv_id", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("out_turn", pa.int64()), ("role", pa.string()), ("given_role", pa.string()),
    ("action", pa.string()), ("cost", pa.int64()), ("rendered", pa.string())])


def _repair():
    def run(batches):
        out = []
        for part, conv, rows in _runs(batches, *range(2, 12)):
            roles = [r[0] for r in rows]
            if rows[0][4] is not None:
                border = Border(*rows[0][4:])
            else:
                product = np.where(np.arange(_STATES) == 0, 0, _NEVER)
                for role in roles:
                    product = np.minimum((product[:, None] + MATRICES[role]).min(axis=0), _NEVER)
                total, leave = min((int(product[s]) + ENDING[s][0], s) for s in range(_STATES))
                border = Border(0, leave, 0, 0, total // _UNIT, True)
            new, seq = border.first_new, border.first_turn
            pieces = []

            def add(turn, role, given, action, text):
                nonlocal new
                head = ""
                if action != "merge":
                    head = (END if new else "") + START.format(role=ROLES[given])
                    new += 1
                elif text:
                    head = "\n"
                pieces.append({
                    "conv_id": conv, "turn": turn, "out_turn": new - 1, "role": role, "given_role": ROLES[given], "action": action,
                    "cost": border.cost, "rendered": head + (text or "")})

            for (chain, action, given), (_, turn, role, text) in zip(trace(roles, border.entry, border.leave), (r[:4] for r in rows)):
                for inserted in chain:
                    add(None, None, inserted, "insert", None)
                add(turn, role, given, action, text)
            if border.is_last:
                for inserted in CHAINS[border.leave, ENDING[border.leave][1]]:
                    add(None, None, inserted, "insert", None)
                pieces[-1]["rendered"] += END
            # input turns before this part, then the place inside it; inserted pieces take part in the count of their part only
            for i, piece in enumerate(pieces):
                piece["seq"] = seq * _STATES + i
            out += pieces
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=_PIECES)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PIECES)

    return run


def repair_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, seq, turn, out_turn, role, given_role, action, cost, rendered``: one row per piece.

    ``cost`` is the whole conversation's; ``seq`` orders a conversation's pieces, with gaps.
    """
    spark = turns.sparkSession
    bound_batches(spark)
    plain = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
    n_parts = max(1, -(-plain.count() // ROWS_PER_PART))
    order = ["conv_id", "turn", "tie", "row"]
    ordered = plain.withColumns({"tie": F.xxhash64("role", "text"), "row": F.monotonically_increasing_id()}).repartitionByRange(
        n_parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")
    numbered = store(ordered.mapInArrow(_number, "part int, idx long, conv_id long, turn long, number byte, role string, text string"), "turns")
    by_part = lambda rows, *columns: rows.select("part", "idx", *columns).repartition(n_parts, "part").sortWithinPartitions("part", "idx").drop("idx")
    # two rows per part at most; those of a conversation that spans parts are chained together
    segments = store(by_part(numbered, "conv_id", "number").mapInArrow(_segments, "part int, conv_id long, n_turns long, edge int, matrix array<long>"), "segments")
    spanning = segments.groupBy(F.col("conv_id").alias("long_id")).agg(F.count("*").alias("k")).where("k > 1").select("long_id")
    borders = segments.join(spanning, F.col("conv_id").eqNullSafe(F.col("long_id"))).groupBy("long_id").applyInPandas(_chain, _BORDERS)
    borders = borders.withColumnsRenamed({"part": "at", "conv_id": "of"})
    known = numbered.join(borders, (F.col("part") == F.col("at")) & F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return by_part(known, "conv_id", "number", "turn", "role", "text", "entry", "leave", "first_turn", "first_new", "cost", "is_last").mapInArrow(
        _repair(), "conv_id long, seq long, turn long, out_turn long, role string, given_role string, action string, cost long, rendered string")
