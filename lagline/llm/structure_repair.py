"""Cheapest repair of damaged conversations by block tables of normalised cost vectors (the Four-Russians method).

Faults. A turn is blank (no word), duplicate (its role and text were seen earlier in the conversation) or truncated (its last word does not
end a sentence); the first that fits counts. Edits: keep a turn (cost 0), give it the role user or assistant (2), delete it (3, and a must
for blank and duplicate turns), insert an empty user or assistant turn anywhere (2); a truncated turn that stays costs 1. The
repaired roles are nothing, or user and assistant in turn, begun by the user and ended by the assistant, after one system
turn at most. Of the cheapest repairs the one whose edits ``D``, ``I``, ``K``, ``R``, read in order, come first wins.

Block tables. The automaton has four states, so what is left to pay after a turn is a vector of four costs. Subtracting the least
leaves one of a few dozen normalised vectors, and a turn is one of nine symbols. For every vector and every block of ``BLOCK`` symbols a table holds the vector
before the block and the amount subtracted. A conversation is walked from its end block by block, one lookup each; only the vectors at the block
borders are kept. Then the blocks are expanded, each backward from its right border to get the vectors between its turns, and traced
forward: at every turn the first letter in the alphabet that still reaches the least cost is taken, so ties are safe.

Long conversations. Turns are sorted over all partitions, so a conversation may span any number of parts. A part of such a conversation is
one row of the table "vector after the part -> vector before it, amount"; these few rows are chained from the last to the first.
With the vectors known at its borders, a part tells where its trace ends for each state it may begin in; these are chained from first to last. Every
part then traces its own turns. No conversation is gathered in one task.

Null roles and texts count as one space, a null text is therefore blank; rows with a null conversation id form one conversation; null turn numbers come
first, turns of equal number are ordered by role, then text; repeated rows are turns of their own (the later ones duplicates).
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagline.llm.scratch import bound_batches, store

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLOCK = 4
ROWS_PER_PART = 20_000
BYTES_PER_PART = 16 << 20
WHITE = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"

# States: nothing yet, after the system turn, after a user, after an assistant. A symbol is 2 * initial + truncated; the last
# one must go. Initials: system, user, assistant, any other.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
N_SYMBOLS, MUST_GO = 9, 8
# Where a user or assistant turn leads that is put in, or made of another role, in each state.
FREE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAULTS = ("blank", "duplicate", "truncated")

Vector = tuple[int, ...]


def _with_insertions(costs: list[int | None]) -> Vector:
    """Costs when turns may be inserted first."""
    known = [10**6 if c is None else c for c in costs]
    for _ in known:
        known = [min(c, INSERT + known[FREE[s]]) for s, c in enumerate(known)]
    return tuple(known)


AT_END = _with_insertions([0, None, None, 0])


def _ways(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of all that may be done with a turn, by letter."""
    yield "D", DELETE, state
    if symbol != MUST_GO:
        extra = TRUNCATED * (symbol % 2)
        if (state, symbol // 2) in KEPT:
            yield "K", KEEP + extra, KEPT[state, symbol // 2]
        yield "R", REROLE + extra, FREE[state]


def before_turn(symbol: int, after: Vector) -> Vector:
    """Costs still to pay before a turn, given those after it."""
    return _with_insertions([min(cost + after[to] for _, cost, to in _ways(symbol, state)) for state in range(4)])


def least_letters(symbol: int, after: Vector, state: int) -> tuple[str, int]:
    """Letters of insertions before the turn and of its own edit, and the next state: the first in the alphabet among the cheapest."""
    before, letters = before_turn(symbol, after), ""
    while True:
        ways = {letter: to for letter, cost, to in _ways(symbol, state) if cost + after[to] == before[state]}
        if "D" not in ways and INSERT + before[FREE[state]] == before[state]:
            letters, state = letters + "I", FREE[state]
            continue
        letter = min(ways)
        return letters + letter, ways[letter]


def last_letters(state: int) -> str:
    """Insertions after the last turn."""
    letters = ""
    while AT_END[state]:
        letters, state = letters + "I", FREE[state]
    return letters


class Tables:
    """Normalised vectors, and what single turns and whole blocks do to them."""

    def __init__(self, block: int = BLOCK):
        least = min(AT_END)
        self.vectors: list[Vector] = [tuple(c - least for c in AT_END)]
        self.end, self.end_cost = 0, least
        known, to, paid, letters = {self.vectors[0]: 0}, [], [], []
        for vector in self.vectors:  # grows while it is walked
            to.append([]), paid.append([]), letters.append([])
            for symbol in range(N_SYMBOLS):
                costs = before_turn(symbol, vector)
                least = min(costs)
                normal = tuple(c - least for c in costs)
                if normal not in known:
                    known[normal] = len(self.vectors)
                    self.vectors.append(normal)
                to[-1].append(known[normal]), paid[-1].append(least)
                letters[-1].append([least_letters(symbol, vector, state) for state in range(4)])
        self.one_to, self.letters, self.block = to, letters, block
        one_to, one_paid = np.array(to), np.array(paid)
        self.one_to_array, self.one_paid_array = one_to, one_paid
        block_to, block_paid = one_to, one_paid
        for _ in range(block - 1):
            # One more symbol in front: the block behind it is done first.
            n = len(one_to)
            block_paid = (block_paid[:, None, :] + one_paid[block_to].transpose(0, 2, 1)).reshape(n, -1)
            block_to = one_to[block_to].transpose(0, 2, 1).reshape(n, -1)
        self.to, self.paid = block_to, block_paid
        self.weights = N_SYMBOLS ** np.arange(block - 1, -1, -1)

    def blocks(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """The odd symbols in front, and the codes of the whole blocks after them."""
        odd = len(symbols) % self.block
        return symbols[:odd].tolist(), (symbols[odd:].reshape(-1, self.block) @ self.weights).tolist()

    def through(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector after some turns, the vector before them and the cost taken off."""
        odd, codes = self.blocks(symbols)
        at, paid = np.arange(len(self.vectors)), np.zeros(len(self.vectors), dtype=np.int64)
        for code in reversed(codes):
            at, paid = self.to[at, code], paid + self.paid[at, code]
        for symbol in reversed(odd):
            at, paid = self.one_to_array[at, symbol], paid + self.one_paid_array[at, symbol]
        return at, paid

    def trace(self, symbols: np.ndarray, state: int, after: int) -> tuple[list[str], int]:
        """Letters of every turn (insertions before it included) and the state after the last, with vector ``after`` behind them."""
        odd, codes = self.blocks(symbols)
        borders = [after]
        for code in reversed(codes):
            borders.append(int(self.to[borders[-1], code]))
        borders.reverse()
        out: list[str] = []

        def expand(turns: list[int], right: int, state: int) -> int:
            inside = [right]
            for symbol in reversed(turns):
                inside.append(self.one_to[inside[-1]][symbol])
            for symbol, behind in zip(turns, inside[-2::-1]):
                letters, state = self.letters[behind][symbol][state]
                out.append(letters)
            return state

        state = expand(odd, borders[0], state)
        turns = symbols[len(odd) :].tolist()
        for i, right in enumerate(borders[1:]):
            state = expand(turns[i * self.block : (i + 1) * self.block], right, state)
        return out, state


def initial_number(role: Column) -> Column:
    """Place of the role's first letter in INITIALS, 3 for any other."""
    number = F.lit(len(INITIALS))
    for i, letter in enumerate(INITIALS):
        number = F.when(F.startswith(role, F.lit(letter)), i).otherwise(number)
    return number.cast("byte")


def _number(batches):
    """Numbers the rows of a sorted partition and marks pairs of neighbours in one conversation whose roles may not follow each other."""
    part, n, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        size = batch.num_rows
        pairs = list(zip(batch.column("conv_id").to_pylist(), batch.column("initial").to_pylist()))
        illegal = [before is not None and before[0] == now[0] and not follows(before[1], now[1]) for before, now in zip([last, *pairs], pairs)]
        last, n = pairs[-1] if size else last, n + size
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, part, dtype=np.int32)), pa.array(np.arange(n - size, n, dtype=np.int64)), pa.array(illegal, pa.bool_()), *batch.columns],
            names=["part", "idx", "illegal", *batch.schema.names])


def follows(before: int, now: int) -> bool:
    """System before user, or user and assistant in either order."""
    return (before, now) in ((0, 1), (1, 2), (2, 1))


def _segments_of(table: pa.Table) -> Iterator[tuple[int | None, int, int]]:
    """(conversation, first row, past-last row) of a part's rows, which are in order."""
    ids, start = table.column("conv_id").to_pylist(), 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[start]:
            yield ids[start], start, i
            start = i


def _symbols(table: pa.Table) -> np.ndarray:
    return table.column("symbol").to_numpy().astype(np.int64)


_EDGE = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("to", pa.list_(pa.int32())), ("paid", pa.list_(pa.int64()))])


def _edges(table: pa.Table) -> pa.Table:
    """What the first and the last conversation of a part do to every vector; those between lie in this part alone."""
    tables, table, rows = Tables(), table.sort_by("idx"), []
    symbols, found = _symbols(table), list(_segments_of(table))
    for conv, a, b in found[:1] + found[1:][-1:]:
        to, paid = tables.through(symbols[a:b])
        rows.append({"part": table.column("part")[0].as_py(), "conv_id": conv, "to": to.tolist(), "paid": paid.tolist()})
    return pa.Table.from_pylist(rows, schema=_EDGE)


_RIGHT = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("after", pa.int32()), ("cost", pa.int64())])


def _chain_back(table: pa.Table) -> pa.Table:
    """The vector behind every part of one conversation, and the conversation's cost."""
    tables = Tables()
    rows = sorted(table.to_pylist(), key=lambda r: -r["part"])
    after, total, out = tables.end, tables.end_cost, []
    for row in rows:
        out.append({"part": row["part"], "conv_id": row["conv_id"], "after": after})
        total, after = total + row["paid"][after], row["to"][after]
    total += tables.vectors[after][START]
    return pa.Table.from_pylist([r | {"cost": total} for r in out], schema=_RIGHT)


_LEAVE = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("after", pa.int32()), ("cost", pa.int64()), ("leave", pa.list_(pa.int32()))])


def _leaves(table: pa.Table) -> pa.Table:
    """Per part of a conversation that spans parts: the state its trace ends in for every state it may begin in."""
    tables, table, rows = Tables(), table.sort_by("idx"), []
    symbols = _symbols(table)
    for conv, a, b in _segments_of(table):
        row = {name: table.column(name)[a].as_py() for name in ("part", "after", "cost")}
        rows.append(row | {"conv_id": conv, "leave": [tables.trace(symbols[a:b], state, row["after"])[1] for state in range(4)]})
    return pa.Table.from_pylist(rows, schema=_LEAVE)


_BORDER = pa.schema([
    ("at", pa.int32()), ("of", pa.int64()), ("after", pa.int32()), ("cost", pa.int64()), ("entry", pa.int32()), ("is_first", pa.bool_()), ("is_last", pa.bool_())])


def _chain_forward(table: pa.Table) -> pa.Table:
    """The state in which every part of one conversation begins."""
    rows, state, out = sorted(table.to_pylist(), key=lambda r: r["part"]), START, []
    for i, row in enumerate(rows):
        out.append({
            "at": row["part"], "of": row["conv_id"], "after": row["after"], "cost": row["cost"], "entry": state,
            "is_first": i == 0, "is_last": i == len(rows) - 1})
        state = row["leave"][state]
    return pa.Table.from_pylist(out, schema=_BORDER)


def _ddl(schema: pa.Schema) -> str:
    names = {"int32": "int", "int64": "long", "bool": "boolean", "list<item: int32>": "array<int>", "list<item: int64>": "array<long>",
             "list<element: int32>": "array<int>", "list<element: int64>": "array<long>"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


_EDIT = pa.struct([("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("edits", pa.list_(_EDIT))])
_REPAIRED_DDL = "conv_id long, part int, cost long, audit string, edits array<struct<turn long, edit string, role string, text string>>"


def _repair(turns: pa.Table, known: pa.Table) -> pa.Table:
    """Edits of a part's turns; ``known`` has their symbols and, of conversations that go on in other parts, the borders."""
    tables, turns, known = Tables(), turns.sort_by("idx"), known.sort_by("idx")
    symbols, out = _symbols(known), []
    border = {name: known.column(name) for name in ("after", "cost", "entry", "is_last")}
    number, role, text = (turns.column(name) for name in ("turn", "role", "text"))
    for conv, a, b in _segments_of(known):
        after, cost, state, is_last = (border[name][a].as_py() for name in ("after", "cost", "entry", "is_last"))
        if after is None:
            before, paid = tables.through(symbols[a:b])
            after, state, is_last = tables.end, START, True
            cost = tables.end_cost + int(paid[after]) + tables.vectors[before[after]][START]
        edits, at, letters_of = [], state, tables.trace(symbols[a:b], state, after)[0]
        for i, letters in enumerate(letters_of, start=a):
            for letter in letters:
                edit = {"turn": None, "edit": letter, "role": None, "text": ""}
                if letter != "I":
                    edit |= {"turn": number[i].as_py(), "role": role[i].as_py(), "text": text[i].as_py()}
                if letter in "IR":
                    at = FREE[at]
                    edit["role"] = ROLE[at]
                elif letter == "K":
                    at = KEPT[at, int(symbols[i]) // 2]
                edits.append(edit)
        if is_last:
            for letter in last_letters(at):
                at = FREE[at]
                edits.append({"turn": None, "edit": letter, "role": ROLE[at], "text": ""})
        audit = "".join(e["edit"] for e in edits)
        out.append({"conv_id": conv, "part": turns.column("part")[0].as_py(), "cost": cost, "audit": audit, "edits": edits})
    return pa.Table.from_pylist(out, schema=_REPAIRED)


def _in_parts(turns: DataFrame) -> DataFrame:
    """Turns in order, numbered (``part``, ``idx``) and stored, with what each is by itself."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    total = turns.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()
    n_parts = max(1, -(-total[0] // ROWS_PER_PART), -(-(total[1] or 0) // BYTES_PER_PART))
    order = ["conv_id", "turn", "role", "text", "row"]
    ordered = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row")).repartitionByRange(
        n_parts, *order).sortWithinPartitions(*order)
    words = F.rtrim("text", F.lit(WHITE))
    base = F.when(words == "", MUST_GO).otherwise(2 * F.col("initial") + (~F.right(words, F.lit(1)).isin(*ENDINGS)).cast("int"))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    shaped = ordered.withColumn("initial", initial_number(F.col("role"))).select(
        "conv_id", "turn", "role", "text", "initial", base.cast("byte").alias("base"), key.alias("key"))
    schema = "part int, idx long, illegal boolean, conv_id long, turn long, role string, text string, initial byte, base byte, key binary"
    return store(shaped.mapInArrow(_number, schema), "turns")


def _with_faults(turns: DataFrame) -> DataFrame:
    """``part, idx, conv_id, turn, fault, illegal, symbol``: what earlier turns make of each turn."""
    # The first of equal turns is found per key before the shuffle; rows are then matched by their place, which no two share.
    firsts = turns.where(F.col("base") != MUST_GO).groupBy("conv_id", "key").agg(F.min(F.struct("part", "idx")).alias("first"))
    firsts = firsts.select(F.col("first.part").alias("p"), F.col("first.idx").alias("i"))
    plain = turns.select("part", "idx", "conv_id", "turn", "initial", "base", "illegal")
    marked = plain.join(firsts, (F.col("part") == F.col("p")) & (F.col("idx") == F.col("i")), "left")
    fault = F.when(F.col("base") == MUST_GO, "blank").when(F.col("p").isNull(), "duplicate").when(F.col("base") % 2 == 1, "truncated")
    symbol = F.when(F.col("p").isNull(), MUST_GO).otherwise(F.col("base")).cast("int")
    return marked.select("part", "idx", "conv_id", "turn", fault.alias("fault"), "illegal", symbol.alias("symbol"))


def _border_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id, n``: illegal pairs of neighbours that lie in two parts."""
    ends = turns.groupBy("part").agg(
        F.min_by(F.struct("conv_id", "initial"), "idx").alias("first"), F.max_by(F.struct("conv_id", "initial"), "idx").alias("last"))
    by_part = Window.orderBy("part")  # one row per part
    pairs = ends.select("first", F.lag("last").over(by_part).alias("before")).where(F.col("before.conv_id").eqNullSafe(F.col("first.conv_id")) & F.col("before").isNotNull())
    fine = F.array(*(F.struct(F.lit(a).cast("byte").alias("a"), F.lit(b).cast("byte").alias("b")) for a in range(4) for b in range(4) if follows(a, b)))
    pair = F.struct(F.col("before.initial").alias("a"), F.col("first.initial").alias("b"))
    return pairs.where(~F.array_contains(fine, pair)).groupBy(F.col("first.conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n"))


def repair_structure(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(repairs, faults) of all conversations.

    repairs: ``conv_id, part, cost, audit, edits``, one row per conversation, or per part of a long one in the order of ``part``; ``edits`` has
    turn, edit, role and text of every edit in order (deleted turns are edits ``D``), ``audit`` their letters, ``cost`` is the whole conversation's.
    faults: ``conv_id, gaps, blank, duplicate, truncated, illegal``, one row per conversation: turn numbers missing between the
    least and the greatest, turns by fault, and pairs of neighbours whose roles may not follow each other.
    """
    bound_batches(turns.sparkSession)
    numbered = _in_parts(turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text")))
    marked = store(_with_faults(numbered), "marked")
    symbols = marked.select("part", "idx", "conv_id", "symbol")

    edges = store(symbols.groupBy("part").applyInArrow(_edges, _ddl(_EDGE)), "edges")
    long_ids = edges.groupBy(F.col("conv_id").alias("long_id")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("long_id")
    spanning = edges.join(long_ids, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi")
    rights = spanning.groupBy("conv_id").applyInArrow(_chain_back, _ddl(_RIGHT)).withColumnsRenamed({"part": "p", "conv_id": "c"})
    inside = symbols.join(rights, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")))
    leaves = inside.select("part", "idx", "conv_id", "symbol", "after", "cost").groupBy("part").applyInArrow(_leaves, _ddl(_LEAVE))
    borders = store(leaves.groupBy("conv_id").applyInArrow(_chain_forward, _ddl(_BORDER)), "borders")

    known = symbols.join(borders, (F.col("part") == F.col("at")) & F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "part", "idx", "conv_id", "symbol", "after", "cost", "entry", "is_last")
    texts = numbered.select("part", "idx", "turn", "role", "text")
    repairs = texts.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_repair, _REPAIRED_DDL)

    counted = marked.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *(F.count(F.when(F.col("fault") == name, 1)).alias(name) for name in FAULTS), F.count(F.when(F.col("illegal"), 1)).alias("inner"))
    pairs = _border_pairs(numbered).withColumnRenamed("conv_id", "c")
    joined = counted.join(pairs, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    faults = joined.select(
        "conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), *FAULTS, (F.col("inner") + F.coalesce("n", F.lit(0))).alias("illegal"))
    return repairs, faults


def repaired_turns(repairs: DataFrame) -> DataFrame:
    """``conv_id, part, place, turn, edit, role, text``: the turns of the repaired conversations, ordered by part and place."""
    listed = repairs.select("conv_id", "part", F.posexplode("edits").alias("place", "e")).select("conv_id", "part", "place", "e.*")
    return listed.where(F.col("edit") != "D")


def _digests(batches):
    from hashlib import sha256

    def row(conv, cost, audit, digest):
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=shape)

    shape = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    open_, done = None, []
    for batch in batches:
        for conv, cost, audit, lines in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if open_ is None or open_[0] != conv:
                if open_:
                    done.append(row(*open_[:4]))
                open_ = [conv, cost, [], sha256(), False]
            open_[2].append(audit)
            if lines is not None:
                open_[3].update(("\n" if open_[4] else "").encode() + lines.encode())
                open_[4] = True
        if done:
            yield from done
            done = []
    if open_:
        yield row(*open_[:4])


def digests(repairs: DataFrame) -> DataFrame:
    """``conv_id, cost, audit, repaired_sha256``: one row per conversation.

    A hash of a whole text is one chain of steps, so the parts of a conversation pass through one task, one after another, none kept.
    """
    kept = F.filter("edits", lambda e: e["edit"] != "D")
    lines = F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n"))
    chunks = repairs.select("conv_id", "cost", "audit", lines.alias("lines"), "part")
    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part").drop("part")
    return ordered.mapInArrow(_digests, "conv_id long, cost long, audit string, repaired_sha256 string")
