"""Periodic runs of words in whole texts, by Baier's grouping and Lyndon roots.

A run is a stretch of words with smallest period p that is long enough (``MIN_WORDS`` words and ``MIN_PERIODS`` periods) and that no
neighbouring word extends keeping p. Words, not letters, are the symbols; equal words are equal byte strings.

Stretches. Every window of ``WINDOW`` words inside such a run occurs again one period further left or right, so runs lie within the
stretches whose windows all occur at least twice in the text. Only these stretches go on, each as a string of its own: no run
reaches over a stretch's border, as its windows there would be repeated too. Windows are compared by rolling hashes; a collision
can only make a stretch longer.

Lyndon arrays. Phase one of Baier's suffix sorter starts from groups of equal first symbols and takes the groups from the highest to the
lowest: every suffix of a group points to the nearest earlier suffix of a lower group, whose context grows by the group's context
as often as it is pointed to; suffixes of one group that are pointed to equally often become a new group right above their old
one. A suffix's context when its own turn comes is its longest Lyndon prefix, so no suffix array is needed. Run once under the order of the
symbols and once under the reverse order, the end of the string being smallest in both, the two arrays hold a Lyndon root of every run.

Extension. A root of length p at i is extended right by the longest common extension of i and i + p and left by that of i - 1 and i + p - 1,
for all roots at once by halving over prefix hashes. Each run found is then compared word by word, so a colliding hash costs
time only.

Rows are worked on where they lie, without a shuffle; time grows linearly with a text but for sorting. A null text has no words; a text
without runs keeps all its words. Null or repeated document ids stay as they are, one row in, one row out; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagline.llm.scratch import bound_batches
from lagline.llm.words import Rolling, mix, odd_numbers, texts_of

MIN_WORDS = 24
MIN_PERIODS = 3

_SEED = np.uint64(odd_numbers(1, 61)[0])


def repeated_window(min_words: int, min_periods: int) -> int:
    """Words of a window that every run repeats within itself, so that each of its windows has an equal one a period away.

    A run of n words and period p needs n >= 2p + window - 1, whatever p is: for n >= max(min_words, min_periods * p). Never below two.
    """
    if min_periods < 3:
        raise ValueError("runs of fewer than three periods need not repeat any window")
    return min(max(min_words, min_periods * p) - 2 * p + 1 for p in range(1, max(1, min_words) + 1))


def lyndon_array(symbols: list[int], n_symbols: int) -> list[int]:
    """Length of the longest Lyndon prefix of every suffix; symbols are 0 ... ``n_symbols`` - 1."""
    n = len(symbols)
    group = list(symbols)
    members: list[list[int]] = [[] for _ in range(n_symbols)]
    for i, s in enumerate(symbols):
        members[s].append(i)
    alive = [len(m) for m in members]
    context = [1] * n_symbols
    below, above = list(range(-1, n_symbols - 1)), [*range(1, n_symbols), -1]
    # Where the nearest earlier suffix of a lower group may be; taken suffixes point on. Place -1 is never taken.
    before, taken = list(range(-1, n)), bytearray(n + 1)
    out = [0] * n
    g = n_symbols - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g] if alive[g] else ()
        length = context[g]
        for i in mine:
            taken[i] = 1
            out[i] = length
        hits: dict[int, int] = {}
        for i in mine:
            j = before[i]
            if taken[j]:
                chain = []
                while taken[j]:
                    chain.append(j)
                    j = before[j]
                for k in chain:
                    before[k] = j
                before[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if len(hits) == 1:
            (j, times), = hits.items()
            moves = (((times, group[j]), (j,)),)
        else:
            gathered = defaultdict(list)
            for j, times in hits.items():
                gathered[times, group[j]].append(j)
            moves = sorted(gathered.items(), reverse=True)
        # More contexts make a suffix larger: those pointed to most often go highest above their old group.
        for (times, old), moved in moves:
            if alive[old] == len(moved):
                context[old] += times * length
                continue
            new = len(context)
            context.append(context[old] + times * length), members.append(list(moved)), alive.append(len(moved))
            alive[old] -= len(moved)
            for j in moved:
                group[j] = new
            up = above[old]
            below.append(old), above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
        g = below[g]
    return out


class Runs:
    """Finds the runs of texts; equal words of a batch get equal numbers."""

    def __init__(self, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS):
        self.min_words, self.min_periods = min_words, min_periods
        self.window = repeated_window(min_words, min_periods)
        self.windows, self.prefixes = Rolling(self.window, 62), Rolling(1, 63)

    def stretches(self, numbers: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
        """First and past-last word of every stretch, among the words of several texts one after another."""
        width = self.window
        if len(numbers) < self.min_words:
            return []
        with np.errstate(over="ignore"):
            windows = self.windows.of(mix(numbers.astype(np.uint64) + _SEED))
            # A window that reaches into the next text is none; equal windows count within one text only.
            windows = mix(windows ^ mix(text[: len(windows)].astype(np.uint64) + _SEED))
        whole = np.flatnonzero(text[: len(windows)] == text[width - 1 :])
        _, place, count = np.unique(windows[whole], return_inverse=True, return_counts=True)
        again = np.zeros(len(windows) + 2, dtype=np.int8)
        again[whole[count[place] > 1] + 1] = 1
        # Windows of two texts are never next to each other, as those across their border are none.
        change = np.diff(again)
        firsts, lasts = np.flatnonzero(change == 1), np.flatnonzero(change == -1) + width - 1
        return [(a, b) for a, b in zip(firsts.tolist(), lasts.tolist()) if b - a >= self.min_words]

    def of_stretch(self, numbers: np.ndarray) -> np.ndarray:
        """Runs of one string: rows of start, stop, period, in this order."""
        n = len(numbers)
        symbols = np.unique(numbers, return_inverse=True)[1]
        n_symbols = int(symbols.max()) + 1
        roots = [np.array(lyndon_array(s.tolist(), n_symbols), dtype=np.int64) for s in (symbols, n_symbols - 1 - symbols)]
        start, period = np.tile(np.arange(n), 2), np.concatenate(roots)
        # The run of a root has room for all its periods, and a whole period follows the root in one of its places.
        follows = start + period < n
        start, period = start[follows], period[follows]
        same = (symbols[start] == symbols[start + period]) & (period * self.min_periods <= n)
        start, period = start[same], period[same]
        with np.errstate(over="ignore"):
            sums = self.prefixes.sums(mix(symbols.astype(np.uint64) + _SEED))
            equal = lambda a, b, size: self.prefixes.span(sums, a, a + size) == self.prefixes.span(sums, b, b + size)
            right = self._longest(n - start - period, lambda k, i: equal(start[i], start[i] + period[i], k))
            enough = right >= period
            start, period, right = start[enough], period[enough], right[enough]
            left = self._longest(start.copy(), lambda k, i: equal(start[i] - k, start[i] + period[i] - k, k))
        found = np.stack([start - left, start + period + right, period], axis=1)
        long_enough = found[:, 1] - found[:, 0] >= np.maximum(self.min_words, self.min_periods * period)
        found, start = found[long_enough], start[long_enough]
        runs, of = np.unique(found, axis=0, return_inverse=True)
        good = np.array([np.array_equal(symbols[a : b - p], symbols[a + p : b]) for a, b, p in runs.tolist()], dtype=bool)
        if good.all():
            return runs
        wrong = np.flatnonzero(~good[of.ravel()]).tolist()
        right = {self._compared(symbols, int(start[i]), *found[i].tolist()) for i in wrong} - {None}
        return np.array(sorted({*map(tuple, runs[good].tolist()), *right}), dtype=np.int64).reshape(-1, 3)

    @staticmethod
    def _longest(most: np.ndarray, holds) -> np.ndarray:
        """Per place, the largest size up to ``most`` that ``holds``; it holds for all smaller ones."""
        low, high = np.zeros(len(most), dtype=np.int64), most.astype(np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_] + 1) // 2
            good = holds(middle, open_)
            low[open_[good]] = middle[good]
            high[open_[~good]] = middle[~good] - 1
        return low

    def _compared(self, symbols: np.ndarray, root: int, start: int, stop: int, period: int) -> tuple[int, int, int] | None:
        """The run of a root whose extension by hashes went too far, by comparing symbols; None if it is too short."""
        differ = start + np.flatnonzero(symbols[start : stop - period] != symbols[start + period : stop])
        after = int(np.searchsorted(differ, root))
        first = int(differ[after - 1]) + 1 if after else start
        last = (int(differ[after]) if after < len(differ) else stop - period) + period
        return (first, last, period) if last - first >= max(self.min_words, self.min_periods * period) else None

    def of(self, texts: list[bytes]) -> list[tuple[np.ndarray, list[bytes]]]:
        """Per text its runs (rows of start, stop, period by start, then period) and its words."""
        words = [t.split() for t in texts]
        known: dict[bytes, int] = {}
        number = known.setdefault
        flat = np.fromiter((number(w, len(known)) for ws in words for w in ws), dtype=np.int64)
        sizes = np.array([len(ws) for ws in words], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(texts)), sizes)
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for a, b in self.stretches(flat, text):
            runs = self.of_stretch(flat[a:b])
            if len(runs):
                t = int(text[a])
                found[t].append(runs + np.array([a - first[t], a - first[t], 0]))
        none = np.empty((0, 3), dtype=np.int64)
        out = []
        for f, ws in zip(found, words):
            runs = np.concatenate(f) if f else none
            out.append((runs[np.lexsort((runs[:, 2], runs[:, 0]))], ws))
        return out


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("strongest", _RUN), ("kept_text", pa.string())])
_DDL = "start long, length long, period long"


def without_repeats(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside all runs' later periods, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def strongest(runs: np.ndarray) -> dict | None:
    """The run with the greatest length per period; ties go to the smallest start, then period."""
    best = None
    for start, stop, period in runs.tolist():
        # Compared as whole numbers, so equal ratios are equal.
        if best is None or (stop - start) * best["period"] > best["length"] * period:
            best = {"start": start, "length": stop - start, "period": period}
    return best


def _find(min_words: int, min_periods: int):
    def run(batches):
        finder = Runs(min_words, min_periods)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            rows = []
            for key, (runs, words) in zip(keys, finder.of(texts)):
                listed = [{"start": a, "length": b - a, "period": p} for a, b, p in runs.tolist()]
                rows.append({"doc_id": key, "runs": listed, "strongest": strongest(runs), "kept_text": without_repeats(words, runs).decode("utf-8", "replace")})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return run


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
) -> DataFrame:
    """``doc_id, runs, strongest, kept_text``: every run (by start, then period), the one with most periods, and the text without repeats."""
    repeated_window(min_words, min_periods)
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return plain.mapInArrow(_find(min_words, min_periods), f"doc_id long, runs array<struct<{_DDL}>>, strongest struct<{_DDL}>, kept_text string")
