"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document: its measurements are stored and its failure is one bit of
``fail_bits``. A policy is a versioned mask over those bits, so a changed policy or the question "what
does this rule alone reject?" never reads a text again: both are bitwise expressions over the ledger,
and ablations need only the histogram of the distinct bit patterns.

Everything is a Spark SQL expression. A text is handled inside its own row, so there is no shuffle.

Null or empty texts have no words and fail ``few_words``. Repeated rows and rows of equal ids are
judged each by itself, null ids are kept as they are, and an empty table gives an empty ledger. Columns other
than the id and the text are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagline.llm.words import WORD_BREAK, let, word_array

WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_bangs")

# Rule name -> condition over the measurements that makes a document fail; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_or_long_words": "word_chars < 2 * n_words OR word_chars > 14 * n_words",
    "exclamations": "100 * n_bangs > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """Rejects documents that fail more than ``tolerated`` of the named rules, or any of ``always``."""

    version: str
    rules: tuple[str, ...]
    tolerated: int = 0
    always: tuple[str, ...] = ()


BASE = ("few_words", "repeated_windows")
STRICT = Policy("strict-1", tuple(RULES), 0)
LENIENT = Policy("lenient-1", tuple(RULES), 1, BASE)


def bit_mask(names: tuple[str, ...]) -> int:
    order = list(RULES)
    return sum(1 << order.index(name) for name in names)


def repeated_window_words(words: Column) -> Column:
    """Words inside windows of eight words that the text has twice or more, the first one included.

    Hashes only prove that a text has no repeated window; otherwise the windows themselves are sorted
    and neighbours compared, so the count is exact and takes n log n steps.
    """
    starts = lambda w: F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    hashes = lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    keyed = lambda w: F.array_sort(F.transform(
        starts(w), lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("window"), i.alias("start"))))

    def repeated_starts(rows: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(rows, i)["window"] == x["window"], F.lit(False))
        marked = F.transform(rows, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["start"]))
        return F.array_sort(F.array_compact(marked))

    def covered(positions: Column) -> Column:
        steps = F.transform(positions, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    exact = lambda w: let(let(keyed(w), repeated_starts), covered)
    checked = lambda w: let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(w)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(checked(words)).cast("long")


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    word_counts = let(word_array(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words")))
    return F.struct(
        word_counts.alias("words"), line_counts.alias("lines"),
        F.length(F.regexp_replace(body, WORD_BREAK, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length(body) - F.length(F.regexp_replace(body, "!", ""))).cast("long").alias("n_bangs"),
    )


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the columns to ``carry``, all measurements and ``fail_bits``."""
    kept = [F.col(f"`{c}`") for c in carry]
    measured = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *kept, measurements(F.col(f"`{text_col}`")).alias("__m"))
    flat = measured.select(
        "doc_id", *kept, F.col("__m.words.n_words"), F.col("__m.word_chars"), F.col("__m.n_symbols"), F.col("__m.lines.n_lines"),
        F.col("__m.lines.n_dup_lines"), F.col("__m.words.n_repeat_words"), F.col("__m.n_bangs"))
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, condition in enumerate(RULES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return flat.withColumn("fail_bits", total.cast("long"))


def passes(policy: Policy, bits: Column | None = None) -> Column:
    """Whether the policy keeps a document with these failure bits."""
    bits = F.col("fail_bits") if bits is None else bits
    allowed = F.bit_count(bits.bitwiseAND(F.lit(bit_mask(policy.rules)))) <= policy.tolerated
    return allowed & (bits.bitwiseAND(F.lit(bit_mask(policy.always))) == 0)


def apply_policy(ledger: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The ledger with ``base_failed``, the policy's version and ``kept``."""
    base = F.col("fail_bits").bitwiseAND(F.lit(bit_mask(BASE))) != 0
    return ledger.withColumns({
        "base_failed": base, "policy": F.lit(policy.version), "kept": ~base & passes(policy),
    })


def ablations(ledger: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """Per rule of the policy: documents failing it, and those that only this rule rejects.

    The ledger is first reduced to its distinct bit patterns (at most two to the number of rules, and
    combined before the shuffle), so any number of policies and rules costs one pass.
    """
    patterns = ledger.groupBy("fail_bits").agg(F.count("*").alias("n"))
    out = None
    for i, name in enumerate(policy.rules):
        without = F.col("fail_bits").bitwiseAND(F.lit(~bit_mask((name,))))
        fails = F.col("fail_bits").bitwiseAND(F.lit(bit_mask((name,)))) != 0
        saved = ~passes(policy) & passes(policy, without)
        row = patterns.agg(
            F.coalesce(F.sum(F.when(fails, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(saved, F.col("n"))), F.lit(0)).alias("n_only_this"),
        ).select(F.lit(policy.version).alias("policy"), F.lit(name).alias("rule"), "n_failed", "n_only_this")
        out = row if out is None else out.unionByName(row)
    return out


SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
numbered AS (SELECT row_number() OVER () AS r, * FROM base),
wins AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS w
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM numbered WHERE len(ws) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM wins) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(8) AS t(j) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT r, unnest(string_split(body, chr(10))) AS line FROM numbered)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         length(body) - length(replace(body, '!', '')) AS n_bangs
  FROM numbered LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
judged AS (
  SELECT *, (n_words < 20) OR (100 * n_repeat_words > 30 * n_words) AS base_failed,
         (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
       + (CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 16 ELSE 0 END)
       + (CASE WHEN 100 * n_bangs > 20 * n_words THEN 32 ELSE 0 END) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_bangs, fail_bits, base_failed,
       'strict-1' AS policy, fail_bits = 0 AS kept
FROM judged
"""
