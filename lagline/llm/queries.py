"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagline.llm import (
    bpe, chat_repair, decontaminate, html_paths, minhash_dedup, periodic_runs, pivotal_mix, quality_rules, reshard, structure_repair, substring_dedup, token_store, url_trust,
)
from lagline.llm.words import let, word_array

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_quality_rules", quality_rules.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.rule_ledger(_table(spark, sf_dir, "documents")))


@_query("op2_chat_repair")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_chats(_table(spark, sf_dir, "conversations"))


@_query("op3_minhash_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query("op7_pivotal_mix")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pivotal_mix.copies(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


@_query("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op10_token_store")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op5_url_trust")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge_urls(_table(spark, sf_dir, "pages"))


@_query("op6_html_paths")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract_articles(_table(spark, sf_dir, "pages"))


N_SHARDS = 8


@_query("op9_reshard")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From shards by source, which are uneven, to shards of equal bytes."""
    old = F.pmod(F.xxhash64("source"), F.lit(N_SHARDS))
    shards = reshard.reshard(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), old, N_SHARDS, N_SHARDS)
    return shards.select(
        "doc_id", "size", F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with some turns dropped, emptied, cut short, repeated or given to the user, by a hash of conversation and turn."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    marked = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), harm.alias("harm")).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1))).alias("copy")
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


@_query("op11_structure_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    repairs, faults = structure_repair.repair_structure(damaged(turns))
    found = structure_repair.digests(repairs).join(faults.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    every = turns.select(F.col("conv_id").alias("c")).distinct()
    joined = every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        F.col("c").alias("conv_id"), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def planted_period(doc_id: Column, text: Column) -> Column:
    """The text, in one document of ten with its words from some place on replaced by repetitions of the first of them."""
    words = word_array(text)
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def plant(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        kept = F.slice(w, F.lit(1), a)
        again = F.transform(F.sequence(F.lit(0), n - a - 1), lambda k: F.get(w, a + k % p))
        return F.array_join(F.concat(kept, again), " ")

    chosen = (h % 10 == 0) & (F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return F.when(chosen, let(words, plant)).otherwise(text)


@_query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", planted_period(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.periodic_runs(docs)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))


@_query("op13_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))
